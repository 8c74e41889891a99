"""Plate grids and completeness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators.joins import key_grid

# Rows and columns of the plate formats
PLATE_FORMATS = {96: (8, 12), 384: (16, 24), 1536: (32, 48)}


def well_grid(spark: SparkSession, wells: int = 384) -> DataFrame:
    """(name, row, col) of a plate format; rows beyond Z continue with AA in two-letter plates."""
    if wells not in PLATE_FORMATS:
        raise ValueError(f"plate design with {wells} wells unknown")
    rows, cols = PLATE_FORMATS[wells]
    i = F.col("id")
    letter = F.char(F.lit(65) + F.floor(i / cols) % 26)
    if wells == 1536:
        letter = F.concat(F.char(F.lit(65) + F.floor(F.floor(i / cols) / 26)), letter)
    col = F.lpad((i % cols + 1).cast("string"), 2, "0")
    return spark.range(rows * cols).select(F.concat(letter, col).alias("name"), letter.alias("row"), col.alias("col"))


def missing_units(plates: DataFrame, grid: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected plate × well that was not observed."""
    return key_grid(plates.distinct(), grid).join(observed.select(*keys).distinct(), keys, "left_anti")


def reconcile_tables(a: DataFrame, b: DataFrame, keys: list[str], unit: list[str], values: list[str]) -> DataFrame:
    """Per unit whether both tables hold the same rows and values (nulls equal)."""
    x = a.select(*keys, F.struct(*values).alias("_x"), F.lit(True).alias("_in_a"))
    y = b.select(*keys, F.struct(*values).alias("_y"), F.lit(True).alias("_in_b"))
    both = x.join(y, keys, "full")
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.col("_x").eqNullSafe(F.col("_y"))
    return both.groupBy(*unit).agg(F.count(F.lit(1)).alias("rows"), F.bool_and(same).alias("equal"))


def bad_unit_report(df: DataFrame, unit: list[str], valid: Column, is_zero: Column, zeros: int = 2048 * 2048) -> DataFrame:
    """Units with a failed validation or with at least ``zeros`` zero values."""
    s = df.groupBy(*unit).agg(F.count_if(~valid).alias("failures"), F.count_if(is_zero).alias("zeros"))
    return s.where((F.col("failures") > 0) | (F.col("zeros") >= zeros))


def normalise_names(c: str | Column) -> Column:
    """Zero-pad the single digits of 'x - 3(' and 'z 4)'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, r"- ([0-9])\(", "- 0$1("), r"z ([0-9])\)", "z 0$1)")
