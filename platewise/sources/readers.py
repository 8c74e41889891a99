"""Text sources: plate-reader files, CSV in two dialects, gene sets, annotated variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS_SCHEMA = "screen string, well string, pcount long"


def scan_plate_reader(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless tab-separated counts, one file per plate."""
    return spark.read.schema(READS_SCHEMA).option("sep", "\t").csv(path)


def scan_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def decimal_comma(column: str):
    """'1,5' to 1.5; Inf and NaN are kept, unreadable text gives null."""
    text = F.regexp_replace(F.trim(F.col(column)), ",", ".")
    return F.when(text == "Inf", F.lit(float("inf"))).when(text == "-Inf", F.lit(float("-inf"))).otherwise(text.try_cast("double"))


def scan_csv2(spark: SparkSession, path: str | list[str], columns: list[str], numeric: list[str]) -> DataFrame:
    """Semicolon-separated text with decimal commas and maybe a byte-order mark."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("sep", ";").csv(path)
    first = columns[0]
    raw = raw.withColumn(first, F.regexp_replace(first, "^﻿", ""))
    return raw.select(*[decimal_comma(c).alias(c) if c in numeric else F.col(c) for c in columns])


def keep_symbols(lines: DataFrame) -> DataFrame:
    """Drop blank lines, the description and the line that repeats the set's name."""
    symbol = F.col("symbol")
    return lines.where((symbol != "") & ~symbol.startswith(">") & (symbol != F.col("gs_name"))).select("gs_name", "symbol")


def scan_gene_sets(spark: SparkSession, path: str | list[str], pattern: str = r"([^/]+)\.txt$") -> DataFrame:
    """Set files: name, a '>' description line, one symbol per line -> (gs_name, symbol).

    The set's name is what ``pattern`` finds in the path, so files can be split and read in any order.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return keep_symbols(spark.read.text(path).select(F.trim("value").alias("symbol"), name.alias("gs_name")))


def scan_many_files(spark: SparkSession, paths: str | list[str], schema: str, key: str, pattern: str, header: bool = True) -> DataFrame:
    """Read many CSV files and keep a key taken from each one's path."""
    return (
        spark.read.schema(schema).option("header", header).csv(paths)
        .withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    )


def scan_vcf_lines(spark: SparkSession, path: str | list[str], sample_pattern: str = r"([^/_]+)_[^/]*$") -> DataFrame:
    """Variant lines (not the # header) with their tab fields and the sample from the file name."""
    return (
        spark.read.text(path)
        .select(F.regexp_extract(F.col("_metadata.file_path"), sample_pattern, 1).alias("sample"), F.col("value").alias("text"))
        .where(~F.col("text").startswith("#"))
        .withColumn("fields", F.split("text", "\t"))
    )
