"""Joins. No hints: Spark broadcasts under its size threshold and splits skewed keys otherwise."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.expr import nsjoin
from platewise.operators.order import running

BLOCK_ROWS = 100_000


def join_inner(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "inner")


def join_left(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left")


def join_semi(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), on, "left_semi")


def join_anti(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), on, "left_anti")


def key_grid(a: DataFrame, b: DataFrame, rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``a`` with every row of ``b``, as an equi-join of blocks.

    Both sides are hashed into blocks whose number follows their counted size;
    each row is copied once per block of the other side. A task holds one pair
    of blocks, so neither side is broadcast or gathered. Meant for key lists, whose product is the result.
    """
    na = a.agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("long").alias("_na"))
    nb = b.agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("long").alias("_nb"))
    size_a, size_b = F.greatest(na.scalar(), F.lit(1)), F.greatest(nb.scalar(), F.lit(1))
    left = a.withColumn("_i", F.pmod(F.xxhash64(*a.columns), size_a)).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), size_b - 1)))
    right = b.withColumn("_j", F.pmod(F.xxhash64(*b.columns), size_b)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), size_a - 1)))
    return left.join(right, ["_i", "_j"]).drop("_i", "_j")


def join_cross_combos(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of distinct keys, e.g. drug × mutation."""
    return key_grid(a.distinct(), b.distinct())


def complete_grid(df: DataFrame, first: list[str], second: list[str], value: str, fill=0) -> DataFrame:
    """All key combinations; missing ones get ``fill``."""
    grid = key_grid(df.select(*first).distinct(), df.select(*second).distinct())
    out = nsjoin(grid, df.select(*first, *second, value), [*first, *second], "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def join_barcode_fuzzy(a: DataFrame, b: DataFrame, barcode_a: str, barcode_b: str) -> DataFrame:
    """Match plates whatever the 9th character is (re-imaged plates)."""
    key = lambda c: F.concat(F.substring(c, 1, 8), F.substr(F.col(c), F.lit(10)))
    return a.withColumn("_k", key(barcode_a)).join(b.withColumn("_k", key(barcode_b)), "_k").drop("_k")


def join_interval_points(points: DataFrame, intervals: DataFrame, chrom: str, pos: str, start: str, stop: str, width: int | None = None) -> DataFrame:
    """Points strictly inside [start, stop] of the same chromosome.

    Intervals are copied to the position bins they touch, which makes it an equi-join. Bins are as wide as the mean
    interval, so that there are at most about two copies an interval and few points are compared in vain.
    """
    sound = intervals.where(F.col(stop) > F.col(start))
    if width is None:
        width = max(1, math.ceil(sound.agg(F.avg(F.col(stop) - F.col(start))).first()[0] or 1))
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    i = sound.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    return p.join(i, [chrom, "_bin"]).where((F.col(pos) > F.col(start)) & (F.col(pos) < F.col(stop))).drop("_bin")


def join_interval_count(intervals: DataFrame, reads: DataFrame, ids: list[str], chrom: str, start: str, stop: str,
                        read_start: str, read_stop: str, width: int = 10_000) -> DataFrame:
    """Reads that overlap each half-open interval, by counting instead of pairing.

    Overlaps = reads starting before the interval's stop minus reads ending at or
    before its start. Read ends are counted per position, so a deep region is reduced
    map-side; both are then numbers from one running sum over positions, bin by bin, in
    linear work. A bin has at most 2 * ``width`` rows.
    """
    both = lambda x, y: F.explode(F.array(
        F.struct(F.lit("s").alias("_kind"), x.cast("long").alias("_at")), F.struct(F.lit("e").alias("_kind"), y.cast("long").alias("_at"))))
    ends = reads.select(chrom, both(F.col(read_start), F.col(read_stop)).alias("_x")).select(chrom, "_x.*")
    at = ends.groupBy(chrom, "_kind", "_at").agg(F.count(F.lit(1)).alias("_c")).withColumn("_ask", F.lit(0))
    # reads starting before the stop, reads ending before start + 1
    asks = intervals.select(*ids, chrom, both(F.col(stop), F.col(start) + 1).alias("_x")).select(*ids, chrom, "_x.*")
    marks = asks.select(chrom, "_kind", "_at").distinct().select("*", F.lit(0).cast("long").alias("_c"), F.lit(1).alias("_ask"))
    cells = at.unionByName(marks).withColumn("_bin", F.floor(F.col("_at") / width))
    # positions asked for come before the ends there: the sum before one is what lies strictly below
    sums = running(cells, [chrom, "_kind"], "_bin", [F.col("_at").asc(), F.col("_ask").desc()], {"c": F.col("_c")})
    upto = nsjoin(asks, sums.where("_ask = 1").select(chrom, "_kind", "_at", "before_c"), [chrom, "_kind", "_at"])
    counts = upto.groupBy(*ids).agg(F.sum(F.when(F.col("_kind") == "s", F.col("before_c")).otherwise(-F.col("before_c"))).alias("count"))
    return nsjoin(intervals, counts, ids, "left")


def join_multi_fold(tables: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on), tables)


def join_keyed_bind(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Replacement for binding two tables by row position: join on the key and fail
    if either side has rows without a partner or a repeated key."""
    left, right = a.withColumn("_a", F.lit(1)), b.withColumn("_b", F.lit(1))
    keys = left.select(*on, "_a", F.lit(0).alias("_b")).unionByName(right.select(*on, F.lit(0).alias("_a"), "_b"))
    bad = keys.groupBy(*on).agg(F.sum("_a").alias("x"), F.sum("_b").alias("y")).where("x <> 1 OR y <> 1").agg(F.count(F.lit(1))).scalar()
    ok = F.when(bad == 0, F.lit(True)).otherwise(F.raise_error(F.lit("tables do not match one to one")).cast("boolean"))
    return a.join(b, on).where(ok)


def two_assay_merge(a: DataFrame, b: DataFrame, well: list[str], group: list[str], value_a: str, value_b: str) -> DataFrame:
    """Mean per well in each assay, merged by well, then means and well count per group."""
    ma = a.groupBy(*well, *group).agg(F.avg(value_a).alias("_a"))
    mb = b.groupBy(*well).agg(F.avg(value_b).alias("_b"))
    return ma.join(mb, well).groupBy(*group).agg(F.count(F.lit(1)).alias("wells"), F.avg("_a").alias(value_a), F.avg("_b").alias(value_b))
