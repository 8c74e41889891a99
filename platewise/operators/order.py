"""Exact order statistics that survive a hot group.

Medians, ranks, running sums and row numbers inside a group are normally one
window (or one aggregate buffer) per group, so a group that holds a third of
all rows ends in one task. Here

* quantiles come from ``radix``: blocks of rows for groups that fit a task,
  digit histograms for larger ones;
* ranks and running sums cut the order axis into buckets, sort inside
  (group, bucket) and add the offset of the buckets before.

Results are exact in both cases.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.expr import hash_text, nsjoin
from platewise.operators.radix import named_statistics

SKETCH_ACCURACY = 10_000
BUCKETS = 4096  # most pieces the order axis is cut into
ROWS_PER_BUCKET = 50_000
TEXT_CUTS = 128  # pieces of a text column's order


def _mid(name: str) -> str:
    return f"_run_{name}"


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], count_as: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group (numpy / R type 7), see ``radix``.

    Null and NaN values are left out, and groups without another. The result, one row per group, is
    written once so that its users do not repeat the passes.
    """
    return _one_feature(df, keys, value, probs, None, 1.0, count_as)


def _one_feature(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], spread: str | None, scale: float, count_as: str | None) -> DataFrame:
    gk = list(keys) or ["_all"]
    src = (df if keys else df.withColumn("_all", F.lit(0))).select(*gk, F.col(value).cast("double").alias("_v"))
    out = named_statistics(src.where(F.col("_v").isNotNull() & ~F.isnan("_v")), gk, ["_v"], probs, spread, scale, count_as)
    return out.select(*keys, *[F.col(f"{n}__v").alias(n) for n in [*probs, *([spread] if spread else []), *([count_as] if count_as else [])]])


def group_median(df: DataFrame, keys: list[str], value: str, name: str = "median", count_as: str | None = None) -> DataFrame:
    return group_quantiles(df, keys, value, {name: 0.5}, count_as)


def group_median_mad(df: DataFrame, keys: list[str], value: str, median: str = "median", mad: str = "mad",
                     count_as: str | None = None, scale: float = 1.0) -> DataFrame:
    """Median and median absolute deviation (raw unless ``scale`` is given)."""
    return _one_feature(df, keys, value, {median: 0.5}, mad, scale, count_as)


def cut_points(df: DataFrame, value: str) -> list[float]:
    """Ascending cut points of a whole column, at most BUCKETS of them, from one sketch.

    Their number follows the row count; a small column gets none. A value that
    fills several buckets is repeated.
    """
    x = F.col(value).cast("double")
    marks = [(i + 0.5) / BUCKETS for i in range(BUCKETS)]
    n, cuts = df.agg(F.count(x), F.percentile_approx(x, marks, SKETCH_ACCURACY)).first()
    wanted = min(BUCKETS, n // ROWS_PER_BUCKET)
    if wanted < 2:
        return []
    return [c for c in cuts[:: BUCKETS // wanted] if not math.isnan(c)]


def one_bucket(column: str) -> Column:
    """0 for every row, as a column Spark keeps as an ordinary join key."""
    return F.pmod(F.hash(F.col(column)), F.lit(1))


def order_bucket(df: DataFrame, value: str, name: str = "_b", cuts: list[float] | None = None) -> DataFrame:
    """Monotone bucket number of a numeric column: how many cut points are at or below it.

    A group's share of a bucket is at most the bucket's rows, so hot groups are cut
    as finely as the column.
    """
    cuts = sorted(set(cut_points(df, value) if cuts is None else cuts))
    x = F.col(value).cast("double")
    if len(cuts) < 2:
        return df.withColumn(name, one_bucket(value))
    split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_x", outputCol="_bx", handleInvalid="keep")
    return split.transform(df.withColumn("_x", x)).withColumn(name, F.when(x.isNull(), -1).otherwise(F.col("_bx").cast("int"))).drop("_x", "_bx")


def text_bucket(df: DataFrame, value: str, name: str = "_b") -> DataFrame:
    """Monotone bucket number of a text column: how many of TEXT_CUTS sampled values are at or below it.

    Whole texts are compared, so a prefix that all values share doesn't matter. Where the
    cuts fall changes the work of a task only, never a result.
    """
    text = F.col(value).cast("string")
    sample = df.where(text.isNotNull()).select(text.alias("_x")).orderBy(F.rand(7)).limit(TEXT_CUTS * 8).collect()
    cuts = sorted(r["_x"] for r in sample)[7::8]
    if not cuts:
        return df.withColumn(name, one_bucket(value))
    return df.withColumn(name, F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= text)))


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: dict[str, Column],
            descending: bool = False) -> DataFrame:
    """Exclusive running sums and group totals per (keys), bucket by bucket.

    Adds ``before_<name>`` and ``total_<name>``. The window over ``keys`` sees one
    row per bucket; the window over rows sees one (keys, bucket) cell.
    """
    gk, src = list(keys), df
    for name, c in sums.items():
        src = src.withColumn(_mid(name), c)
    cells = src.groupBy(*gk, bucket).agg(*[F.sum(_mid(n)).alias(_mid(n)) for n in sums])
    b = F.col(bucket).desc() if descending else F.col(bucket).asc()
    whole = Window.partitionBy(*(gk or [F.lit(0)]))
    before = whole.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *gk, bucket,
        *[F.coalesce(F.sum(_mid(n)).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(_mid(n)).over(whole).alias(f"total_{n}") for n in sums],
    )
    inner = Window.partitionBy(*gk, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = src
    for n in sums:
        out = out.withColumn(f"_in_{n}", F.coalesce(F.sum(_mid(n)).over(inner), F.lit(0)))
    out = nsjoin(out, offsets, gk + [bucket])
    for n in sums:
        out = out.withColumn(f"before_{n}", F.col(f"_off_{n}") + F.col(f"_in_{n}"))
    return out.drop(*[_mid(n) for n in sums], *[f"_off_{n}" for n in sums], *[f"_in_{n}" for n in sums])


def value_order(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None,
                descending: bool = False) -> DataFrame:
    """One row per (keys, value): ``n`` rows, and what lies before it in order.

    Columns: keys, value, n, <sums>, before_n, total_n, before_<sum>, total_<sum>.
    Equal values collapse map-side, so a repeated value is one row.
    """
    sums = sums or {}
    src = df
    for name, c in sums.items():
        src = src.withColumn(f"_s_{name}", c)
    src = src.select(*keys, value, *[f"_s_{n}" for n in sums]).where(F.col(value).isNotNull())
    cells = order_bucket(src, value).groupBy(*keys, "_b", value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"_s_{n}").alias(n) for n in sums]
    )
    o = F.col(value).desc() if descending else F.col(value).asc()
    out = running(cells, keys, "_b", [o], {"n": F.col("n"), **{s: F.col(s) for s in sums}}, descending)
    return out.drop("_b")


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Adds the average rank of ``value`` in its group to each row."""
    ranks = value_order(df, keys, value).select(
        *keys, value, (F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)).alias(name)
    )
    return nsjoin(df, ranks, list(keys) + [value])


def row_order(df: DataFrame, keys: list[str], value: str, tie: list[str], name: str = "row_number",
              descending: bool = False, total_as: str | None = None) -> DataFrame:
    """Unique 1-based position by value, ties in md5 order of ``tie``.

    A value that fills several buckets shows as a repeated cut point. Its rows open
    their bucket and are spread over 4096 sub-buckets by leading md5 digits, so one
    value that holds a third of the table is still sorted in pieces.
    """
    cuts = cut_points(df, value)
    massed = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    src = order_bucket(df.withColumn("_t", hash_text(*tie)), value, cuts=cuts)
    hit = F.col(value).cast("double").isin(massed) if massed else F.lit(False)
    src = src.withColumn("_massed", F.coalesce(hit, F.lit(False)))
    piece = F.conv(F.substring("_t", 1, 3), 16, 10).cast("int")
    # ascending: the massed value is the smallest of its bucket; descending: it comes last
    if descending:
        src = src.withColumn("_b", F.col("_b") * 8192 + F.when(F.col("_massed"), F.lit(4095) - piece).otherwise(F.lit(4096)))
        order = [F.col(value).desc(), F.col("_t").asc()]
    else:
        src = src.withColumn("_b", F.col("_b") * 8192 + F.when(F.col("_massed"), piece).otherwise(F.lit(4096)))
        order = [F.col(value).asc(), F.col("_t").asc()]
    out = running(src.drop("_massed"), keys, "_b", order, {"one": F.lit(1).cast("long")}, descending)
    out = out.withColumn(name, F.col("before_one") + 1)
    if total_as:
        out = out.withColumn(total_as, F.col("total_one"))
    return out.drop("_b", "_t", "before_one", "total_one")


def hash_order(df: DataFrame, keys: list[str], ids: list[str], salt: str | Column = "", name: str = "row_number",
               total_as: str | None = None) -> DataFrame:
    """Unique 1-based position in md5 order of the ids: a reproducible shuffle.

    md5 digits are uniform, so their prefix is the bucket and no sketch is needed.
    """
    src = df.withColumn("_t", hash_text(*ids, salt=salt)).withColumn("_b", F.substring("_t", 1, 3))
    out = running(src, keys, "_b", [F.col("_t").asc()], {"one": F.lit(1).cast("long")})
    out = out.withColumn(name, F.col("before_one") + 1)
    if total_as:
        out = out.withColumn(total_as, F.col("total_one"))
    return out.drop("_b", "_t", "before_one", "total_one")


def bh_adjust(df: DataFrame, keys: list[str], p: str, name: str = "padj") -> DataFrame:
    """Benjamini–Hochberg: reverse running minimum of p·m/rank, bucket by bucket.

    Null p-values stay null and do not count in m.
    """
    gk = list(keys) or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    cells = order_bucket(src.select(*gk, p).where(F.col(p).isNotNull()), p).groupBy(*gk, "_b", p).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(cells, gk, "_b", [F.col(p).asc()], {"n": F.col("n")})
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("total_n") / (F.col("before_n") + F.col("n")))
    above = Window.partitionBy(*gk).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = ranked.groupBy(*gk, "_b").agg(F.min("_raw").alias("_m")).select(*gk, "_b", F.min("_m").over(above).alias("_later"))
    inner = Window.partitionBy(*gk, "_b").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    adj = nsjoin(ranked.withColumn("_here", F.min("_raw").over(inner)), later, gk + ["_b"])
    adj = adj.select(*gk, p, F.least(F.lit(1.0), "_here", "_later").alias(name))
    out = nsjoin(src, adj, gk + [p], "left")
    return out if keys else out.drop("_all")
