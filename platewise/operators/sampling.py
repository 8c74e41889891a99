"""Ranking, ordering, reproducible sampling and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.expr import hash_unit, nsjoin, with_group_stats
from platewise.operators.order import average_rank, hash_order, order_bucket, running, text_bucket


def number_in_group(df: DataFrame, keys: list[str], by: str, name: str, prefix: str | None = None) -> DataFrame:
    """1..n over the distinct values of ``by`` in each group, joined to all rows.

    The distinct (group, value) list is numbered, not the rows.
    """
    d = df.select(*keys, by).distinct()
    numeric = isinstance(df.schema[by].dataType, T.NumericType)
    d = order_bucket(d, by) if numeric else text_bucket(d, by)
    r = running(d, keys, "_b", [F.col(by).asc()], {"one": F.lit(1).cast("long")})
    n = F.col("before_one") + 1
    return nsjoin(df, r.select(*keys, by, (F.concat(F.lit(prefix), n.cast("string")) if prefix else n).alias(name)), [*keys, by])


def replicate_number(df: DataFrame, line: str, screen: str, name: str = "replicate") -> DataFrame:
    return number_in_group(df, [line], screen, name, "rep")


def time_index(df: DataFrame, keys: list[str], date: str, name: str = "time") -> DataFrame:
    return number_in_group(df, keys, date, name)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row by ``order`` as one min over a struct: mergeable, no window."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest).alias("_s"))
    return packed.groupBy(*keys).agg(F.min("_s").alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def top_n_ties(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that reach the group's maximum, ties kept."""
    return with_group_stats(df, keys, F.max(value).alias("_top")).where(F.col(value) == F.col("_top")).drop("_top")


def top_k_order(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def rank_transform(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    return average_rank(df, keys, value, name)


def sample_fraction(df: DataFrame, ids: list[str], fraction: float, seed: str = "") -> DataFrame:
    """Keep the rows whose key hashes below the fraction: repeatable, no shuffle."""
    return df.where(hash_unit(*ids, salt=seed) < fraction)


def sample_stratified(df: DataFrame, stratum: str, ids: list[str], fractions: dict, seed: str = "") -> DataFrame:
    share = F.coalesce(*[F.when(F.col(stratum) == k, F.lit(float(v))) for k, v in fractions.items()], F.lit(0.0))
    return df.where(hash_unit(*ids, salt=seed) < share)


def sample_per_group(df: DataFrame, keys: list[str], ids: list[str], n: int, seed: str = "") -> DataFrame:
    """n draws with replacement per group: draw i takes the row at shuffled position floor(u·size)+1."""
    ordered = hash_order(df, keys, ids, salt=seed, name="_i", total_as="_size")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = draws.withColumn("_i", F.floor(hash_unit(*keys, "draw", salt=seed) * F.col("_size")) + 1)
    return nsjoin(draws.select(*keys, "draw", "_i"), ordered.drop("_size"), [*keys, "_i"]).drop("_i")


def balanced_sample(df: DataFrame, keys: list[str], label: str, ids: list[str], seed: str = "") -> DataFrame:
    """The same number of rows of every class in each group, the smallest class's size."""
    sizes = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_s"))
    least = sizes.groupBy(*keys).agg(F.min("_s").alias("_least")) if keys else sizes.agg(F.min("_s").alias("_least"))
    ordered = hash_order(df, [*keys, label], ids, salt=seed, name="_i")
    out = nsjoin(ordered, least, keys) if keys else ordered.withColumn("_least", least.scalar())
    return out.where(F.col("_i") <= F.col("_least")).drop("_i", "_least")


def train_test_split(df: DataFrame, ids: list[str], train: float = 0.6, seed: str = "split", name: str = "split") -> DataFrame:
    return df.withColumn(name, F.when(hash_unit(*ids, salt=seed) < train, "train").otherwise("test"))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def in_every_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """Items that occur in all groups: the intersection over any number of tables in one pass."""
    groups = df.agg(F.count_distinct(group)).scalar()
    per = df.select(group, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    return per.where(F.col("_n") == groups).select(item)


def grid_bin_sample(df: DataFrame, x: str, y: str, digits: int, order: list[Column]) -> DataFrame:
    """Round 2-D coordinates to cells and keep one example per cell."""
    cells = df.withColumn("cell_x", F.round(x, digits) + F.lit(0.0)).withColumn("cell_y", F.round(y, digits) + F.lit(0.0))
    return first_per_group(cells, ["cell_x", "cell_y"], order)


def centroid_path(df: DataFrame, keys: list[str], step: str, x: str, y: str) -> DataFrame:
    """Mean position per step (concentration), in order."""
    return df.groupBy(*keys, step).agg(F.avg(x).alias(x), F.avg(y).alias(y)).orderBy(*keys, step)
