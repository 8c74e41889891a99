"""Query registry and the binding of domain roles to the given tables.

line = supplier nation, plate = supplier, control = return flag N,
drug = part brand (or type), concentration = discount, replicate = line status,
features = quantity, price, tax; size = price; well = (supplier, part mod 384).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FEATURES = ["quantity", "price", "tax"]


class Tables:
    """The given parquet tables, read lazily by attribute, and role-bound views of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def objects(self) -> DataFrame:
        """One row per object with line, plate, drug and numeric features."""
        return (
            self.lineitem.join(self.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uuid"),
                F.col("s_nationkey").alias("line"),
                F.col("l_suppkey").alias("plate"),
                (F.col("l_partkey") % 384).alias("well"),
                F.col("l_partkey").alias("part"),
                F.col("p_brand").alias("drug"),
                F.col("p_type").alias("target"),
                F.col("l_discount").alias("conc"),
                F.col("l_linestatus").alias("rep"),
                (F.col("l_returnflag") == "N").alias("ctrl"),
                F.col("l_quantity").alias("quantity"),
                F.col("l_extendedprice").alias("price"),
                F.col("l_tax").alias("tax"),
            )
        )

    @cached_property
    def wells(self) -> DataFrame:
        """Lineitem without its dimension tables, for queries that need no line or drug."""
        return self.lineitem.select(
            F.col("l_suppkey").alias("plate"), (F.col("l_partkey") % 384).alias("well"), F.col("l_partkey").alias("part"),
            F.col("l_discount").alias("conc"), F.col("l_linestatus").alias("rep"), (F.col("l_returnflag") == "N").alias("ctrl"),
            F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Labelled documents with their length as a score."""
        return self.labels.join(self.documents.select("doc_id", "n_chars", "lang", "source"), "doc_id")


OBJ = """obj AS (
  SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS uuid,
         s_nationkey AS line, l_suppkey AS plate, l_partkey % 384 AS well, l_partkey AS part,
         p_brand AS drug, p_type AS target, l_discount AS conc, l_linestatus AS rep,
         l_returnflag = 'N' AS ctrl, l_quantity AS quantity, l_extendedprice AS price, l_tax AS tax
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""

LONG = OBJ + """, long AS (
  SELECT uuid, line, plate, well, drug, conc, rep, ctrl, 'quantity' AS feature, quantity AS value FROM obj
  UNION ALL SELECT uuid, line, plate, well, drug, conc, rep, ctrl, 'price', price FROM obj
  UNION ALL SELECT uuid, line, plate, well, drug, conc, rep, ctrl, 'tax', tax FROM obj)"""


def long_features(df: DataFrame, ids: list[str], features: list[str] | None = None) -> DataFrame:
    return df.unpivot(ids, features or FEATURES, "feature", "value")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under the operator's name, with its SQL if it has one."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        run.__name__ = f"run_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
