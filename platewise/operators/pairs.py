"""Matrices between rows or between features.

Row-by-row matrices (angles, distances between profiles) have every pair as
their result. They are computed block against block: rows are hashed into
blocks of bounded size, a task multiplies two blocks, and a threshold is applied
inside the task, so a graph never writes its missing edges. Feature-by-feature
matrices come from one mergeable pass of cross-product sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.expr import nsjoin, ratio
from platewise.session import cut_lineage

BLOCK = 1024
FLUSH_VALUES = 4_000_000


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    with np.errstate(all="ignore"):
        return np.degrees(np.arccos(np.clip((a @ b.T) / norm, -1.0, 1.0)))


def _euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        out[i] = np.sqrt(((b - a[i]) ** 2).sum(axis=1))
    return out


def _corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a - a.mean(axis=1, keepdims=True)
    y = b - b.mean(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])


METRICS = {"angle": _angle, "euclid": _euclid, "corr": _corr}


def block_pairs(df: DataFrame, keys: list[str], id_col: str, vector: str, metric: str,
                at_most: float | None = None, at_least: float | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, a, b, value) for all a < b of a group, or those within the bound.

    A group of n rows uses ceil(n/block) blocks; each row is copied once per
    block pair it takes part in, floats as floats. Tasks see at most two blocks, whatever n is.
    """
    gk = list(keys) or ["_all"]
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    src = (df if keys else df.withColumn("_all", F.lit(0))).select(*gk, F.col(id_col).alias("_id"), F.col(vector).cast(kind).alias("_v"))
    size = F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("_nb")
    sized = nsjoin(src, src.groupBy(*gk).agg(size), gk) if keys else src.withColumn("_nb", src.agg(size).scalar())
    own = sized.withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_nb")))
    spread = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    spread = spread.select(*gk, "_id", "_v", "_own", F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q"))
    types = {f.name: f.dataType.simpleString() for f in spread.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in gk) + f", a {types['_id']}, b {types['_id']}, value double"
    measure = METRICS[metric]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        ids, own_block = pdf["_id"].to_numpy(), pdf["_own"].to_numpy()
        mat = np.array(pdf["_v"].tolist(), dtype=float)
        p, q = pdf["_p"].iloc[0], pdf["_q"].iloc[0]
        i, j = np.flatnonzero(own_block == p), np.flatnonzero(own_block == q)
        if len(i) == 0 or len(j) == 0:
            return pd.DataFrame({k: [] for k in [*gk, "a", "b", "value"]}).astype({"value": float})
        m = measure(mat[i], mat[j])
        keep = np.isfinite(m)
        if p == q:
            keep &= np.triu(np.ones_like(keep, dtype=bool), 1)
        if at_most is not None:
            keep &= m <= at_most
        if at_least is not None:
            keep &= m >= at_least
        x, y = np.nonzero(keep)
        left, right = i[x], j[y]
        swap = left > right  # positions follow the sorted ids
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        out = pd.DataFrame({"a": ids[left], "b": ids[right], "value": m[x, y]})
        for k in gk:
            out[k] = pdf[k].iloc[0]
        return out[[*gk, "a", "b", "value"]]

    out = spread.groupBy(*gk, "_p", "_q").applyInPandas(run, schema)
    return out if keys else out.drop("_all")


def angle_matrix(df: DataFrame, keys: list[str], id_col: str, vector: str) -> DataFrame:
    return block_pairs(df, keys, id_col, vector, "angle").withColumnRenamed("value", "angle")


def angle_graph(df: DataFrame, keys: list[str], id_col: str, vector: str, limit: float = 45.0) -> DataFrame:
    """Edges with an angle of at most ``limit`` degrees; nodes without an edge do not occur."""
    return block_pairs(df, keys, id_col, vector, "angle", at_most=limit).select(*keys, F.col("a").alias("source"), F.col("b").alias("target"), F.col("value").alias("val"))


def graph_nodes(edges: DataFrame, keys: list[str]) -> DataFrame:
    ends = edges.select(*keys, F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))


def distance_matrix(df: DataFrame, keys: list[str], id_col: str, vector: str) -> DataFrame:
    return block_pairs(df, keys, id_col, vector, "euclid").withColumnRenamed("value", "distance")


def cross_products(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, i, j, s) with s = Σ x_i·x_j over the rows, for i <= j, where x_0 = 1.

    So s at (0, 0) is n and at (0, j) the sum of component j. Each task adds up
    its rows in numpy and hands over one partial sum per key; Spark adds those.
    """
    gk = list(keys) or ["_all"]
    src = (df if keys else df.withColumn("_all", F.lit(0))).select(*gk, F.col(vector).cast("array<double>").alias("_v"))
    types = {f.name: f.dataType.simpleString() for f in src.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in gk) + ", d int, flat array<double>"

    def partial(batches):
        sums: dict = {}

        def emit():
            if not sums:
                return None
            names = list(sums)
            out = pd.DataFrame(names, columns=gk)
            out["d"] = [sums[n].shape[0] for n in names]
            out["flat"] = [sums[n].ravel() for n in names]
            sums.clear()
            return out

        held = 0
        for pdf in batches:
            for name, rows in pdf.groupby(gk, sort=False, dropna=False):
                x = np.array(rows["_v"].tolist(), dtype=float)
                x = np.column_stack([np.ones(len(x)), x])
                g = x.T @ x
                if name in sums:
                    sums[name] += g
                else:
                    sums[name] = g
                    held += g.size
            if held > FLUSH_VALUES:
                held = 0
                yield emit()
        last = emit()
        if last is not None:
            yield last

    parts = src.mapInPandas(partial, schema)
    cells = parts.select(*gk, "d", F.posexplode("flat").alias("_p", "_x"))
    cells = cells.withColumn("i", F.floor(F.col("_p") / F.col("d")).cast("int")).withColumn("j", (F.col("_p") % F.col("d")).cast("int")).where("i <= j")
    out = cells.groupBy(*gk, "i", "j").agg(F.sum("_x").alias("s"))
    return out if keys else out.drop("_all")


def pair_moments(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, i, j, n, cov, sd_i, sd_j, corr) for i <= j, i from 1; population moments."""
    gk = list(keys) or ["_all"]
    s = cut_lineage(cross_products(df if keys else df.withColumn("_all", F.lit(0)), gk, vector))
    n = s.where("i = 0 AND j = 0").select(*gk, F.col("s").alias("n"))
    means = nsjoin(s.where("i = 0 AND j > 0").select(*gk, F.col("j").alias("_k"), F.col("s").alias("_s")), n, gk).withColumn("_m", F.col("_s") / F.col("n"))
    squares = s.where("i = j AND i > 0").select(*gk, F.col("i").alias("_k"), F.col("s").alias("_q"))
    one = nsjoin(means, squares, [*gk, "_k"]).select(*gk, "_k", "n", "_m", F.sqrt(F.greatest(F.col("_q") / F.col("n") - F.col("_m") * F.col("_m"), F.lit(0.0))).alias("_sd"))
    first = one.select(*gk, F.col("_k").alias("i"), "n", F.col("_m").alias("_mi"), F.col("_sd").alias("sd_i"))
    second = one.select(*gk, F.col("_k").alias("j"), F.col("_m").alias("_mj"), F.col("_sd").alias("sd_j"))
    pairs = nsjoin(nsjoin(s.where("i > 0"), first, [*gk, "i"]), second, [*gk, "j"])
    out = pairs.withColumn("cov", F.col("s") / F.col("n") - F.col("_mi") * F.col("_mj"))
    out = out.select(*gk, "i", "j", "n", "cov", "sd_i", "sd_j", ratio("cov", F.col("sd_i") * F.col("sd_j")).alias("corr"))
    return out if keys else out.drop("_all")


def corr_matrix(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Feature × feature correlation (i <= j)."""
    return pair_moments(df, keys, vector).select(*keys, "i", "j", "corr")
