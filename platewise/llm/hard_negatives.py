"""Hard-negative mining by exact integer scores.

Anchors and candidates are dealt into tiles by a hash of the id, and every anchor tile meets every
candidate tile in a task of its own. The task multiplies both by Strassen's seven-product recursion
on int64, padding odd sides with zeros, and keeps a bounded best list for each anchor: first of
the rows of its label, then, in a second multiplication, of the other rows within the score window of
each positive. Best lists of different tiles merge pairwise in any order, 64 at a time, so no
task holds more than 64 of them for an anchor. Scores are exact: additions and products are done in the
ring of 64-bit integers, and components are bounded so that every score fits.

Rows without id or label, without vector, or with a component that is null, not finite or too large for
an exact 64-bit score (``component_limit``) take no part. Shorter vectors count as padded with zeros; an
empty vector scores 0. Rows equal in id, label and vector count once; rows of one id with different
content are different rows, each an anchor if its id is one. Ties in score go to the smaller id. An anchor
without positives, a positive without negatives in its window, and an empty table return no rows. Long
vectors only make tiles heavier; further columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import pick
from platewise.session import cut_lineage

CANDIDATE_TILE = 4096  # rows, about
ANCHOR_TILE = 512
LEAF = 16  # a side that is no longer halved
FAN = 64  # best lists merged at once
NONE = np.iinfo(np.int64).min  # score of a pair that doesn't count


def component_limit(width: int) -> int:
    """Largest magnitude of a component for which a sum of ``width`` products fits a signed 64-bit integer."""
    return isqrt((2**63 - 1) // max(width, 1))


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b over int64 with seven products of halves where a plain split takes eight.

    Odd sides get a zero row or column. Intermediate sums may wrap around; the result is right
    wherever it fits, since 64-bit integers are a ring.
    """
    n, d = a.shape
    m = b.shape[1]
    if min(n, d, m) <= leaf:
        return a @ b
    a = np.pad(a, ((0, n % 2), (0, d % 2)))
    b = np.pad(b, ((0, d % 2), (0, m % 2)))
    r, k, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = p1 + p4 - p5 + p7
    out[:r, c:] = p3 + p5
    out[r:, :c] = p2 + p4
    out[r:, c:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros."""
    flat = vectors.combine_chunks()
    lengths = pc.list_value_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(flat), width), np.int64)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(flat)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def longest(table: pa.Table) -> int:
    return pc.max(pc.list_value_length(table["v"])).as_py() or 0


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest scores of each row, best first, ties by column."""
    n, m = scores.shape
    k = min(k, m)
    least = np.partition(scores, m - k, axis=1)[:, m - k]
    row, at = np.nonzero((scores >= least[:, None]) & (scores > NONE))
    order = np.lexsort((at, -scores[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k]


def tile_scores(anchors: pa.Table, rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates in order of id, their scores, which are of the anchor's label, which are the anchor itself."""
    rows = rows.take(pc.sort_indices(rows.select(["id", "rid"]), sort_keys=[("id", "ascending"), ("rid", "ascending")]))
    width = max(longest(anchors), longest(rows), 1)
    scores = strassen(matrix(anchors["v"], width), np.ascontiguousarray(matrix(rows["v"], width).T))
    labels = pa.chunked_array([*anchors["label"].chunks, *rows["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    same = labels[: len(anchors), None] == labels[None, len(anchors):]
    ids = pa.chunked_array([*anchors["id"].chunks, *rows["id"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    rid_a, rid_r = anchors["rid"].to_numpy(), rows["rid"].to_numpy()
    itself = (ids[: len(anchors), None] == ids[None, len(anchors):]) & (rid_a[:, None] == rid_r[None, :])
    return rows, scores, same, itself


def lists(rows: pa.Table, row: np.ndarray, at: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The rows that have a best list, and the lists; a list is sorted, lower first, by (-score, id, rid)."""
    owner, first = np.unique(row, return_index=True)
    picked = rows.take(pa.array(at))
    items = pa.StructArray.from_arrays([pa.array(-scores[row, at]), picked["id"].combine_chunks(), picked["rid"].combine_chunks()], ["low", "id", "rid"])
    return owner, pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), items)


def merged(heaps: DataFrame, keys: list[str], k: int, tiles: int) -> DataFrame:
    """One best list per key, from the lists of all tiles, FAN at a time."""
    while True:
        tile = F.floor(F.col("tile") / F.lit(FAN)).cast("int")
        heaps = heaps.groupBy(*keys, tile.alias("tile")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("heap"))), 1, k).alias("heap"))
        tiles = -(-tiles // FAN)
        if tiles <= 1:
            return heaps


def mine_negatives(
    df: DataFrame, is_anchor: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    relabel: Callable[[Column, Column], Column] | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` tells anchors by their id, ``relabel`` gives a label from id and label. A component x
    becomes floor(scale * x). A positive's negatives are the best rows of another label with
    low * positive_score <= 100 * score <= high * positive_score.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = pick(df, id=id_col, vector=vector_col, label=label_col)
    label = relabel(F.col("id"), F.col("label")) if relabel else F.col("label")
    x = F.transform("vector", lambda c: c.cast("double") * F.lit(float(scale)))
    fits = F.lit(float((2**63 - 1))) / F.greatest(F.size("x"), F.lit(1))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) + 1 < F.sqrt(fits)))
    rows = rows.select("id", label.cast("string").alias("label"), x.alias("x")).where("id is not null and label is not null and x is not null").where(sound)
    rows = rows.select("id", "label", F.transform("x", lambda c: F.floor(c)).alias("v")).dropDuplicates()
    rows = cut_lineage(rows.withColumn("rid", F.xxhash64("label", "v")))
    # a table of its own: a cogroup of two tables of one origin loses columns
    anchors = cut_lineage(rows.where(is_anchor(F.col("id"))))
    tiles, groups = max(1, -(-rows.count() // CANDIDATE_TILE)), max(1, -(-anchors.count() // ANCHOR_TILE))

    def every(name: str, parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)

    def dealt(table: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "rid", F.lit(own)), F.lit(parts)).cast("int").alias(own)
        return table.select("*", mine, every(other, copies)).groupBy("tile", "part")

    candidates = dealt(rows, "tile", tiles, "part", groups)

    def first_lists(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return POSITIVES.empty_table()
        found, scores, same, itself = tile_scores(left, right)
        scores = np.where(same & ~itself, scores, NONE)
        owner, heap = lists(found, *best(scores, positives), scores)
        who = left.take(pa.array(owner))
        return pa.table([who["id"], who["rid"], pa.array(np.full(len(owner), right["tile"][0].as_py(), np.int32)), heap], schema=POSITIVES)

    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]
    item = pa.list_(pa.struct([("low", pa.int64()), ("id", arrow_id), ("rid", pa.int64())]))
    heap_type = f"array<struct<low: long, id: {kind}, rid: long>>"
    POSITIVES = pa.schema([("a", arrow_id), ("arid", pa.int64()), ("tile", pa.int32()), ("heap", item)])
    NEGATIVES = pa.schema([("a", arrow_id), ("arid", pa.int64()), ("place", pa.int32()), ("tile", pa.int32()), ("heap", item)])

    heaps = dealt(anchors, "part", groups, "tile", tiles).cogroup(candidates).applyInArrow(first_lists, f"a {kind}, arid long, tile int, heap {heap_type}")
    first = cut_lineage(merged(heaps, ["a", "arid"], positives, tiles).drop("tile"))
    known = anchors.join(first.select(F.col("a").alias("id"), F.col("arid").alias("rid"), F.transform("heap", lambda h: -h["low"]).alias("found")), ["id", "rid"])

    def window_lists(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return NEGATIVES.empty_table()
        found, scores, same, _ = tile_scores(left, right)
        scores[same] = NONE
        goals = left["found"].to_pylist()
        out = []
        for place in range(positives):
            # in whole numbers: low * p <= 100 * s <= high * p
            span = [(-(-low * g[place] // 100), high * g[place] // 100) if place < len(g) else (1, 0) for g in goals]
            lo, hi = (np.array(x, np.int64)[:, None] for x in zip(*span, strict=True))
            inside = np.where((scores >= lo) & (scores <= hi), scores, NONE)
            owner, heap = lists(found, *best(inside, negatives), inside)
            who = left.take(pa.array(owner))
            fill = np.full(len(owner), 1, np.int32)
            out.append(pa.table([who["id"], who["rid"], pa.array(fill * place), pa.array(fill * right["tile"][0].as_py()), heap], schema=NEGATIVES))
        return pa.concat_tables(out)

    heaps = dealt(known, "part", groups, "tile", tiles).cogroup(candidates).applyInArrow(window_lists, f"a {kind}, arid long, place int, tile int, heap {heap_type}")
    last = merged(heaps, ["a", "arid", "place"], negatives, tiles)
    pairs = first.select("a", "arid", F.posexplode("heap").alias("place", "p")).join(last, ["a", "arid", "place"])
    each = pairs.select(F.col("a").alias("anchor_id"), F.col("p.id").alias("positive_id"), (-F.col("p.low")).alias("positive_score"), F.posexplode("heap").alias("place", "n"))
    return each.select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        "positive_score", (-F.col("n.low")).alias("negative_score"),
    )
