"""Many random forests at once, grown level by level from histograms.

A forest belongs to a group of rows (a plate, a line) and a choice of features, and all forests of a table
grow together: features are cut into bins of their group once, and for each level one pass meets blocks of rows
with packs of trees, counts (node, feature, bin, label) in the task, and adds the counts up. The
best split of every node follows from the sums, so the number of jobs depends on the depth and not on
the number of groups, and neither a group nor a forest is gathered with all its rows.

Tree t weighs a row by a Poisson(1) draw from the hash of (row, t), the bootstrap of a stream; a node looks
at about the square root of the features, drawn by hash of (tree, node). Splits lower the Gini impurity most, the
first of equals. Rows whose features are not finite or whose label is null take no part in training.

A forest is kept as the nodes that its trees have (``NODES``), some dozens a tree; whole arrays of all places for nodes
(``TREE``) are made in the task that needs them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.expr import is_finite
from platewise.operators.newton import BLOCK_ROWS, DOUBLES, LONGS, PACK, Fields, added, ddl, in_block_rows, meet
from platewise.operators.order import SKETCH_ACCURACY
from platewise.session import cut_lineage

BINS = 32
DEPTH = 8
PACK_TREES = 10
SCORED = 4096  # rows that meet the trees of a pack at once
TREE = [*PACK, ("blocks", pa.int32()), ("trees", LONGS), ("allowed", LONGS), ("cuts", DOUBLES), ("feat", LONGS), ("bin", LONGS), ("value", DOUBLES), ("weight", DOUBLES)]
NODES = [*TREE[:TREE.index(("cuts", DOUBLES)) + 1], ("ends", LONGS), ("split", LONGS), ("value", DOUBLES), ("weight", DOUBLES)]
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def spread64(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of several whole numbers, broadcast against each other."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = h ^ (h >> np.uint64(32))
    return h


def looked_at(pack: dict, tree: int, nodes: np.ndarray) -> np.ndarray:
    """The features that each node of a tree may split by."""
    allowed = pack["allowed"].astype(np.int64)
    m = max(1, round(math.sqrt(len(allowed))))
    order = np.argsort(spread64(tree, nodes[:, None] + 1, allowed[None, :] + 1), axis=1, kind="stable")
    return allowed[order[:, :m]]


def binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many cut points of its feature lie below each value."""
    per = cuts.reshape(x.shape[1], -1)
    return np.stack([np.searchsorted(per[j], x[:, j], "left") for j in range(x.shape[1])], axis=1)


def active(feat: np.ndarray, level: int) -> np.ndarray:
    """Nodes of a level that exist: their parent was split."""
    nodes = np.arange(2**level - 1, 2 ** (level + 1) - 1)
    return nodes if level == 0 else nodes[feat[(nodes - 1) // 2] >= 0]


def descend(codes: np.ndarray, feat: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    """Node of every row after at most ``steps`` splits of one tree; children of i are 2i+1 and 2i+2."""
    node = np.zeros(len(codes), np.int64)
    rows = np.arange(len(codes))
    for _ in range(steps):
        f = feat[node]
        right = codes[rows, np.maximum(f, 0)] > cut[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def level_cells(codes: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, nodes: np.ndarray, looks: np.ndarray, level: int) -> np.ndarray:
    """Weighted counts (node of the level, feature looked at, bin, label) of one tree."""
    here = (node >= 2**level - 1) & (w > 0)
    at = np.searchsorted(nodes, node[here])
    seen = codes[here][np.arange(len(at))[:, None], looks[at]]
    m = looks.shape[1]
    cell = ((at[:, None] * m + np.arange(m)[None, :]) * BINS + seen) * 2 + y[here].astype(np.int64)[:, None]
    return np.bincount(cell.ravel(), np.repeat(w[here], m), len(nodes) * m * BINS * 2)


def tree_weights(r: np.ndarray, tree: int) -> np.ndarray:
    return np.searchsorted(POISSON, spread64(r, tree + 1) / 2.0**64).astype(float)


def level_counts(level: int):
    """Counts of a block for all trees of a pack."""

    def work(rows: dict, pack: dict) -> list[dict]:
        codes = binned(rows["x"], pack["cuts"])
        size = len(pack["feat"]) // len(pack["trees"])
        out = [np.zeros(0)]
        for t, tree in enumerate(pack["trees"].astype(np.int64)):
            feat, cut = (pack[c].astype(np.int64)[t * size:(t + 1) * size] for c in ("feat", "bin"))
            nodes = active(feat, level)
            if len(nodes):
                out.append(level_cells(codes, rows["y"], tree_weights(rows["r"], tree), descend(codes, feat, cut, level), nodes, looked_at(pack, int(tree), nodes), level))
        return [{"counts": np.concatenate(out)}]

    return work


def best_splits(counts: np.ndarray, looks: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1 for a leaf), bin, value and weight of nodes from their summed counts."""
    below = counts.reshape(len(looks), -1, BINS, 2).cumsum(axis=2)
    total = below[:, :, -1:, :]
    above = total - below
    n, n_l, n_r = total.sum(-1), below.sum(-1), above.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num((below**2).sum(-1) / n_l) + np.nan_to_num((above**2).sum(-1) / n_r) - np.nan_to_num((total**2).sum(-1) / n)
    gain = np.where((n_l >= least) & (n_r >= least), gain, 0.0).reshape(len(looks), -1)
    best, every = gain.argmax(axis=1), np.arange(len(looks))
    held = total[:, 0, 0, :]
    weight = held.sum(-1)
    value = np.where(weight > 0, held[:, 1] / np.maximum(weight, 1e-300), 0.5)
    return np.where(gain[every, best] > 1e-9, looks[every, best // BINS], -1), best % BINS, value, weight


def split_nodes(counts: np.ndarray, at: np.ndarray, looks: np.ndarray, least: float, feat: np.ndarray, cut: np.ndarray, value: np.ndarray, weight: np.ndarray) -> None:
    """Set the splits of a level's nodes of one tree from their summed counts."""
    f, b, value[at], weight[at] = best_splits(counts, looks, least)
    if at[-1] * 2 + 2 < len(feat):
        feat[at], cut[at] = f, b


def whole_trees(depth: int, least: float):
    """All levels of a pack's trees, all trees together, from the one block of their group."""
    size = 2 ** (depth + 1) - 1

    def work(rows: dict, pack: dict) -> list[dict]:
        codes, trees, y = binned(rows["x"], pack["cuts"]), pack["trees"].astype(np.int64), rows["y"].astype(np.int64)
        allowed = pack["allowed"].astype(np.int64)
        m = max(1, round(math.sqrt(len(allowed))))
        w = np.stack([tree_weights(rows["r"], t) for t in trees])
        feat, cut = np.full(len(trees) * size, -1, np.int64), np.zeros(len(trees) * size, np.int64)
        value, weight = np.full(len(trees) * size, 0.5), np.zeros(len(trees) * size)
        # draws of all trees: tree, row, place of the node
        tree, row = np.nonzero(w)
        w, place = w[tree, row], tree * size
        for level in range(depth + 1):
            there = np.bincount(place, minlength=len(feat)) > 0
            nodes = np.flatnonzero(there)
            if not len(nodes):
                break
            own = (there.cumsum() - 1)[place]
            of, number = trees[nodes // size], nodes % size
            order = np.argsort(spread64(of[:, None], number[:, None] + 1, allowed[None, :] + 1), axis=1, kind="stable")
            looks = allowed[order[:, :m]]
            cell = ((own[:, None] * m + np.arange(m)) * BINS + codes[row[:, None], looks[own]]) * 2 + y[row][:, None]
            f, b, value[nodes], weight[nodes] = best_splits(np.bincount(cell.ravel(), np.repeat(w, m), len(nodes) * m * BINS * 2), looks, least)
            if level == depth:
                break
            feat[nodes], cut[nodes] = f, b
            on = f[own] >= 0
            tree, row, w, own, place = tree[on], row[on], w[on], own[on], place[on]
            right = codes[row, f[own]] > b[own]
            place = tree * size + 2 * (place - tree * size) + 1 + right
        return [{"blocks": pack["blocks"], "trees": trees, "allowed": pack["allowed"], "cuts": pack["cuts"], **nodes_of(feat, cut, value, weight, len(trees))}]

    return work


def nodes_of(feat: np.ndarray, cut: np.ndarray, value: np.ndarray, weight: np.ndarray, n_trees: int) -> dict:
    """The nodes that trees have: place, feature and bin in one number, and where each tree ends."""
    there = (weight > 0).reshape(n_trees, -1)
    at = np.flatnonzero(there)
    return {"ends": there.sum(axis=1).cumsum(), "split": ((at % there.shape[1]) << 32) | ((feat[at] + 1) << 8) | cut[at], "value": value[at], "weight": weight[at]}


def places_of(pack: dict, size: int) -> dict:
    """Arrays (trees, places) of a pack's nodes; places without a node are leaves of one half."""
    ends, split = pack["ends"].astype(np.int64), pack["split"].astype(np.int64)
    at = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends))) * size + (split >> 32)
    out = {"feat": np.full(len(ends) * size, -1, np.int64), "bin": np.zeros(len(ends) * size, np.int64), "value": np.full(len(ends) * size, 0.5), "weight": np.zeros(len(ends) * size)}
    out["feat"][at], out["bin"][at], out["value"][at] = ((split >> 8) & 0xFFFFFF) - 1, split & 0xFF, pack["value"]
    if "weight" in pack:
        out["weight"][at] = pack["weight"]
    return out


def each_pack(packs: DataFrame, change, fields: Fields) -> DataFrame:
    """Every pack with the arrays that ``change`` makes of it."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pack = {c: np.asarray(v[i].values) if pa.types.is_list(v.type) else v[i].as_py() for c, v in zip(batch.schema.names, batch.columns, strict=True)}
                new = {**pack, **change(pack)}
                yield pa.RecordBatch.from_pylist([{n: new[n] for n, _ in fields}], schema=pa.schema(fields))

    return packs.mapInArrow(run, ddl(fields))


def split_level(packs: DataFrame, level: int, least: float) -> DataFrame:
    """Packs with the splits of one level, from the summed counts."""

    def split(pack: dict) -> dict:
        n_trees = len(pack["trees"])
        feat, cut, value, weight = (np.array(pack[c]).reshape(n_trees, -1) for c in ("feat", "bin", "value", "weight"))
        used = 0
        for t, tree in enumerate(pack["trees"].astype(np.int64)):
            at = active(feat[t], level)
            if not len(at):
                continue
            looks = looked_at(pack, int(tree), at)
            cells = len(at) * looks.shape[1] * BINS * 2
            split_nodes(pack["counts"][used:used + cells], at, looks, least, feat[t], cut[t], value[t], weight[t])
            used += cells
        return {"feat": feat.ravel(), "bin": cut.ravel(), "value": value.ravel(), "weight": weight.ravel()}

    return each_pack(packs.select(*[n for n, _ in TREE], "counts"), split, TREE)


def group_key(keys: list[str], ids: list[str] | None = None) -> Column:
    """One text for a group. Without keys the empty text, made of the ids so that Spark keeps it as a join key."""
    if keys:
        return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return F.substring(F.hex(F.xxhash64(*ids)), 1, 0) if ids else F.lit("")


def in_blocks(df: DataFrame, ids: list[str]) -> DataFrame:
    """Adds r, a hash of the ids, and the block of the group ``g``, with the group's number of blocks."""
    sizes = cut_lineage(df.groupBy("g").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")))
    return df.withColumn("r", F.xxhash64(*ids)).join(sizes, "g").withColumn("block", F.pmod("r", "blocks").cast("int"))


def grow_forests(train: DataFrame, keys: list[str], ids: list[str], features: list[str], label: Column, choices: DataFrame, trees: int = 100,
                 depth: int = DEPTH, least: float = 1.0, own: Column | None = None) -> DataFrame:
    """The forests of ``grow_nodes`` with an array of all places for nodes of every tree (``TREE``)."""
    return each_pack(grow_nodes(train, keys, ids, features, label, choices, trees, depth, least, own), lambda pack: places_of(pack, 2 ** (depth + 1) - 1), TREE)


def grow_nodes(train: DataFrame, keys: list[str], ids: list[str], features: list[str], label: Column, choices: DataFrame, trees: int = 100,
               depth: int = DEPTH, least: float = 1.0, own: Column | None = None) -> DataFrame:
    """One forest per (group, ``k``) of ``choices``, as packs of trees.

    choices: (g, k, allowed) with the positions of the features that a forest may use; one with none is not
    grown. All rows of a group train its forests, or, with ``own``, only those whose ``own`` is the forest's ``k``. Rows enter as often as they occur in ``train``; their ids tell the draws apart.
    """
    y = label.cast("int")
    sound = F.forall(F.array(*[F.col(f).cast("double") for f in features]), lambda v: v.isNotNull() & is_finite(v))
    rows = train.where(y.isNotNull() & sound).select(group_key(keys, ids).alias("g"), (F.lit(None) if own is None else own).cast("string").alias("k"), *ids, y.alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    flat = cut_lineage(in_blocks(rows, ids).select("g", "k", "block", "blocks", "r", "y", "x"))
    rows = in_block_rows(flat, ("r", "y", "x"))
    marks = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cuts = flat.groupBy("g").agg(F.first("blocks").alias("blocks"), F.flatten(F.array(*[F.percentile_approx(F.col("x")[i], marks, SKETCH_ACCURACY) for i in range(len(features))])).alias("cuts"))
    size = 2 ** (depth + 1) - 1
    packs = -(-trees // PACK_TREES)
    own = F.sequence(F.col("pack") * PACK_TREES, F.least(F.lit(trees), (F.col("pack") + 1) * PACK_TREES) - 1)
    blank = lambda v, kind: F.array_repeat(F.lit(v).cast(kind), F.size("trees") * size)
    state = choices.where(F.size("allowed") > 0).join(cuts, "g").withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).withColumn("trees", own.cast("array<long>"))
    state = cut_lineage(state.select("g", "k", "pack", "blocks", "trees", F.col("allowed").cast("array<long>").alias("allowed"), "cuts"))
    # a group of one block grows its trees in one pass; histograms of its levels would be larger than its rows
    grown = cut_lineage(meet(rows, state.where("blocks = 1"), whole_trees(depth, least), NODES, ("r", "y", "x")).select(*[n for n, _ in NODES]))
    state = state.where("blocks > 1")
    if state.isEmpty():
        return grown
    state = cut_lineage(state.select("*", blank(-1, "long").alias("feat"), blank(0, "long").alias("bin"), blank(0.5, "double").alias("value"), blank(0.0, "double").alias("weight")))
    for level in range(depth + 1):
        counts: Fields = [("counts", DOUBLES)]
        parts = cut_lineage(meet(rows, state, level_counts(level), [*PACK, *counts], ("r", "y", "x")))
        state = cut_lineage(split_level(state.join(added(parts, counts, []), ["g", "k", "pack"]), level, least))
    return grown.unionByName(cut_lineage(with_nodes(state)))


def with_nodes(forests: DataFrame) -> DataFrame:
    """Forests with whole arrays as ``NODES``."""
    return each_pack(forests, lambda p: nodes_of(*[np.asarray(p[c]).astype(t) for c, t in (("feat", np.int64), ("bin", np.int64), ("value", float), ("weight", float))], len(p["trees"])), NODES)


def score_forests(df: DataFrame, forests: DataFrame, keys: list[str], ids: list[str], features: list[str], name: str = "prob") -> DataFrame:
    """Every row with every forest of its group: all columns, ``k`` and the mean share of label 1 in the leaves reached.

    forests: as ``NODES`` or ``TREE``. Rows of a group without a forest are left out; values that are not finite count as the largest bin's.
    """
    forests = forests if "split" in forests.columns else with_nodes(forests)
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    left = in_blocks(df.withColumn("g", group_key(keys, ids)).withColumn("x", x), [*keys, *ids]).drop("r")
    blocks = left.groupBy("g").agg(F.first("blocks").alias("n_blocks"))
    right = cut_lineage(forests.select("g", "k", "cuts", "ends", "split", "value").join(blocks, "g")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    keep = [c for c in left.columns if c not in ("g", "x", "block", "blocks")]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "k string", f"{name} double"])

    def run(packs: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(packs) or not len(rows):
            return rows.select(keep).append_column("k", pa.nulls(len(rows), pa.string())).append_column(name, pa.nulls(len(rows), pa.float64())).slice(0, 0)
        values = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        total: dict[str, list] = {}
        codes = binned(values, np.asarray(packs["cuts"][0].values))
        for i in range(len(packs)):
            pack = {c: np.asarray(packs[c][i].values) for c in ("ends", "split", "value")}
            steps = int(pack["split"].max(initial=0) >> 32).bit_length()  # no node lies deeper
            size = 2 ** (steps + 1) - 1
            trees = places_of(pack, size)
            sums = total.setdefault(packs["k"][i].as_py(), [np.zeros(len(rows)), 0])
            first = np.arange(len(pack["ends"])) * size
            for at in range(0, len(rows), SCORED):
                some = codes[at:at + SCORED]
                place, each = np.repeat(first[None, :], len(some), axis=0), np.arange(len(some))[:, None]
                for _ in range(steps):
                    f = trees["feat"][place]
                    down = 2 * (place - first) + 1 + (some[each, np.maximum(f, 0)] > trees["bin"][place])
                    place = np.where(f >= 0, first + down, place)
                sums[0][at:at + SCORED] += trees["value"][place].sum(axis=1)
            sums[1] += len(first)
        parts = []
        for k, (sums, n) in total.items():
            parts.append(rows.select(keep).append_column("k", pa.array([k] * len(rows), pa.string())).append_column(name, pa.array(sums / n)))
        return pa.concat_tables(parts)

    return right.groupBy("g", "block").cogroup(left.groupBy("g", "block")).applyInArrow(run, schema)


def one_choice(keys_table: DataFrame, features: list[str]) -> DataFrame:
    """All features for every group of a table with column ``g``."""
    return keys_table.select("g").distinct().select("g", F.lit("all").alias("k"), F.array(*[F.lit(i) for i in range(len(features))]).alias("allowed"))
