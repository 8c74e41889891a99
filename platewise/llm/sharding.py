"""Minimax contiguous sharding.

Rows with equal text form an atomic group; groups are ordered by a 64-bit hash of the text. The
smallest capacity for which greedy filling needs at most ``n_shards`` shards is found by binary
search, so the largest shard is as small as contiguous cuts allow. Within that capacity the order
is cut near equal shares of what is left: one group larger than a share doesn't starve the last shards.

Only the parts of the order in which a cut can fall are ever looked at closely. The driver holds
sums of hash ranges, splits the ranges that a cut of any still possible capacity may reach, and
sums those anew, until they are single groups: a bounded number of sums each time, at any size.

Texts that share a hash share a group, which only joins two groups. Null texts form a group of
their own with no bytes. Fewer groups than shards leave shards empty. Repeated rows are counted
each; slots follow no order within a shard but have no gaps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.session import cut_lineage

ROW_BYTES = 16
FIRST_BITS = 12  # the order starts as 2**12 ranges
MORE_BITS = 6  # a range that matters is split into 2**6
SLOT_ROWS = 50_000  # rows numbered by one task


def greedy_cuts(sums: np.ndarray, capacity: int, limit: int) -> list[int] | None:
    """First index of each shard but the first, or None if more than ``limit`` shards are needed."""
    ends = np.cumsum(sums)
    cuts, used = [], 0
    while True:
        stop = int(np.searchsorted(ends, used + capacity, side="right"))
        if stop >= len(sums):
            return cuts
        if (stop == 0 or ends[stop - 1] == used) and sums[stop] > capacity:
            return None
        cuts.append(stop)
        if len(cuts) >= limit:
            return None
        used = int(ends[stop - 1]) if stop else 0


def smallest_capacity(sums: np.ndarray, n_shards: int) -> int:
    """Binary search for the least capacity with which greedy filling gets along with n_shards."""
    low, high = max(int(sums.max(initial=0)), -(-int(sums.sum()) // n_shards)), int(sums.sum())
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sums, mid, n_shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def reachable(sums: np.ndarray, largest: np.ndarray, n_shards: int) -> np.ndarray:
    """Ranges in which a cut of the smallest capacity over single groups can fall."""
    ends = np.cumsum(sums)
    low = max(int(largest.max(initial=0)), -(-int(sums.sum()) // n_shards))
    high = smallest_capacity(sums, n_shards)
    out = np.zeros(len(sums), bool)
    early = late = 0  # a shard's start lies between these
    for _ in range(n_shards - 1):
        first = int(np.searchsorted(ends, early + low, side="right"))
        last = int(np.searchsorted(ends, late + high, side="right"))
        out[first:last + 1] = True
        early = int(ends[first - 1]) if first else 0
        late = min(late + high, int(ends[-1]))
    return out


def even_cuts(sums: np.ndarray, capacity: int, n_shards: int) -> tuple[list[int], list[int]]:
    """First index of each shard but the first, near equal shares and within the capacity; and the indices that decided.

    A cut leaves no more than the shards after it can hold, and takes no more than one can.
    """
    p = np.concatenate([[0], np.cumsum(sums)])
    n = len(sums)
    least = [n]  # where the last shards, each filled from the end, can begin at the earliest
    for _ in range(n_shards - 1):
        least.append(int(np.searchsorted(p, p[least[-1]] - capacity, side="left")))
    cuts, near, start = [], [], 0
    for left in range(n_shards, 1, -1):
        share = p[start] + (p[n] - p[start]) / left
        stop = int(np.searchsorted(p, share))
        near += [stop - 1, stop]
        if stop > 0 and stop <= n and share - p[stop - 1] < p[stop] - share:
            stop -= 1
        most = int(np.searchsorted(p, p[start] + capacity, side="right")) - 1
        near += [most, least[left - 1] - 1] if not least[left - 1] <= stop <= most else []
        start = min(max(stop, least[left - 1], start + 1), max(most, start), n)
        cuts.append(start)
    return cuts, [i for i in near if 0 <= i < n]


Range = tuple[int, int, int, int, int]  # start, bits below it, bytes, largest group, groups


def minimax_cuts(groups: DataFrame, n_shards: int) -> list[int]:
    """Keys at which shards but the first begin, for a table of (key, size). Fewer groups give fewer."""

    def summed(rows: DataFrame, shift: int) -> list[Range]:
        start = F.shiftleft(F.shiftright("key", shift), shift)
        got = rows.groupBy(start.alias("start")).agg(F.sum("size").alias("sum"), F.max("size").alias("largest"), F.count("*").alias("n")).collect()
        return sorted((r["start"], shift, r["sum"], r["largest"], r["n"]) for r in got)

    def refined(ranges: list[Range], hot: list[int]) -> list[Range]:
        """The ranges with those at ``hot`` split."""
        fresh: dict[int, list[Range]] = {}
        for old in sorted({ranges[i][1] for i in hot}):
            chosen = [i for i in hot if ranges[i][1] == old]
            wanted = groups.sparkSession.createDataFrame([(ranges[i][0],) for i in chosen], "start long")
            rows = groups.withColumn("start", F.shiftleft(F.shiftright("key", old), old)).join(wanted, "start", "left_semi").select("key", "size")
            starts = np.array([ranges[i][0] for i in chosen], np.int64)
            for part in summed(rows, max(0, old - MORE_BITS)):
                fresh.setdefault(chosen[int(np.searchsorted(starts, part[0], side="right")) - 1], []).append(part)
        return [x for i, r in enumerate(ranges) for x in (fresh.get(i) or [r])]

    ranges = summed(groups, 64 - FIRST_BITS)
    if not ranges:
        return []
    while True:
        sums, big = (np.array([r[k] for r in ranges], np.int64) for k in (2, 3))
        hot = [i for i in np.flatnonzero(reachable(sums, big, n_shards)).tolist() if ranges[i][4] > 1]
        if not hot:
            break
        ranges = refined(ranges, hot)
    capacity = smallest_capacity(sums, n_shards)
    while True:
        sums = np.array([r[2] for r in ranges], np.int64)
        cuts, near = even_cuts(sums, capacity, n_shards)
        hot = sorted({i for i in near if ranges[i][4] > 1})
        if not hot:
            break
        ranges = refined(ranges, hot)
    edges = np.concatenate([[0], np.cumsum(sums)])[[0, *cuts, len(sums)]]
    if np.diff(edges).max() > capacity:
        cuts = greedy_cuts(sums, capacity, n_shards)
    return [ranges[i][0] for i in cuts if i < len(ranges)]


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, shard and slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    thin = cut_lineage(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(raw).alias("crc"),
        F.xxhash64(F.col(text_col)).alias("key"), F.xxhash64(F.col(id_col), F.lit(1)).alias("mix"),
    ))
    groups = cut_lineage(thin.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    cuts = minimax_cuts(groups.select("key", "size"), n_shards)
    shard = sum([(F.col("key") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-rows // (n_shards * SLOT_ROWS)))
    placed = thin.select("id", "size", "crc", shard.alias("shard"), F.pmod("mix", F.lit(parts)).cast("int").alias("part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("shard", "part").agg(F.count("*").alias("rows")).select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "part").orderBy("id", "crc", "size")
    return (
        placed.withColumn("nth", F.row_number().over(own) - 1).join(offset, ["shard", "part"])
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("nth") + F.col("offset")).cast("long").alias("slot"))
    )
