"""Exact quantiles of many features per group, by one pass for most groups and digit histograms for the rest.

Rows stay wide: a row's features are one array. A task buffers rows, sorts them by group and sends each
group's rows on as one block, or just their number where it has met more than ``BLOCK_VALUES`` numbers of the group at a time.
Groups whose blocks are few enough to fit a task (``TASK_VALUES`` numbers) are finished there, all features and all groups of a batch by
the same sorted arrays; that covers medians and the deviations from them.

Larger groups never come together. Their values are read as 64-bit integers of the same order, and each
wanted rank is narrowed by digits of 22, 21 and 21 bits: a pass counts, in the task first, how many values
share a rank's leading bits and have which next digit. A histogram is bounded by the digit's range and adds up,
so the last digit gives the exact value. Deviations take three more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.expr import nsjoin
from platewise.session import cut_lineage

HELD_VALUES = 1_000_000  # numbers a task buffers
BLOCK_VALUES = 250_000  # numbers of one group that a task sends on as one block
TASK_VALUES = 2_000_000  # numbers of one group that a task finishes
SHIFTS = [42, 21, 0]  # bits left after each digit


def group_codes(columns: list[pa.Array | pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's group, and the first row of every group; null is a value like others."""
    code = None
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        own = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = own if code is None else np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    first, back = np.unique(code, return_index=True, return_inverse=True)[1:]
    return back, first


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def sorted_quantiles(v: np.ndarray, group: np.ndarray, n_groups: int, probs: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Number of valid values and quantiles (type 7) of one feature in every group."""
    n = np.bincount(group, ~np.isnan(v), n_groups).astype(np.int64)
    order = np.lexsort((v, group))  # NaN comes last in its group
    v = v[order]
    start = np.searchsorted(group[order], np.arange(n_groups))
    out = np.full((n_groups, len(probs)), np.nan)
    have = n > 0
    for i, p in enumerate(probs):
        pos = p * (n[have] - 1)
        k = np.floor(pos).astype(np.int64)
        low, high = v[start[have] + k], v[start[have] + np.ceil(pos).astype(np.int64)]
        # equal neighbours, infinite ones too, are their own mean
        with np.errstate(invalid="ignore"):
            out[have, i] = np.where(low == high, low, low + (high - low) * (pos - k))
    return n, out


def whole_groups(x: np.ndarray, group: np.ndarray, n_groups: int, probs: list[float], spread: bool) -> tuple[np.ndarray, np.ndarray]:
    """counts (groups, features) and statistics (groups, features, probs [+ 1]); the last is the median of |x - first quantile|."""
    width = x.shape[1]
    counts, stats = np.zeros((n_groups, width), np.int64), np.full((n_groups, width, len(probs) + spread), np.nan)
    for j in range(width):
        counts[:, j], stats[:, j, : len(probs)] = sorted_quantiles(x[:, j], group, n_groups, probs)
        if spread:
            with np.errstate(invalid="ignore"):
                away = np.abs(x[:, j] - stats[group, j, 0])
            stats[:, j, -1] = sorted_quantiles(away, group, n_groups, [0.5])[1][:, 0]
    return counts, stats


def key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def row_blocks(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, n, block): a group's rows of one task, or only their number where they are many."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held)
            code, first = group_codes([table[k] for k in keys])
            order = np.argsort(code, kind="stable")
            n = np.bincount(code, minlength=len(first))
            values = matrix(table["x"], width)[order]
            small = n * width <= BLOCK_VALUES
            # values of small groups only, as lists
            at = np.repeat(small, n)
            ends = np.concatenate([[0], np.cumsum(np.where(small, n * width, 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[at].ravel()), mask=pa.array(~small))
            who = table.select(keys).take(pa.array(first)).combine_chunks()
            held.clear()
            return pa.RecordBatch.from_arrays([*[who[k].combine_chunks() if isinstance(who[k], pa.ChunkedArray) else who[k] for k in keys], pa.array(n.astype(np.int64)), lists], names=[*keys, "n", "block"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows * width
            if size >= HELD_VALUES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return rows.mapInArrow(run, f"{key_schema(rows, keys)}, n long, block array<double>")


def finished(blocks: DataFrame, keys: list[str], width: int, probs: list[float], spread: bool) -> DataFrame:
    """Statistics of groups whose rows are all in blocks; the blocks of a group follow each other in a partition."""

    def run(batches: Iterator[pa.RecordBatch]):
        rest: pa.Table | None = None

        def result(table: pa.Table):
            code, first = group_codes([table[k] for k in keys])
            sizes = table["n"].to_numpy()
            counts, stats = whole_groups(matrix(table["block"], width), np.repeat(code, sizes), len(first), probs, spread)
            who = table.select(keys).take(pa.array(first)).combine_chunks()
            per = stats.shape[1] * stats.shape[2]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * step, pa.int32()), pa.array(flat)) for step, flat in ((width, counts.ravel()), (per, stats.ravel()))]
            return pa.RecordBatch.from_arrays([*[who[k].combine_chunks() if isinstance(who[k], pa.ChunkedArray) else who[k] for k in keys], *lists], names=[*keys, "counts", "stats"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            code, _ = group_codes([table[k] for k in keys])
            cut = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
            if cut:
                yield result(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield result(rest)

    ordered = blocks.select(*keys, "n", "block").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, f"{key_schema(blocks, keys)}, counts array<long>, stats array<double>")


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def from_bits(c: Column) -> Column:
    """The double of an ordered integer, inside the JVM."""
    bits = F.when(c < 0, c.bitwiseXOR(F.lit(2**63 - 1))).otherwise(c)
    sign, rest = F.when(bits < 0, -1.0).otherwise(1.0), bits.bitwiseAND(F.lit(2**63 - 1))
    power, fraction = F.shiftright(rest, 52), rest.bitwiseAND(F.lit(2**52 - 1)).cast("double")
    normal = (1.0 + fraction / 4503599627370496.0) * F.pow(F.lit(2.0), (power - 1023).cast("double"))
    tiny = fraction / 4503599627370496.0 * F.pow(F.lit(2.0), F.lit(-1022.0))
    return sign * F.when(power == 2047, F.lit(float("inf"))).when(power == 0, tiny).otherwise(normal) + F.lit(0.0)


def digit_counts(rows: DataFrame, keys: list[str], width: int, level: int) -> DataFrame:
    """(keys, f, digit, n): values that share a wanted rank's leading bits, by their next digit.

    rows: keys, x and, from the second digit on, ``lead``, the wanted leading bits per feature.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            u = ordered_bits(matrix(batch.column(batch.schema.get_field_index("x")), width))
            x = matrix(batch.column(batch.schema.get_field_index("x")), width)
            take = ~np.isnan(x)
            if level:
                lead = batch.column(batch.schema.get_field_index("lead")).flatten().to_numpy(zero_copy_only=False).reshape(len(x), width, -1)
                take &= ((u >> SHIFTS[level - 1])[:, :, None] == lead).any(axis=2)
            code, first = group_codes([batch.column(i) for i in range(len(keys))])
            row, f = np.nonzero(take)
            cell = np.stack([code[row], f, u[row, f] >> SHIFTS[level]], axis=1)
            order = np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0]))
            cell = cell[order]
            new = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(axis=1))[: len(cell)])
            n = np.diff(np.append(new, len(cell)))
            who = batch.select(keys).take(pa.array(first[cell[new, 0]]))
            yield pa.RecordBatch.from_arrays([*who.columns, pa.array(cell[new, 1].astype(np.int32)), pa.array(cell[new, 2]), pa.array(n.astype(np.int64))], names=[*keys, "f", "digit", "n"])

    each = rows.mapInArrow(run, f"{key_schema(rows, keys)}, f int, digit long, n long")
    return each.groupBy(*keys, "f", "digit").agg(F.sum("n").alias("n"))


def narrowed(rows: DataFrame, keys: list[str], width: int, probs: list[float]) -> DataFrame:
    """(keys, f, count, q0, q1, ...) of groups of any size, digit by digit."""
    cells = [*keys, "f"]
    wanted = None
    for level in range(len(SHIFTS)):
        src = rows.select(*keys, "x")
        if wanted is not None:
            lead = wanted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("f", "lead"))).alias("m"))
            # a feature without a valid value has no rank to narrow
            none = F.array_repeat(F.lit(2**62).cast("long"), 2 * len(probs))
            lead = lead.select(*keys, F.flatten(F.array(*[F.coalesce(F.try_element_at("m", F.lit(j)), none) for j in range(width)])).alias("lead"))
            src = nsjoin(src, cut_lineage(lead), keys)
        counts = digit_counts(src, keys, width, level)
        w = Window.partitionBy(*cells).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        if wanted is None:
            upto = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*cells)))
            pos = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
            ranks = F.array(*[r.cast("long") for p in pos for r in (F.floor(p), F.ceil(p))])
            upto = upto.withColumn("ranks", ranks)
            slots = upto.select(*cells, "digit", "n", "upto", "total", F.posexplode("ranks").alias("i", "rank"))
        else:
            # digits counted for several ranks of a feature belong to those that share the leading bits
            known = wanted.select(*cells, "total", F.posexplode(F.arrays_zip("lead", "rank")).alias("i", "z"))
            known = known.select(*cells, "total", "i", F.col("z.lead").alias("lead"), F.col("z.rank").alias("rank"))
            gap = SHIFTS[level - 1] - SHIFTS[level]
            own = nsjoin(known, counts.withColumn("lead", F.shiftright("digit", gap)), [*cells, "lead"])
            inside = Window.partitionBy(*cells, "i").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
            slots = own.withColumn("upto", F.sum("n").over(inside))
        hit = slots.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        hit = hit.select(*cells, "total", F.struct("i", F.col("digit").alias("lead"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).alias("z"))
        wanted = hit.groupBy(*cells).agg(F.first("total").alias("total"), F.array_sort(F.collect_list("z")).alias("z"))
        wanted = cut_lineage(wanted.select(*cells, "total", F.col("z.lead").alias("lead"), F.col("z.rank").alias("rank")))
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        low, high = from_bits(F.col("lead")[2 * i]), from_bits(F.col("lead")[2 * i + 1])
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos))).alias(f"q{i}"))
    return wanted.select(*cells, F.col("total").alias("count"), *out)


def group_statistics(df: DataFrame, keys: list[str], features: list[str], probs: list[float], spread: bool = False) -> DataFrame:
    """One row per group: keys, ``counts`` (valid values per feature) and ``stats``, an array per feature of its quantiles.

    With ``spread`` the median of the absolute deviations from the first quantile comes last. Null and NaN
    values are left out; a feature without any in a group has NaN statistics and a count of 0.
    """
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    return array_statistics(df.select(*keys, x.alias("x")), keys, len(features), probs, spread)


def array_statistics(rows: DataFrame, keys: list[str], width: int, probs: list[float], spread: bool = False) -> DataFrame:
    """The same for rows (keys, x) with an array of ``width`` doubles, NaN for null."""
    blocks = cut_lineage(row_blocks(rows, keys, width))
    sizes = blocks.groupBy(*keys).agg(F.sum("n").alias("n"), F.max(F.col("block").isNull()).alias("many"))
    large = cut_lineage(sizes.where((F.col("n") * width > TASK_VALUES) | F.col("many")).select(*keys))
    per = len(probs) + spread
    nested = lambda c: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.slice(c, i * per + 1, per))
    if large.isEmpty():
        out = finished(blocks, keys, width, probs, spread)
        return out.select(*keys, "counts", nested(F.col("stats")).alias("stats"))
    out = finished(without(blocks, large, keys), keys, width, probs, spread).select(*keys, "counts", nested(F.col("stats")).alias("stats"))
    wide = cut_lineage(nsjoin(rows, large, keys))
    q = narrowed(wide, keys, width, probs)
    if spread:
        centres = q.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("f", "q0"))).alias("m"))
        centre = cut_lineage(centres.select(*keys, F.array(*[F.coalesce(F.try_element_at("m", F.lit(j)), F.lit(float("nan"))) for j in range(width)]).alias("c")))
        away = nsjoin(wide, centre, keys).select(*keys, F.zip_with("x", "c", lambda a, b: F.abs(a - b)).alias("x"))
        mads = narrowed(away, keys, width, [0.5]).select(*keys, "f", F.col("q0").alias("spread"))
        q = nsjoin(q, mads, [*keys, "f"], "left")
    values = F.array(*[F.col(f"q{i}") for i in range(len(probs))], *([F.col("spread")] if spread else []))
    packed = q.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct(F.col("count").alias("n"), values.alias("v")).alias("s")))).alias("m"))
    packed = nsjoin(large, packed, keys, "left")
    at = lambda j: F.try_element_at("m", F.lit(j))
    empty = F.array_repeat(F.lit(float("nan")), per)
    packed = packed.select(*keys, F.array(*[F.coalesce(at(j)["n"], F.lit(0).cast("long")) for j in range(width)]).alias("counts"), F.array(*[F.coalesce(at(j)["v"], empty) for j in range(width)]).alias("stats"))
    return out.unionByName(packed)


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, null ones too, are not in the other table."""
    marked = nsjoin(df, other.withColumn("_in", F.lit(True)), keys, "left")
    return marked.where("_in is null").drop("_in")


def named_statistics(df: DataFrame, keys: list[str], features: list[str], probs: dict[str, float], spread: str | None = None, scale: float = 1.0, count_as: str | None = None) -> DataFrame:
    """One row per group with ``<name>_<feature>`` columns, written once; NaN statistics become null."""
    st = group_statistics(df, keys, features, list(probs.values()), spread is not None)
    value = lambda j, i: F.when(~F.isnan(F.col("stats")[j][i]), F.col("stats")[j][i])
    cols = [value(j, i).alias(f"{name}_{f}") for j, f in enumerate(features) for i, name in enumerate(probs)]
    if spread:
        cols += [(value(j, len(probs)) * F.lit(float(scale))).alias(f"{spread}_{f}") for j, f in enumerate(features)]
    if count_as:
        cols += [F.col("counts")[j].alias(f"{count_as}_{f}") for j, f in enumerate(features)]
    return cut_lineage(st.select(*keys, *cols))
