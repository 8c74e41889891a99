"""Near-duplicate documents by a chosen-path set similarity join.

A text's set holds the hashes of its distinct shingles. Sets are equal for copies, so the join runs
over distinct sets. Of each set, minwise tokens under ``POSITIONS`` hash functions are kept.

* Each of ``trees`` independent trees sorts the sets into nodes by one minwise token. Two sets of
  similarity s meet in a node with probability s, so a pair is missed with (1 - s) ** trees:
  0.00001 at 0.85 with 6 trees, 0.00006 at 0.8.
* A node whose members are all in one component already is done; after the first tree that is
  nearly every node of true copies.
* A node of up to ``CHUNK`` sets is compared exhaustively, on the full sets, in one task; one of up
  to ``BLOCKS`` times that size in blocks, every two blocks in a task.
* A larger node is dealt into chunks. Each chunk is compared exhaustively and with the node's
  pivot, so a large group of copies becomes one component in linear work. If the node still
  holds several components, its members branch by a further token, chosen by the path so far.
* What is still larger than that and mixed after ``LEVELS`` tokens is compared in blocks too, exactly.

Links are found by intersection of the full sets of 64-bit shingle hashes, never from the tokens.
Only links between different components are reported, so copies are not expanded into pairs.

Null and empty texts have an empty set and link with nothing. A text of fewer words than a shingle
has its whole sequence as its one shingle. Rows may repeat; equal sets share a component. Ids may be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import U64, WordHashes, arrow_map, batch_of, column, mixed, once, rolling, text_bytes, texts
from platewise.llm.components import connected
from platewise.session import cut_lineage

POSITIONS = 24
CHUNK = 512
BLOCKS = 8
LEVELS = 6
MULTIPLIERS = [int(x) | 1 for x in mixed(np.arange(1, POSITIONS + 3, dtype=U64) * U64(0x9E3779B97F4A7C15))]


def shingle_sets(docs: list[bytes], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z lower-cased."""
    lists = [d.lower().split() for d in docs]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    h = hashes.all([w for ws in lists for w in ws])
    wide = mixed(rolling(h, width))
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(wide[at:at + n - width + 1]))
        elif n:
            out.append(mixed(rolling(h[at:at + n], n) + U64(n)))
        else:
            out.append(np.zeros(0, U64))
        at += n
    return out


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, row key, set key v (null for an empty set), set size and minwise tokens of each text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        hashes = once("shingles", WordHashes)

        def work(part):
            sets = shingle_sets(texts(part), width, hashes)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            ids = column(part, "id")
            v = np.zeros(len(sets), np.int64)
            tokens = np.zeros((len(sets), POSITIONS), np.int32)
            if len(full):
                first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                flat = np.concatenate([sets[i] for i in full])
                v[full] = (np.add.reduceat(mixed(flat * U64(MULTIPLIERS[-1])), first) + sizes[full].astype(U64) * U64(MULTIPLIERS[-2])).view(np.int64)
                for k in range(POSITIONS):
                    tokens[full, k] = (mixed(np.minimum.reduceat(flat * U64(MULTIPLIERS[k]), first)) >> U64(32)).astype(np.uint32).view(np.int32)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * POSITIONS)
            schema = pa.schema([("id", ids.type), ("rid", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int32()))])
            yield batch_of(schema, id=ids, rid=column(part, "rid"), v=pa.array(v, mask=sizes == 0), n=sizes, tokens=pa.ListArray.from_arrays(offsets, pa.array(tokens.ravel())))

        return work

    cols = [F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rid"), text_bytes(text_col)]
    return arrow_map(docs, cols, make, f"id {kind}, rid long, v long, n long, tokens array<int>")


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def linked(a: int, b: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def links_of_node(v: list[int], label: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components of a node, each confirmed on the full sets."""
    root = {x: x for x in label}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    n = len(v)
    sizes = [len(s) for s in sets]
    shared = None
    if n > 4:
        flat = np.concatenate(sets)
        token, back, times = np.unique(flat, return_inverse=True, return_counts=True)
        often = times > 1
        place = np.cumsum(often) - 1
        keep = often[back]
        rows, cols = np.repeat(np.arange(n), sizes)[keep], place[back[keep]]
        shared = np.zeros((n, n), np.int64)
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        for at in range(0, int(often.sum()), 16384):
            lo, hi = np.searchsorted(cols, [at, at + 16384])
            table = np.zeros((n, 16384), np.float32)
            table[rows[lo:hi], cols[lo:hi] - at] = 1
            shared += (table @ table.T).astype(np.int64)
    if shared is not None:
        size = np.array(sizes)
        near = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
        pairs = np.argwhere(np.tril(near, -1)).tolist()
    else:
        pairs = [(i, j) for i in range(n) for j in range(i) if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j])]
    least = dict(zip(label, v, strict=True))
    for x, y in zip(label, v, strict=True):
        least[x] = min(least[x], y)
    joined = False
    for i, j in pairs:
        a, b = find(label[i]), find(label[j])
        if a != b and (shared is not None or linked(sizes[i], sizes[j], len(np.intersect1d(sets[i], sets[j], assume_unique=True)), percent)):
            root[max(a, b)] = min(a, b)
            joined = True
    # one link from each old component to the first set of what it has become part of
    return [(least[x], least[find(x)]) for x in least if find(x) != x] if joined else []


def compare_nodes(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of all nodes: rows of a node (node, v, label, text) lie together, a node at a time."""

    def run(batches):
        hashes = once("shingles", WordHashes)
        rows: dict[int, tuple[int, bytes]] = {}
        node = None

        def finish():
            if len(rows) > 1 and len({x for x, _ in rows.values()}) > 1:
                vs = list(rows)
                sets: list[np.ndarray] = []
                part: list[bytes] = []
                for x in vs:  # texts may be long: a MB or so at a time
                    part.append(rows[x][1])
                    if x == vs[-1] or sum(map(len, part)) > 1 << 20:
                        sets += shingle_sets(part, width, hashes)
                        part = []
                return links_of_node(vs, [rows[x][0] for x in vs], sets, percent)
            return []

        found: list[tuple[int, int]] = []
        for b in batches:
            for key, v, label, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key != node:
                    found += finish()
                    rows, node = {}, key
                rows[v] = (label, text)
            if found:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=LINKS)
                found = []
        found += finish()
        yield pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=LINKS)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = members.select("node", "v", "label", "text").repartition(parts, "node").sortWithinPartitions("node")
    return lined.mapInArrow(run, "a long, b long")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_components(docs: DataFrame, percent: int = 85, width: int = 5, trees: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_shingles, component_id (the least id reachable) and kept."""
    sets, comp = components_of_sets(docs, percent, width, trees, id_col, text_col)
    least = sets.filter("v is not null").groupBy("v").agg(F.min("id").alias("id"))
    whole = least.join(comp, "v")
    comp = whole.join(whole.groupBy("label").agg(F.min("id").alias("component_id")), "label").select("v", "component_id")
    out = sets.select("id", "n", "v").join(comp, "v", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def components_of_sets(docs: DataFrame, percent: int, width: int, trees: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signatures of all texts, and (v, label) of every set: its component."""
    sets = cut_lineage(signatures(docs, width, id_col, text_col))
    one = cut_lineage(sets.filter("v is not null").groupBy("v").agg(F.min("rid").alias("rid"), F.first("tokens").alias("tokens")))
    key = lambda *parts: F.xxhash64(*parts)
    level1 = one.select("v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), key(t, F.element_at("tokens", t + 1)).alias("node")))).alias("x")).select("v", "x.*")
    met = level1.groupBy("tree", "node").agg(F.count("*").alias("n"), F.min("v").alias("pivot")).filter("n > 1")
    level1 = cut_lineage(level1.join(met.drop("n", "pivot"), ["tree", "node"]))
    # texts of the sets that meet any other; one copy of each is enough
    wanted = level1.select("v").distinct().join(one.select("v", "rid"), "v")
    source = docs.select(row_key(id_col, text_col).alias("rid"), text_bytes(text_col))
    store = cut_lineage(source.join(wanted, "rid").select("v", "text"))

    labels = links = None
    level, waiting = 1, None
    while True:
        # the first tree alone, then all others together with what the first left mixed
        nodes = level1.filter("tree = 0").select("node", "v") if level == 1 else level1.filter("tree > 0").select("node", "v") if level == 2 else None
        nodes = waiting if nodes is None else nodes if waiting is None else nodes.unionByName(waiting)
        if nodes is None:
            break
        lab = nodes.withColumn("label", F.col("v")) if labels is None else nodes.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
        lab = cut_lineage(lab.select("node", "v", "label"))
        mixed_nodes = cut_lineage(lab.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(F.xxhash64("v", "node").alias("h"), "v", "label")).alias("pivot")).filter("low < high").select("node", "size", "pivot"))
        if mixed_nodes.isEmpty():
            if level >= 2:
                break
            level += 1
            continue
        chunks = F.ceil(F.col("size") / CHUNK).cast("int")
        last = level > LEVELS
        large = chunks > (BLOCKS if not last else 1 << 30)
        member = lab.join(mixed_nodes, "node").withColumn("chunk", F.pmod(F.xxhash64("v"), chunks).cast("int"))
        # every pair of a node's chunks is a task; of a large node only the chunks are, each with the pivot
        others = F.when(large, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), chunks - 1))
        dealt = member.select("node", "v", "label", "chunk", F.explode(others).alias("other"), (chunks > 1).alias("split"))
        task = key("node", F.least("chunk", "other"), F.greatest("chunk", "other"), F.lit(-1))
        dealt = dealt.select(F.when(F.col("split"), task).otherwise(F.col("node")).alias("node"), "v", "label")
        if not last:
            pivots = mixed_nodes.filter(large).select("node", "pivot", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(-1).alias("other"))
            dealt = dealt.unionByName(pivots.select(task.alias("node"), "pivot.v", "pivot.label"))
        found = compare_nodes(dealt.join(store, "v"), width, percent)
        links = cut_lineage(found if links is None else links.unionByName(found))
        labels = cut_lineage(connected(links))
        big = mixed_nodes.filter(large).select("node") if not last else None
        if big is None or big.isEmpty():
            waiting = None
            if level >= 2:
                break
        else:
            onward = lab.select("node", "v").join(big, "node").join(one.select("v", "tokens"), "v")
            onward = onward.withColumn("at", F.pmod(key("node"), F.lit(POSITIONS - trees)).cast("int") + trees + 1)
            onward = onward.select(key("node", F.element_at("tokens", F.col("at"))).alias("node"), "v")
            waiting = cut_lineage(onward)
        level += 1
    every = one.select("v")
    if labels is None:
        return sets, every.withColumn("label", F.col("v"))
    return sets, every.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))


def keep_representatives(docs: DataFrame, percent: int = 80, width: int = 5, trees: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that of the least id, null ids last.

    Documents are told apart by id and text together. Of rows that repeat both, one stays. Texts
    without words are in no component and all stay.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, at = (f"c{names.index(c)}" for c in (id_col, text_col))
    sets, comp = components_of_sets(plain, percent, width, trees, key, at)
    rows = sets.filter("v is not null").groupBy("v", "rid").agg(F.min("id").alias("id"), F.count("*").alias("times")).join(comp, "v")
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "rid", "times")).alias("first")
    best = rows.groupBy("label").agg(first).select("first.rid", "first.times")
    judged = rows.select("rid").distinct().join(best, "rid", "left").filter("times is null or times > 1")
    judged = cut_lineage(judged.select(F.col("rid").alias("judged"), F.col("times").isNotNull().alias("repeats")))
    keyed = plain.withColumn("rid", row_key(key, at)).join(judged, F.col("rid") == F.col("judged"), "left")
    left = keyed.filter("judged is null")
    if not judged.filter("repeats").isEmpty():
        left = left.unionByName(keyed.filter("repeats").dropDuplicates(["rid"]))
    return left.select(*plain.columns).toDF(*names)
