"""Near-duplicate lines by a segment-partition edit join.

Two lines are linked if at most ``tau`` edits of characters turn one into the other.

1. Every line is cut into ``tau + 1`` segments. If a line s of length n is within tau edits of a line
   r that is as long or up to tau longer, some segment of s stands in r unchanged, at one of few
   places that follow from both lengths. Each line sends hashes of its own segments (to be found)
   and of its substrings at those places for every length it may meet (to probe). A line that a task
   has met before sends nothing, so a common line sends once for each task.
2. Only keys with two different lines are looked at further, now with their texts.
3. The lines of a key are compared in one task, after filters on length and character counts, by a
   bit-parallel edit distance kept to a band of ``2 * tau + 1`` diagonals. A pair counts at the
   first of its common keys, so no list of pairs is needed to count links. A key of over ``GROUP``
   lines is dealt into blocks, and pairs of blocks are compared in tasks of their own.

A line of at most ``tau`` characters has no segment that must stay. Two such lines are always within
tau edits, so they are counted and not compared. A longer line within tau edits of one shares a
character with it, so their keys are single characters.

Classes are the connected components of the links. A line is stripped of white space at its ends;
lines without words are left out. Texts are told apart by 64-bit hashes. Null and empty texts have no lines. A repeated row
shares its lines' places, so each of its copies keeps the same lines.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import arrow_map, batch_of, column, text_bytes, texts
from platewise.llm.components import connected
from platewise.llm.near_dedup import row_key
from platewise.session import cut_lineage

TAU = 2
MIN_CHARS = 1  # the shortest line that is compared: every line with a word
GROUP = 256
MET = 200_000  # lines a task remembers
FOUND, PROBE, TINY = 1, 2, 4


def lines_of(text: bytes) -> list[tuple[int, bytes]]:
    """Number and stripped text of each line with a word."""
    return [(i, s) for i, line in enumerate(text.split(b"\n")) if (s := line.strip())]


def line_hash(line: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=100_000)
def segments(n: int, tau: int) -> tuple[tuple[int, int], ...]:
    """Start and length of the tau + 1 segments of a line of n characters."""
    size, longer = divmod(n, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        length = size + (i >= tau + 1 - longer)
        out.append((at, length))
        at += length
    return tuple(out)


def places(n: int, longer: int, i: int, tau: int) -> range:
    """Where segment i of a line of length n - longer can stand in a line of length n."""
    start, length = segments(n - longer, tau)[i]
    low = max(start - i, start + longer - (tau - i), 0)
    high = min(start + i, start + longer + (tau - i), n - length)
    return range(low, high + 1)


def key_of(n: int, i: int, part: str, tau: int) -> int:
    h = xxhash.xxh3_64_intdigest(part.encode(), n * (tau + 1) + i)
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=20_000)
def cuts(n: int, tau: int) -> tuple[tuple[int, int, int, int], ...]:
    """Start, end, seed of the hash and role of every part of a line of n characters that is a key."""
    if n <= tau:
        return *((i, i + 1, n * (tau + 1), FOUND) for i in range(n)), (0, n, n * (tau + 1) + 1, TINY)
    out = [(start, start + length, n * (tau + 1) + i, FOUND) for i, (start, length) in enumerate(segments(n, tau))]
    for m in range(n, n - tau - 1, -1):
        if m <= tau:
            out += [(i, i + 1, m * (tau + 1), PROBE) for i in range(n)]
            continue
        for i, (_, length) in enumerate(segments(m, tau)):
            out += [(at, at + length, m * (tau + 1) + i, PROBE) for at in places(n, n - m, i, tau)]
    return tuple(out)


def keys_of(line: str, tau: int) -> dict[int, int]:
    """Keys under which a line is found, probes, or both; a line of at most tau characters has one of its own too."""
    out: dict[int, int] = {}
    whole = line.encode() if line.isascii() else None
    for start, end, seed, role in cuts(len(line), tau):
        h = xxhash.xxh3_64_intdigest(line[start:end].encode() if whole is None else whole[start:end], seed)
        if h >> 63:
            h -= 1 << 64
        out[h] = out.get(h, 0) | role
    return out


def first_key(short: str, long: str, tau: int) -> int | None:
    """The first key at which the longer line probes the other, in order of segments and places."""
    n = len(long)
    if len(short) <= tau:
        return next((key_of(len(short), 0, c, tau) for c in short if n > tau and c in long), None)
    for i, (start, length) in enumerate(segments(len(short), tau)):
        part = short[start:start + length]
        for at in places(n, n - len(short), i, tau):
            if long[at:at + length] == part:
                return key_of(len(short), i, part, tau)
    return None


def within(a: np.ndarray, b: np.ndarray, tau: int) -> bool:
    """Whether at most tau edits turn a into b; common ends are cut off first."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > tau:
        return False
    n = len(a)
    differ = np.flatnonzero(a != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[head:] != b[len(b) - n + head:])
    tail = n - head - 1 - int(differ[-1]) if len(differ) else n - head
    a, b = a[head:n - tail], b[head:len(b) - tail]
    return banded_distance(a.tolist(), b.tolist(), tau) <= tau


def banded_distance(a: list[int], b: list[int], tau: int) -> int:
    """Edits from a to b, which is up to tau longer, by bit-vectors over a band of 2 * tau + 1 diagonals.

    In column j bit k stands for row j - tau + k, so the band moves down a row with each column. The
    distance is followed down the band's last diagonal and then along the last row. It is exact
    up to tau and more than tau otherwise.
    """
    rows, top = len(a), 2 * tau
    full = (2 << top) - 1
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i + tau
    vp, vn = full & full << tau, 0
    score = min(tau, rows)
    for j, c in enumerate(b):
        match = where.get(c, 0) >> j & full
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if j + 1 + tau <= rows:
            score += not d0 >> top & 1
        else:
            k = rows - j - 1 + tau
            score += (hp >> k & 1) - (hn >> k & 1)
        vp = hn | (full & ~((d0 >> 1) | hp))
        vn = (d0 >> 1) & hp
    return score


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line with a word: id, row key, line number, hash."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(part):
            lists = [lines_of(t) for t in texts(part)]
            take = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            ids = column(part, "id")
            schema = pa.schema([("id", ids.type), ("rid", pa.int64()), ("line_no", pa.int32()), ("v", pa.int64())])
            yield batch_of(schema, id=ids.take(pa.array(take)), rid=column(part, "rid").take(pa.array(take)), line_no=[i for x in lists for i, _ in x], v=[line_hash(s) for x in lists for _, s in x])

        return work

    cols = [F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rid"), text_bytes(text_col)]
    return arrow_map(docs, cols, make, f"id {kind}, rid long, line_no int, v long")


class Met(set):
    """Lines met by a task, forgotten now and then."""

    def new(self, v: int) -> bool:
        if v in self:
            return False
        if len(self) >= MET:
            self.clear()
        self.add(v)
        return True


def key_rows(docs: DataFrame, text_col: str, tau: int) -> DataFrame:
    def make():
        met = Met()

        def work(part):
            key, v, role = [], [], []
            for t in texts(part):
                for _, s in lines_of(t):
                    h = line_hash(s)
                    line = s.decode("utf-8", "replace")
                    if met.new(h):
                        found = keys_of(line, tau)
                        key += found.keys()
                        role += found.values()
                        v += [h] * len(found)
            yield batch_of(KEYS, key=key, v=v, role=role)

        return work

    return arrow_map(docs, [text_bytes(text_col)], make, "key long, v long, role tinyint")


KEYS = pa.schema([("key", pa.int64()), ("v", pa.int64()), ("role", pa.int8())])


def line_texts(docs: DataFrame, text_col: str) -> DataFrame:
    def make():
        met = Met()

        def work(part):
            got = {h: s for t in texts(part) for _, s in lines_of(t) if met.new(h := line_hash(s))}
            yield batch_of(pa.schema([("v", pa.int64()), ("line", pa.string())]), v=list(got), line=[s.decode("utf-8", "replace") for s in got.values()])

        return work

    return arrow_map(docs, [text_bytes(text_col)], make, "v long, line string")


def meeting_keys(keys: DataFrame) -> DataFrame:
    """Rows of the keys under which a line probes another, with the number of lines of the key; and those of tiny lines."""

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 3
        for b in with_end(batches):
            if b is not None:
                rest = [np.concatenate([r, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, r in enumerate(rest)]
                if not len(rest[0]):
                    continue
                end = int(np.searchsorted(rest[0], rest[0][-1]))  # the last key may go on
                done, rest = [r[:end] for r in rest], [r[end:] for r in rest]
            else:
                done = rest
            key, v, role = done
            if not len(key):
                continue
            # equal rows come from several tasks; roles of a line are the same in all
            order = np.lexsort((v, key))
            key, v, role = key[order], v[order], role[order]
            keep = np.concatenate([[True], (key[1:] != key[:-1]) | (v[1:] != v[:-1])])
            key, v, role = key[keep], v[keep], role[keep]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            roles = np.bitwise_or.reduceat(role, first)
            good = (size > 1) & (roles == FOUND | PROBE) | (roles == TINY)
            each = np.repeat(good, size)
            if each.any():
                yield batch_of(MEET, key=key[each], v=v[each], role=role[each].astype(np.int8), size=np.repeat(size, size)[each])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "key long, v long, role tinyint, size long")


MEET = pa.schema([*KEYS, ("size", pa.int64())])


def with_end(batches):
    yield from batches
    yield None


def histogram(line: np.ndarray) -> np.ndarray:
    return np.bincount(line % 61, minlength=61).astype(np.int16)


def links_of_key(rows: list[tuple], tau: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links counted at this node for each line, and enough of them to join their components.

    Rows: (key, node's blocks, block, v, role, line). Only pairs of the node's two blocks are compared.
    """
    count: dict[int, int] = {}
    links = []
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    coded = [np.frombuffer(r[5].encode("utf-32-le"), np.uint32) for r in rows]
    size = np.array([len(c) for c in coded])
    hist = np.stack([histogram(c) for c in coded])
    for i, (key, across, block, v, role, line) in enumerate(rows):
        near = (np.abs(size - size[i]) <= tau) & (np.abs(hist - hist[i]).sum(1) <= 2 * tau)
        near[:i + 1] = False
        for j in np.flatnonzero(near).tolist():
            _, _, other, w, role2, line2 = rows[j]
            if across and block == other:
                continue
            # the shorter line is found, the longer one probes; of equals the lesser hash is found
            swap = (len(line2), w) < (len(line), v)
            short, long = (line2, line) if swap else (line, line2)
            if not ((role2 if swap else role) & FOUND and (role if swap else role2) & PROBE):
                continue
            if within(coded[i], coded[j], tau) and first_key(short, long, tau) == key:
                count[v] = count.get(v, 0) + 1
                count[w] = count.get(w, 0) + 1
                a, b = find(i), find(j)
                if a != b:
                    root[a] = b
                    links.append((v, w))
    return count, links


OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def compare_keys(members: DataFrame, tau: int) -> DataFrame:
    """Rows (a, null, n): links of line a counted at a node; rows (a, b, null): links between components."""

    def run(batches):
        rows: list[tuple] = []
        node = None
        out: list[tuple] = []

        def finish():
            if len(rows) > 1:
                count, links = links_of_key(rows, tau)
                out.extend((v, None, n) for v, n in count.items())
                out.extend((a, b, None) for a, b in links)

        def flush():
            a, b, n = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
            out.clear()
            return batch_of(OUT, a=a, b=b, n=n)

        for batch in batches:
            for this, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != node:
                    finish()
                    rows, node = [], this
                rows.append(tuple(row))
            yield flush()
        finish()
        yield flush()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = members.select("node", "key", "across", "block", "v", "role", "line").repartition(parts, "node").sortWithinPartitions("node")
    return lined.mapInArrow(run, "a long, b long, n long")


def line_links(docs: DataFrame, tau: int = TAU, text_col: str = "text") -> DataFrame:
    """(v, class_id, n_links) of every line text that has a link."""
    every = cut_lineage(meeting_keys(key_rows(docs, text_col, tau)))
    tiny, meet = every.filter(F.col("role") == TINY).select("v"), every.filter(F.col("role") != TINY)
    # any two lines of at most tau characters are linked
    total = tiny.agg(F.count("*").alias("n"), F.min("v").alias("low")).first()
    lines = line_texts(docs, text_col).join(meet.select("v").distinct(), "v", "left_semi").dropDuplicates(["v"])
    blocks = F.ceil(F.col("size") / GROUP).cast("int")
    block = F.pmod(F.xxhash64("v"), blocks).cast("int")
    dealt = meet.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(
        F.when(blocks > 1, F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).otherwise(F.col("key")).alias("node"),
        "key", (F.col("block") != F.col("other")).alias("across"), "block", "v", "role",  # across: only pairs of two blocks are compared
    )
    found = compare_keys(dealt.join(lines, "v"), tau)
    if total["n"] > 1:
        links = F.array(F.struct(F.lit(None).cast("long").alias("b"), F.lit(total["n"] - 1).cast("long").alias("n")), F.struct(F.lit(total["low"]).cast("long").alias("b"), F.lit(None).cast("long").alias("n")))
        found = found.unionByName(tiny.select(F.col("v").alias("a"), F.explode(links).alias("x")).select("a", "x.*"))
    found = cut_lineage(found)
    label = connected(found.filter("b is not null").select("a", "b"))
    count = found.filter("n is not null").groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("n_links"))
    return count.join(label, "v").select("v", F.col("label").alias("class_id"), "n_links")


def dedup_lines(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: id, row key, line_no, class_id, n_links, and whether it is its class's first.

    The first is that of the least id, null before others, then of the least row key (a hash of id and
    text), so rows of one id with different texts don't both keep a line.
    """
    rows = line_rows(docs, id_col, text_col)
    links = cut_lineage(line_links(docs, tau, text_col))
    firsts = rows.groupBy("v").agg(F.min(F.struct("id", "rid", "line_no")).alias("first"))
    texts_ = firsts.join(links, "v", "left").select("v", F.coalesce("class_id", "v").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "first")
    best = texts_.groupBy("class_id").agg(F.min("first").alias("best"))
    classes = texts_.join(best, "class_id").select("v", "class_id", "n_links", "best")
    out = rows.join(classes, "v")
    kept = F.struct("id", "rid", "line_no").eqNullSafe(F.col("best"))
    return out.select(F.col("id").alias(id_col), "rid", "line_no", "class_id", "n_links", kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that are not their class's first, with all their columns.

    A document left without words goes.
    """
    names = docs.columns
    gone = dedup_lines(docs, tau, id_col, text_col).filter(~F.col("kept")).groupBy("rid").agg(F.collect_set("line_no").alias("gone"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, key = names.index(text_col), names.index(id_col)
    keyed = plain.withColumn("rid", row_key(f"c{key}", f"c{at}"))
    lines = F.split(F.col(f"c{at}"), "\n", -1)
    left = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(F.col("gone"), i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("gone").isNull(), F.col(f"c{at}")).otherwise(F.array_join(left, "\n"))
    out = keyed.join(gone, "rid", "left").withColumn(f"c{at}", text)
    return out.filter(F.col("gone").isNull() | F.col(f"c{at}").rlike(r"[^\x20\x09-\x0D]")).select(*plain.columns).toDF(*names)
