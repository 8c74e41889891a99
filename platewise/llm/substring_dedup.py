"""Repeated passages by fixed-block anchors.

A window of ``width`` words holds at least one whole block of ``block`` words that begins at a
multiple of ``block`` in its text, if ``width >= 2 * block - 1``. So the non-overlapping blocks of
all texts are the index, and every rolling window of ``block`` words of all texts probes it:

1. Each task hashes the rolling windows of a chunk of texts and sends them, packed as arrays, to
   the bucket of their hash: blocks with their place, all others as bare hashes, each hash once.
   Blocks whose hash the chunk holds twice are anchors already, and their hash goes once without
   places. So a passage that a third of all texts share sends one hash for each chunk.
2. A bucket finds the blocks whose hash has come from elsewhere too: the other anchors.
3. Anchors are extended: every window of ``width`` words that holds an anchor of its own text is
   hashed and sent in the same way, now all with their places. Windows whose 64-bit hash is
   there twice are the repeats; their union in a text is its maximal repeated passages.

The buckets grow in number with the words, not in size. A task holds one bucket or one chunk.
Words are compared unchanged. Null and short texts have no window. A repeated row repeats its
windows, so all its copies lose them. Results hold for the input, not for what is left of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import U64, WordHashes, batch_of, column, covered, mixed, rolling, slices, texts, window_starts

BUCKET_WORDS = 1_000_000  # windows in a bucket, about
CHUNK_BYTES = 6 << 20  # text hashed by a task before it sends the entries
NAMES = ["probe_high", "probe_low", "k1", "k2", "runs", "gaps", "high", "low", "told"]
ENTRIES = "bucket int, " + ", ".join(f"{n} binary" for n in NAMES)
HITS = "part int, k1 binary, k2 binary, runs binary, gaps binary"
SENT = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in NAMES)])
FOUND = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in ("k1", "k2", "runs", "gaps"))])
PLACES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.binary())])


def split_at(groups: np.ndarray, *arrays: np.ndarray):
    """(group, part of each array) for sorted groups."""
    if not len(groups):
        return
    cut = np.flatnonzero(np.diff(groups)) + 1
    yield from zip(groups[np.concatenate([[0], cut])].tolist(), *(np.split(x, cut) for x in arrays), strict=True)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of rising values in the fewest bytes that hold them all."""
    gaps = np.diff(values, prepend=0)
    top = int(gaps.max(initial=0))
    return gaps.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def from_steps(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n]).astype(np.int64)


def halves(h: np.ndarray, exact: bool, rising: bool) -> tuple[bytes, bytes]:
    """High and low half of 64-bit hashes, or of 32-bit ones; the high half as steps if they rise."""
    bits, low = (32, np.uint32) if exact else (16, np.uint16)
    high = (h >> U64(bits)).astype(np.int64)
    return (steps(high) if rising else high.astype(low)).tobytes(), h.astype(low).tobytes()


def joined_halves(high: bytes, low: bytes, exact: bool, rising: bool) -> np.ndarray:
    bits, kind = (32, np.uint32) if exact else (16, np.uint16)
    low_ = np.frombuffer(low, kind)
    high_ = np.cumsum(from_steps(high, len(low_))) if rising else np.frombuffer(high, kind)
    return high_.astype(U64) << U64(bits) | low_


def pack(owner: np.ndarray, place: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> list[bytes]:
    """Places in order of their texts: the keys of the texts, places of each, gaps between places."""
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    gaps = np.diff(place, prepend=0)
    gaps[new] = place[new]
    top = int(gaps.max())
    gaps = gaps.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
    at = owner[new]
    return [k1[at].tobytes(), k2[at].tobytes(), np.diff(np.append(new, len(owner))).astype(np.uint32).tobytes(), gaps.tobytes()]


def unpack(row: dict) -> tuple[np.ndarray, ...]:
    """k1 and k2 of each text; text and place of each entry."""
    k1, k2 = np.frombuffer(row["k1"], np.int64), np.frombuffer(row["k2"], np.int64)
    runs = np.frombuffer(row["runs"], np.uint32).astype(np.int64)
    n = int(runs.sum())
    if not n:
        return k1, k2, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = from_steps(row["gaps"], n)
    owner = np.repeat(np.arange(len(runs)), runs)
    total = np.cumsum(gaps)
    first = np.cumsum(runs) - runs
    return k1, k2, owner, total - np.repeat(total[first] - gaps[first], runs)


def send(h: np.ndarray, owner: np.ndarray, place: np.ndarray, block: np.ndarray, k1: np.ndarray, k2: np.ndarray, buckets: int, exact: bool) -> pa.RecordBatch:
    """Rows of a chunk for the buckets: bare hashes, blocks with places, and blocks found twice in the chunk ("told").

    The upper half of a hash picks the bucket. If a later step verifies, only the lower half is
    sent: in a bucket of a million windows, some tens of blocks are anchors by mistake, at any size.
    """
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    sh = h[order]
    first = np.concatenate([[True], sh[1:] != sh[:-1]])
    alone = first & np.append(first[1:], True)
    placed = np.zeros(len(h), bool)
    placed[order] = alone
    placed &= block
    told = np.zeros(len(h), bool)
    told[order] = ~alone
    told &= block
    rows: dict[int, list[bytes]] = {}
    empty = [b""] * len(NAMES)
    sent = h if exact else h & U64(0xFFFFFFFF)
    bare = sh[first & ~placed[order]]
    bucket = (bare >> U64(32)) % U64(buckets)
    if not exact:
        bare = bare & U64(0xFFFFFFFF)
    by = np.lexsort((bare, bucket))
    for b, part in split_at(bucket[by], bare[by]):
        rows.setdefault(b, [*empty])[:2] = halves(part, exact, True)
    at = np.flatnonzero(placed)
    bucket = (h[at] >> U64(32)) % U64(buckets)
    by = np.argsort(bucket, kind="stable")
    for b, part in split_at(bucket[by], at[by]):
        rows.setdefault(b, [*empty])[2:8] = [*pack(owner[part], place[part], k1, k2), *halves(sent[part], exact, False)]
    out = [[b, *r] for b, r in rows.items()]
    at = np.flatnonzero(told)
    bucket = k1[owner[at]] % buckets
    by = np.argsort(bucket, kind="stable")
    for b, part in split_at(bucket[by], at[by]):
        out.append([b, b"", b"", *pack(owner[part], place[part], k1, k2), b"", b"", b"1"])
    cols = list(zip(*out, strict=True)) if out else [[]] * (len(NAMES) + 1)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, SENT, strict=True)], schema=SENT)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts with two 64-bit keys of (id, text): rows with the same keys are copies of each other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), text.cast("binary").alias("text"),
        F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(text, F.lit(7), F.col(id_col)).alias("k2"),
    )


def longs(part: pa.RecordBatch, name: str) -> np.ndarray:
    return column(part, name).to_numpy(zero_copy_only=False).astype(np.int64)


def probe_blocks(texts_: DataFrame, block: int, buckets: int) -> DataFrame:
    """Entries of all rolling windows."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                lists = [t.split() for t in texts(part)]
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                starts, owner = window_starts(counts, block)
                if not len(starts):
                    continue
                first = np.cumsum(counts) - counts
                h = rolling(hashes.all([w for ws in lists for w in ws]), block)[starts]
                place = starts - first[owner]
                k1, k2 = longs(part, "k1"), longs(part, "k2")
                yield send(h, owner, place, place % block == 0, k1, k2, buckets, False)

    return texts_.select("text", "k1", "k2").mapInArrow(run, ENTRIES)


def joined_parts(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """k1 and k2 of all texts of some packed rows; text and place of each entry."""
    parts = [unpack(r) for r in rows]
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    none = np.zeros(0, np.int64)
    k1, k2, place = (np.concatenate([none, *(p[i] for p in parts)]) for i in (0, 1, 3))
    return k1, k2, np.concatenate([none, *(p[2] + b for p, b in zip(parts, base, strict=False))]), place


def bucket_hits(entries: DataFrame, exact: bool, parts: int) -> DataFrame:
    """Places whose hash has come from another place too, and those a chunk has told, packed by parts of the texts."""

    def one(table: pa.Table) -> pa.Table:
        rows = table.select(NAMES).to_pylist()
        told = [r for r in rows if r["told"]]
        rows = [r for r in rows if not r["told"]]
        k1, k2, owner, place = joined_parts(rows)
        h = np.concatenate([np.zeros(0, U64), *(joined_halves(r["high"], r["low"], exact, False) for r in rows)])
        bare = np.sort(np.concatenate([np.zeros(0, U64), *(joined_halves(r["probe_high"], r["probe_low"], exact, True) for r in rows)]))
        order = np.argsort(h, kind="stable")
        sh = h[order]
        twice = np.zeros(len(h), bool)
        same = sh[1:] == sh[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        if len(bare):
            twice |= bare[np.minimum(np.searchsorted(bare, sh), len(bare) - 1)] == sh
        hit = np.zeros(len(h), bool)
        hit[order] = twice
        at = np.flatnonzero(hit)
        part = k1[owner[at]] % parts
        by = np.argsort(part, kind="stable")
        out = [[p, *pack(owner[i], place[i], k1, k2)] for p, i in split_at(part[by], at[by])]
        # told places came to the bucket that is their texts' part
        out += [[int(np.frombuffer(r["k1"], np.int64)[0]) % parts, r["k1"], r["k2"], r["runs"], r["gaps"]] for r in told]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, FOUND, strict=True)], schema=FOUND)

    return entries.groupBy("bucket").applyInArrow(one, HITS)


def by_text(hits: DataFrame) -> DataFrame:
    """One row per text with a hit: its keys and its places."""

    def one(table: pa.Table) -> pa.Table:
        k1, k2, owner, place = joined_parts(table.drop_columns(["part"]).to_pylist())
        order = np.lexsort((place, k2[owner], k1[owner]))
        owner, place = owner[order], place[order]
        a, b = k1[owner], k2[owner]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        at = [np.unique(p).astype(np.uint32).tobytes() for p in np.split(place, new[1:])] if len(new) else []
        return pa.table([pa.array(a[new]), pa.array(b[new]), pa.array(at, pa.binary())], schema=PLACES)

    return hits.groupBy("part").applyInArrow(one, "k1 long, k2 long, at binary")


def window_entries(joined: DataFrame, block: int, width: int, buckets: int) -> DataFrame:
    """Entries of the ``width``-word windows that hold an anchor. All go with their places."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                lists = [t.split() for t in texts(part)]
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                starts, owner = window_starts(counts, width)
                if not len(starts):
                    continue
                first = np.cumsum(counts) - counts
                marks = np.zeros(int(counts.sum()) + 1, np.int64)
                for i, anchors in enumerate(column(part, "at").to_pylist()):
                    marks[first[i] + np.frombuffer(anchors, np.uint32).astype(np.int64) + 1] = 1
                upto = np.cumsum(marks)
                inside = upto[starts + (width - block) + 1] > upto[starts]
                starts, owner = starts[inside], owner[inside]
                if not len(starts):
                    continue
                h = rolling(hashes.all([w for ws in lists for w in ws]), width)[starts]
                k1, k2 = longs(part, "k1"), longs(part, "k2")
                yield send(h, owner, starts - first[owner], np.ones(len(h), bool), k1, k2, buckets, True)

    return joined.mapInArrow(run, ENTRIES)


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """One row per text: id, n_words, n_removed, and the kept words as a digest or as ``kept_text``."""
    if width < 1:
        raise ValueError("a window has a word at least")
    block = (width + 1) // 2
    kind = docs.schema[id_col].dataType.simpleString()
    n_bytes = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    buckets = max(1, -(-n_bytes // (6 * BUCKET_WORDS)))
    rows = keyed(docs, id_col, text_col)
    entries = probe_blocks(rows, block, buckets)
    anchors = by_text(bucket_hits(entries, False, buckets))
    # both joins read the same columns of the texts, so Spark shuffles them once
    longer = window_entries(rows.join(anchors, ["k1", "k2"]).select("id", "text", "k1", "k2", "at"), block, width, buckets)
    repeats = by_text(bucket_hits(longer, True, buckets))
    joined = rows.join(repeats, ["k1", "k2"], "left").select("id", "text", "at")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
                for text, at in zip(texts(part), column(part, "at").to_pylist(), strict=True):
                    words = text.split()
                    gone = 0
                    if at:
                        hit = covered(np.frombuffer(at, np.uint32).astype(np.int64), width, len(words))
                        gone = int(hit.sum())
                        kept = b" ".join(w for w, x in zip(words, hit.tolist(), strict=True) if not x)
                    else:
                        kept = b" ".join(words)
                    out["n_words"].append(len(words))
                    out["n_removed"].append(gone)
                    out["kept"].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace"))
                ids = column(part, "id")
                yield batch_of(pa.schema([("id", ids.type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]), id=ids, **out)

    done = joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")
    return done.withColumnRenamed("id", id_col).withColumnRenamed("kept", "kept_sha256" if digest else "kept_text")
