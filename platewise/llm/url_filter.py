"""URL rules by a sorted digest array.

The keys of a rule list are hashed with 64-bit xxhash and sorted, with their strings beside them; a
Python worker maps these arrays into memory once. A task forms the possible keys of a batch of urls (every host suffix with every path prefix as long as some rule's), probes
all of them by one vectorised binary search and compares the stored string of each digest found,
so a collision can't match. The longest key that fits decides.

A list larger than ``block_rows`` is probed in blocks of that many keys, one pass for each, and
the longest match over the blocks decides, so neither the driver nor a task holds more.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end. Null urls and those without ``://`` have an empty host and
path and fit no rule. A rule is ``host`` + ``path`` with a path that starts with ``/``. Of rules given
twice for a key, ``block`` is used. Repeated rows are judged each.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import batch_of, once

BLOCK_ROWS = 2_000_000  # keys in one digest array: 16 MB of digests and their strings


def split_url(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(LOWER), path


LOWER = {i: i + 32 for i in range(65, 91)}


def digest_array(rules: list[tuple[str, str, str]]) -> dict[str, bytes]:
    """Sorted digests of the keys, the ends of their strings, the strings, their verdicts, and the lengths of the rules' paths."""
    best: dict[bytes, int] = {}
    for host, p, verdict in rules:
        key = (host + p).encode()
        best[key] = max(best.get(key, 0), int(verdict == "block"))
    keys = list(best)
    digest = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
    order = np.argsort(digest, kind="stable")
    keys = [keys[i] for i in order]
    return {
        "digests": digest[order].tobytes(), "ends": np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys))).tobytes(), "text": b"".join(keys),
        "block": np.array([best[k] for k in keys], np.uint8).tobytes(), "paths": np.array(sorted({len(p) for _, p, _ in rules}), np.int64).tobytes(),
    }


def mapped(data: bytes, dtype) -> np.ndarray:
    """The bytes as a memory-mapped array; the file has no name and goes with the map."""
    if not data:
        return np.zeros(0, dtype)
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return np.memmap(f, dtype, "r")


class DigestArray:
    """A worker's memory map of a digest array."""

    def __init__(self, files: dict[str, bytes]):
        self.digests, self.text = mapped(files["digests"], np.uint64), mapped(files["text"], np.uint8)
        self.ends, self.verdicts = mapped(files["ends"], np.int64), mapped(files["block"], np.uint8)
        self.path_lengths = np.frombuffer(files["paths"], np.int64).tolist()

    def stored(self, i: int) -> bytes:
        return self.text[self.ends[i - 1] if i else 0:self.ends[i]].tobytes()

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key, or -1. Digests that many keys share are all compared."""
        probe = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, probe)
        out = np.full(len(keys), -1, np.int64)
        inside = np.flatnonzero(at < len(self.digests))
        for j in inside[self.digests[at[inside]] == probe[inside]]:
            i = int(at[j])
            while i < len(self.digests) and self.digests[i] == probe[j]:
                if self.stored(i) == keys[j]:
                    out[j] = i
                    break
                i += 1
        return out


def candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Keys that could fit a url: the host and its parents with the path's prefixes, longest key first."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    heads = [path[:n] for n in lengths if n <= len(path)]
    return sorted(((h + p).encode() for h in hosts if h for p in heads), key=len, reverse=True)


def probe(urls: DataFrame, rules: list[tuple[str, str, str]], id_type: str) -> DataFrame:
    """Host, path and the longest fitting key with its verdict, for (id, url) rows."""
    files = urls.sparkSession.sparkContext.broadcast(digest_array(rules))  # of a bounded number of keys
    name = uuid.uuid4().hex

    def run(batches):
        found = once(name, lambda: DigestArray(files.value))
        for b in batches:
            split = [split_url(u) for u in b.column(1).to_pylist()]
            keys, owner = [], []
            for i, (host, path) in enumerate(split):
                for k in candidates(host, path, found.path_lengths):
                    keys.append(k)
                    owner.append(i)
            rule: list = [None] * len(split)
            verdict: list = [None] * len(split)
            at = found.find(keys)
            for j in np.flatnonzero(at >= 0):
                i = owner[j]
                if rule[i] is None:  # longest first
                    rule[i], verdict[i] = keys[j].decode(), "block" if found.verdicts[at[j]] else "allow"
            schema = pa.schema([("id", b.column(0).type), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
            yield batch_of(schema, id=b.column(0), host=[h for h, _ in split], path=[p for _, p in split], rule=rule, verdict=verdict)

    return urls.mapInArrow(run, f"id {id_type}, host string, path string, rule string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per url: id, host, path, rule (null if none fits) and verdict (``default`` without a rule).

    ``rules``: (host, path, verdict) tuples, or a DataFrame of such columns, read in blocks.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    if isinstance(rules, DataFrame):
        n = rules.count()
        blocks = max(1, -(-n // block_rows))
        numbered = rules.select("host", "path", "verdict", F.pmod(F.xxhash64("host", "path"), F.lit(blocks)).alias("block"))
        parts = ([tuple(r) for r in numbered.filter(F.col("block") == i).drop("block").collect()] for i in range(blocks))  # each of about block_rows
    else:
        blocks = max(1, -(-len(rules) // block_rows))
        parts = (rules[i * block_rows:(i + 1) * block_rows] for i in range(blocks))
    if blocks == 1:
        found = probe(urls, next(iter(parts), []), kind)
    else:
        keyed = urls.select(F.struct("id", F.monotonically_increasing_id().alias("row")).alias("id"), "url")
        inner = keyed.schema["id"].dataType.simpleString()
        whole = None
        for block in parts:
            part = probe(keyed, block, inner)
            whole = part if whole is None else whole.unionByName(part)
        found = (
            whole.groupBy("id").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule")))).alias("best"))
            .select(F.col("id.id").alias("id"), "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
        )
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default))).withColumnRenamed("id", id_col)
