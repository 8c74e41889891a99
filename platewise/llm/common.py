"""Helpers of the text operators: Arrow batches in small slices, word hashes, rolling windows.

Shared conventions: a word is a maximal run of bytes other than space and 0x09 to 0x0D, which is
what ``bytes.split()`` gives; a null text counts as empty; only the named columns are read, so
other columns, whatever their names, never matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20  # text handled at once in a task
CACHE_WORDS = 300_000  # distinct words remembered in each of two generations
U64 = np.uint64
STEP = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``limit`` bytes of text each, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    n = len(col)
    if not n:
        return
    ends = np.cumsum(np.fromiter((len(v.as_buffer()) if v.is_valid else 0 for v in col), np.int64, n))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def arrow_map(df: DataFrame, columns: list, make: Callable, schema: str) -> DataFrame:
    """``make()`` runs once in each task and gives the function that maps slices to batches.

    The function gets a RecordBatch with the given columns, ``text`` among them as bytes, and
    returns an iterator of RecordBatches.
    """

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, "text"):
                yield from work(part)
        end = getattr(work, "end", None)
        if end is not None:
            yield from end()

    return df.select(*columns).mapInArrow(run, schema)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The columns called exactly ``old``, as ``new=old``, found by position.

    Spark matches names without regard to case, so a further column ``TEXT`` makes ``text``
    ambiguous; by position every other column is left out, whatever its name.
    """
    at = {new: df.columns.index(old) for new, old in columns.items()}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"_{i}"].alias(new) for new, i in at.items()])


def text_bytes(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias("text")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch) -> list[bytes]:
    return column(batch, "text").to_pylist()


class Remembered:
    """Values of words met before, in two generations of bounded size."""

    def __init__(self, limit: int = CACHE_WORDS):
        self.limit, self.now, self.before = limit, {}, {}

    def missing(self, wanted: set) -> set:
        """Those of the wanted keys whose values must be put into ``now``."""
        if len(self.now) + len(wanted) > self.limit:
            self.now, self.before = {}, self.now
        lack = wanted - self.now.keys()
        known = lack & self.before.keys()
        for w in known:
            self.now[w] = self.before[w]
        return lack - known


ONCE: dict = {}


def once(key, make: Callable):
    """An object that a Python worker builds once and keeps for its later tasks."""
    if key not in ONCE:
        ONCE.clear()
        ONCE[key] = make()
    return ONCE[key]


class WordHashes(dict):
    """64-bit hash of each word, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash mod 2**64 of every run of ``width`` values, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, block, size, mult = None, 0, h, 1, STEP
    while True:
        if width & size:
            part = block[done:done + n]
            out = part.copy() if out is None else out * U64(mult) + part
            done += size
        if size * 2 > width:
            return out
        block = block[:-size] * U64(mult) + block[size:]
        mult = mult * mult % 2**64
        size *= 2


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, in the joined words, of all windows inside one text, and the text of each."""
    counts = np.asarray(counts, np.int64)
    first = np.cumsum(counts) - counts
    have = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), have)
    inside = np.arange(int(have.sum())) - np.repeat(np.cumsum(have) - have, have)
    return first[owner] + inside, owner


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(schema, (columns[f.name] for f in schema), strict=True)], schema=schema)
