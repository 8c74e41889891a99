"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and runs of white space become one space. A benchmark item has a window of
``SPAN`` characters at every ``stride`` and at its end; a shorter item is one window. A document
leaks an item if one of its regions is within the window's edit budget e of a window of the item:
e = ``rate`` of its length, but at most what the lemma can bound. At a stride of 1 every excerpt
of ``SPAN`` characters is found, wherever it starts; a larger stride leaves excerpts out.

* Lemma: such a region shares at least ``n - q + 1 - q * e`` of the window's q-grams, on
  diagonals at most e apart. Shared q-grams are counted in bands of diagonals that overlap by e,
  so some band holds all of them. An item's q-grams are indexed once, and windows slide over its
  hits in a band.
* A window whose q-grams all stand on one diagonal is found as it is.
* Bands that reach the count are verified by an alignment kept to the band's diagonals, all
  candidates of a batch at once.

The items are the query set: they go to the tasks in blocks of ``BLOCK_CHARS``, one pass each,
so a benchmark of any size is met whole. With ``short``, items of fewer than ``MIN_CHARS`` characters
leak where they stand unchanged between characters that are not of a word; without, they leak nowhere.
Null and empty texts leak nothing. Repeated rows leak each.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from platewise.llm.common import U64, arrow_map, batch_of, column, once, rolling, slices, text_bytes, texts

Q = 12
SPAN = 96
MIN_CHARS = 32
BLOCK_CHARS = 2_000_000
BAND = 16  # diagonals between the starts of bands
BITS = 22


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def budget(n: int, rate: float) -> int:
    """Edits allowed in a window of n characters, so that at least one q-gram must be shared."""
    return min(int(rate * n), (n - Q) // Q)


class Windows:
    """The items of a block and the places of their q-grams, sorted by hash."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float, stride: int, short: bool):
        self.stride = stride
        self.ids = [i for i, _ in items]
        self.short: dict[int, dict[str, list[int]]] = {}  # length, text, items
        self.item, self.codes = [], []
        gram, item, place = [], [], []
        for number, (_, text) in enumerate(items):
            t = normal(text or "")
            if len(t) < MIN_CHARS:
                if short and t:
                    self.short.setdefault(len(t), {}).setdefault(t, []).append(number)
                continue
            c = codes(t)
            h = rolling(c.astype(U64), Q)
            gram.append(h)
            item.append(np.full(len(h), len(self.item)))
            place.append(np.arange(len(h)))
            self.item.append(number)
            self.codes.append(c)
        self.item = np.array(self.item, np.int64)
        self.lengths = np.array([len(c) for c in self.codes], np.int64)
        self.longest = int(self.lengths.max()) if len(self.lengths) else 0
        self.sizes = np.minimum(self.lengths, SPAN)
        self.budgets = np.array([budget(int(n), rate) for n in self.sizes], np.int64)
        self.needed = self.sizes - Q + 1 - Q * self.budgets
        none = np.zeros(0, np.int64)
        h = np.concatenate([none.astype(U64), *gram])
        order = np.argsort(h, kind="stable")
        self.owner, self.place = np.concatenate([none, *item])[order], np.concatenate([none, *place])[order]
        self.grams, self.first, self.times = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.slot(self.grams)] = True
        self.short_hashes = {n: np.sort(np.concatenate([rolling(codes(t).astype(U64), n) for t in ts])) for n, ts in self.short.items()}

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h * U64(0xD6E8FEB86659FD93)) >> U64(64 - BITS)

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item and item position of every shared q-gram."""
        h = rolling(text.astype(U64), Q)
        at = np.flatnonzero(self.seen[self.slot(h)])
        h = h[at]
        g = np.minimum(np.searchsorted(self.grams, h), max(0, len(self.grams) - 1))
        same = self.grams[g] == h if len(self.grams) else np.zeros(len(h), bool)
        at, g = at[same], g[same]
        times = self.times[g]
        entry = np.repeat(self.first[g], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(at, times), self.owner[entry], self.place[entry]


def banded(pattern: np.ndarray, text: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Least edits between each pattern and a part of its text, over ``width`` diagonals from the text's start.

    Rows are patterns, padded at the end. The text's row is padded with characters that match none.
    """
    rows, longest = pattern.shape
    k = np.arange(width)
    cost = np.zeros((rows, width), np.int32)
    out = np.where(size == 0, 0, np.iinfo(np.int32).max).astype(np.int32)
    for i in range(longest):
        across = cost + (text[:, i:i + width] != pattern[:, i:i + 1])
        across[:, :-1] = np.minimum(across[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(across - k, axis=1) + k
        out = np.where(size == i + 1, cost.min(axis=1), out)
    return out


def spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all numbers from low to high, both included, of each row."""
    n = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, low[row] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def full_windows(group: np.ndarray, item: np.ndarray, place: np.ndarray, windows: Windows, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, item and start of every window with ``least`` of its item's q-grams among the hits of a group.

    A group is one item's. Windows start at the stride or at the last start.
    """
    wide = windows.longest + SPAN
    x, order = np.unique(group * wide + place, return_index=True)  # a place counts once
    group, item, place = group[order], item[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(group)) - 1
    keep = last - first + 1 >= least[item[first]]
    first, last = first[keep], last[keep]
    i = item[first]
    end = windows.lengths[i] - windows.sizes[i]
    row, start = spans(np.maximum(place[first] - windows.sizes[i] + Q, 0), np.minimum(place[last], end))
    grid = (start % windows.stride == 0) | (start == end[row])
    row, start = row[grid], start[grid]
    base = group[first[row]] * wide + start
    count = np.searchsorted(x, base + windows.sizes[i[row]] - Q, side="right") - np.searchsorted(x, base)
    good = count >= least[i[row]]
    row = row[good]
    return group[first[row]], i[row], start[good]


def short_leaks(whole: np.ndarray, windows: Windows, first: np.ndarray, plain: list[str]) -> set[tuple[int, int]]:
    """(document, item) of the short items that stand unchanged between characters that are not of a word."""
    out = set()
    for n, hashes in windows.short_hashes.items():
        h = rolling(whole.astype(U64), n)
        g = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        at = np.flatnonzero(hashes[g] == h)
        owner = np.searchsorted(first, at, side="right") - 1
        for d, a in zip(owner.tolist(), (at - first[owner]).tolist(), strict=True):
            t = plain[d]
            if t[a:a + n] in windows.short[n] and not (a and t[a - 1].isalnum()) and not t[a + n:a + n + 1].isalnum():
                out.update((d, i) for i in windows.short[n][t[a:a + n]])
    return out


def leaks_in(docs: list[bytes], windows: Windows) -> list[tuple[int, int, int, int]]:
    """(document, item, windows found, least edits) for a list of texts."""
    plain = [normal(d.decode("utf-8", "replace")) for d in docs]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    # a separator of Q characters that no text has keeps q-grams inside their text
    gap = 0xFFFFFFFF
    whole = np.full(int(sizes.sum()) + Q * len(plain) + Q, gap, np.uint32)
    first = np.cumsum(sizes + Q) - sizes - Q
    for a, n, t in zip(first.tolist(), sizes.tolist(), plain, strict=True):
        whole[a:a + n] = codes(t)
    found: dict[tuple[int, int], dict[int, int]] = {}  # document and item: edits by start of the window
    for d, i in short_leaks(whole, windows, first, plain):
        found[d, i] = {0: 0}
    if len(windows.item):
        near_leaks(whole, first, len(plain), windows, gap, found)
    return [(d, i, len(x), min(x.values())) for (d, i), x in found.items()]


def near_leaks(whole: np.ndarray, first: np.ndarray, docs: int, windows: Windows, gap: int, found: dict) -> None:
    """Adds what the q-gram index finds."""
    at, item, place = windows.hits(whole)
    if not len(at):
        return
    items = len(windows.item)
    diagonal = at - place + windows.longest

    def note(middle, which, starts, edits):
        owner = np.clip(np.searchsorted(first, middle, side="right") - 1, 0, docs - 1)
        for d, w, s, e in zip(owner.tolist(), which.tolist(), starts.tolist(), edits.tolist(), strict=True):
            x = found.setdefault((d, int(windows.item[w])), {})
            x[s] = min(x.get(s, e), e)

    key, w, s = full_windows(diagonal * items + item, item, place, windows, windows.sizes - Q + 1)
    note(key // items - windows.longest + s + windows.sizes[w] // 2, w, s, np.zeros(len(w), np.int64))
    band = diagonal // BAND
    also = diagonal % BAND < windows.budgets[item]
    group = np.concatenate([band, band[also] - 1]) * items + np.concatenate([item, item[also]])
    key, which, starts = full_windows(group, np.concatenate([item, item[also]]), np.concatenate([place, place[also]]), windows, windows.needed)
    top = int(windows.budgets.max())
    # the alignment may leave the band's diagonals by its budget on either side
    width = BAND + 3 * top + 1
    begin = key // items * BAND - windows.longest - top + starts
    longest = int(windows.sizes.max())
    middle = begin + windows.sizes[which] // 2 + width // 2
    if len(which):  # what was found unchanged needs no alignment
        owner = np.clip(np.searchsorted(first, middle, side="right") - 1, 0, docs - 1)
        known = (found.get((d, int(windows.item[w])), {}).get(x) for d, w, x in zip(owner.tolist(), which.tolist(), starts.tolist(), strict=True))
        open_ = np.fromiter((e != 0 for e in known), bool, len(which))
        which, starts, begin, middle = which[open_], starts[open_], begin[open_], middle[open_]
    for lo in range(0, len(which), 2048):
        w, s, b = which[lo:lo + 2048], starts[lo:lo + 2048], begin[lo:lo + 2048]
        pattern = np.zeros((len(w), longest), np.uint32)
        for i, (x, y) in enumerate(zip(w.tolist(), s.tolist(), strict=True)):
            pattern[i, :windows.sizes[x]] = windows.codes[x][y:y + windows.sizes[x]]
        index = b[:, None] + np.arange(longest + width)
        text = np.where((index >= 0) & (index < len(whole)), whole[np.clip(index, 0, len(whole) - 1)], gap)
        edits = banded(pattern, text, windows.sizes[w], width)
        ok = edits <= windows.budgets[w]
        note(middle[lo:lo + 2048][ok], w[ok], s[ok], edits[ok])


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[int, str | None]]]:
    """The items in blocks of bounded length, each fetched when it is needed."""
    size = benchmark.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    numbered = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(text_col, item_col), F.lit(blocks)).alias("block"))
    return [numbered.filter(F.col("block") == b).select("item", "text") for b in range(blocks)]


def window_sets(benchmark: DataFrame, rate: float, item_col: str, text_col: str):
    """For each block its broadcast items and a name that a worker remembers them by."""
    sc = benchmark.sparkSession.sparkContext
    for block in item_blocks(benchmark, item_col, text_col):
        yield sc.broadcast([tuple(r) for r in block.collect()]), uuid.uuid4().hex  # bounded by BLOCK_CHARS


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", stride: int = 1, short: bool = True) -> DataFrame:
    """One row per document and item it leaks: ids, windows found, least edits of a window."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for items, name in window_sets(benchmark, rate, item_col, item_text_col):

        def make(items=items, name=name):
            windows = once(name, lambda: Windows(items.value, rate, stride, short))

            def work(part):
                ids = column(part, "id")
                got = leaks_in(texts(part), windows)
                if got:
                    d, i, n, e = (list(x) for x in zip(*got, strict=True))
                    named = pa.array([windows.ids[x] for x in i], item_type)
                    schema = pa.schema([("id", ids.type), ("item", named.type), ("n_windows", pa.int64()), ("edits", pa.int64())])
                    yield batch_of(schema, id=ids.take(pa.array(d)), item=named, n_windows=n, edits=e)

            return work

        part = arrow_map(docs, [F.col(id_col).alias("id"), text_bytes(text_col)], make, f"id {kind}, item {item_kind}, n_windows long, edits long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", stride: int = 1, short: bool = True) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    names = docs.columns
    at = names.index(text_col)
    # positions instead of names: columns may repeat names
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    fields = plain.schema
    for items, name in window_sets(benchmark, rate, item_col, item_text_col):

        def run(batches, items=items, name=name):
            windows = once(name, lambda: Windows(items.value, rate, stride, short))
            for batch in batches:
                for part in slices(batch, f"c{at}"):
                    rows = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                    bad = {d for d, *_ in leaks_in(rows, windows)}
                    yield part.filter(pa.array([i not in bad for i in range(len(rows))], pa.bool_()))

        plain = plain.mapInArrow(run, fields)
    return plain.toDF(*names)
