"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a slice lie as one ragged numpy array of symbols. In each round every
sequence finds its pair of lowest rank, and all sequences merge theirs at once; a sequence
without a pair is done and its surviving symbols are counted. All occurrences of the pair in a
sequence merge in one round unless the new symbol could form a pair of lower rank; then only the
leftmost does, so that the order is that of one merge at a time.

The file is a ``tokenizers`` JSON with a BPE of byte-level symbols and a word-end suffix.
Null and empty texts have no tokens. Repeated rows are counted each. An empty table gives none.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import Remembered, arrow_map, batch_of, column, once, text_bytes, texts

NO_RANK = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class MergeTable:
    """Ranks of symbol pairs as sorted arrays, and the symbols of single bytes."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_symbols()], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys = key[order]
        self.rank_of_key = order.astype(np.int64)
        self.made = made
        lowest = np.full(len(vocab), NO_RANK)
        np.minimum.at(lowest, left, np.arange(len(merges)))
        np.minimum.at(lowest, right, np.arange(len(merges)))
        self.orderly = lowest[made] > np.arange(len(merges))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], NO_RANK)

    def lengths(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte sequence after all merges."""
        size = np.fromiter(map(len, sequences), np.int64, len(sequences))
        done = np.zeros(len(sequences), np.int64)
        raw = np.frombuffer(b"".join(sequences), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last[raw[ends]]
        alive = np.arange(len(sequences))
        rank = None
        while len(alive):
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(len(alive)), size)
            if rank is None:
                rank = np.full(len(symbols), NO_RANK)
                rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
                rank[first + size - 1] = NO_RANK
            best = np.minimum.reduceat(rank, first)
            ended = best == NO_RANK
            if ended.any():
                done[alive[ended]] = size[ended]
                keep = ~ended[row]
                symbols, rank = symbols[keep], rank[keep]
                alive, size = alive[~ended], size[~ended]
                continue
            at = np.flatnonzero(rank == best[row])
            r = row[at]
            new_row = np.empty(len(at), bool)
            new_row[0], new_row[1:] = True, r[1:] != r[:-1]
            run = new_row.copy()
            run[1:] |= at[1:] != at[:-1] + 1
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - begin) % 2 == 0
            take &= self.orderly[best[r]] | new_row
            at = at[take]
            symbols[at] = self.made[best[row[at]]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            size = size - np.bincount(row[at], minlength=len(alive))
            symbols, rank = symbols[keep], rank[keep]
            first = np.cumsum(size) - size
            last = np.zeros(len(symbols), bool)
            last[first + size - 1] = True
            here = moved[at]
            changed = np.zeros(len(symbols), bool)
            changed[here] = True
            changed[here[here > 0] - 1] = True
            rank[changed] = NO_RANK
            touched = np.flatnonzero(changed & ~last)
            rank[touched] = self.ranks(symbols[touched], symbols[touched + 1])
        return done


class TokenCounter:
    """Counts tokens of white-space separated words, remembering them within bounds."""

    def __init__(self, spec: dict):
        self.table = MergeTable(spec)
        self.words = Remembered()
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
            raise ValueError("a tokenizer file of another kind")
        # white space is no part of a pre-token, so words can be joined by line ends and told apart again
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))

    def normal(self, text: str) -> str:
        # letter by letter: a final capital sigma is no exception
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn(self, words: list[bytes]) -> None:
        """Count the tokens of new words: one pass of the pattern over all, then one merging of all."""
        text = b"\n".join(words).decode("utf-8", "replace")
        extra = np.zeros(len(words), np.int64)
        if self.special.search(text):
            rows = text.split("\n")
            for i, row in enumerate(rows):
                if found := self.special.findall(row):
                    extra[i] = len(found)
                    # each part is text of its own; a space keeps them apart
                    rows[i] = " ".join(self.normal(x) for x in self.special.split(row))
                else:
                    rows[i] = self.normal(row)
            text = "\n".join(rows)
        else:
            text = self.normal(text)
        found = self.pattern.findall(text)
        number: dict[str, int] = {"\n": 0}
        index = np.fromiter((number.setdefault(t, len(number)) for t in found), np.int64, len(found))
        lengths = np.zeros(len(number), np.int64)
        if len(number) > 1:
            lengths[1:] = self.table.lengths([t.encode() for t in list(number)[1:]])
        ends = np.concatenate([np.flatnonzero(index == 0), [len(index)]])
        total = np.concatenate([[0], np.cumsum(lengths[index])])[ends]
        counts = np.diff(total, prepend=0) + extra
        self.words.now.update(zip(words, counts.tolist(), strict=True))

    def count(self, docs: list[bytes]) -> list[int]:
        split = [d.split() for d in docs]
        new = self.words.missing(set().union(*split))
        if new:
            self.learn(list(new))
        get = self.words.now.__getitem__
        return [sum(map(get, ws)) for ws in split]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_bytes (UTF-8) and n_tokens. The path is read on the driver."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    spec = docs.sparkSession.sparkContext.broadcast(spec)  # one file, of fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        counter = once(("tokens", tokenizer_path), lambda: TokenCounter(spec.value))

        def work(part):
            rows = texts(part)
            ids = column(part, "id")
            schema = pa.schema([("id", ids.type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
            yield batch_of(schema, id=ids, n_bytes=list(map(len, rows)), n_tokens=counter.count(rows))

        return work

    out = arrow_map(docs, [F.col(id_col).alias("id"), text_bytes(text_col)], make, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
