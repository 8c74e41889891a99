"""Line-first cleaning: rules judge each line, failing lines go, then texts that lose too much go.

Rules for a line that has a word, in this order; the first that holds names the failure:

* ``boilerplate``: it holds one of the phrases of web furniture below, in any case;
* ``navigation``: three or more words of which a quarter at least are bare separators, or
  a line of separators only;
* ``symbols``: a quarter of its words at least end in one of the symbols ``#*$%&|<>``;
* ``punctuation``: it neither ends with terminal punctuation, closing quotes and brackets aside,
  nor holds a word that ends a sentence (a passage cut off in the middle is still prose).

A line without words is neither kept text nor lost text; it goes only if it would follow another
such line. The text is rejected if its lost words exceed ``max_lost`` of all words, if under
``min_words`` words are left, or if the base statistics fail (fewer than ``min_words`` words,
or more than ``max_repeat`` percent of words in repeated five-word windows).

Null and empty texts have no words and are rejected. Equal rows are judged alike. Any other
columns are left alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import WordHashes, arrow_map, batch_of, column, covered, rolling, text_bytes, texts, window_starts

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
PHRASES = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled", "javascript must be enabled",
    "lorem ipsum", "privacy policy", "sign up for our newsletter", "skip to content", "subscribe to our newsletter", "terms of service", "terms of use",
)
BOILERPLATE = re.compile("|".join(map(re.escape, PHRASES)).encode())
ENDING = re.compile(r"[.!?…。！？؟।][\"'”’»)\]\x20\t\x0b\f\r]*$")
SENTENCE = re.compile(r"(?:[.!?]|…|。|！|？|؟|।)(?:[\"')\]]|”|’|»)*(?:[\x20\t\x0b\f\r]|$)".encode())
MARKED = re.compile(rb"[#*$%&|<>](?=[\x20\t\x0b\f\r]|$)")
SEPARATORS = frozenset([b"|", b">", b"<", b"/", b"\\", b"-", b"*", "•".encode(), "·".encode(), "»".encode(), "«".encode(), "›".encode(), "–".encode()])


def line_failure(line: bytes, words: list[bytes]) -> str | None:
    """Name of the first rule that a line with words fails."""
    if BOILERPLATE.search(line.lower()):
        return "boilerplate"
    bare = sum(w in SEPARATORS for w in words)
    if bare == len(words) or len(words) >= 3 and 4 * bare >= len(words):
        return "navigation"
    if 4 * len(MARKED.findall(line)) >= len(words):
        return "symbols"
    if line[-1:] != b"." and not ENDING.search(line[-64:].decode("utf-8", "ignore")) and not SENTENCE.search(line):
        return "punctuation"
    return None


def clean_lines(text: bytes) -> tuple[bytes, int, int, int]:
    """The kept text, its words, the lines that failed and the lines that repeat an earlier one."""
    kept, words_left, failed, repeated = [], 0, 0, 0
    seen: set[bytes] = set()
    blank = False
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            if not blank:
                kept.append(line)
            blank = True
            continue
        repeated += line in seen
        seen.add(line)
        if line_failure(line, words):
            failed += 1
            continue
        blank = False
        kept.append(line)
        words_left += len(words)
    return b"\n".join(kept), words_left, failed, repeated


def repeat_words(lists: list[list[bytes]], hashes: WordHashes) -> np.ndarray:
    """Of each text, how many words lie in windows found twice or more in it."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    total = int(counts.sum())
    starts, owner = window_starts(counts, WINDOW)
    if not len(starts):
        return np.zeros(len(lists), np.int64)
    h = rolling(hashes.all([w for ws in lists for w in ws]), WINDOW)[starts]
    # windows are compared inside their own text only
    order = np.lexsort((h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    hit = covered(starts[twice], WINDOW, total)
    return np.bincount(np.repeat(np.arange(len(lists)), counts), weights=hit, minlength=len(lists)).astype(np.int64)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat: int = 20, max_lost: float = 0.5, keep_text: bool = True) -> DataFrame:
    """One row per text: id, statistics, ``base_failed``, ``kept`` and, if asked for, ``clean_text``."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_failed_lines long, n_lost_words long, base_failed boolean, kept boolean" + ", clean_text string" * keep_text

    def make():
        hashes = WordHashes()

        def work(part):
            rows, ids = texts(part), column(part, "id")
            lists = [r.split() for r in rows]
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            again = repeat_words(lists, hashes)
            cleaned = [clean_lines(r) for r in rows]
            lost = n - np.fromiter((c[1] for c in cleaned), np.int64, len(cleaned))
            failed = (n < min_words) | (100 * again > max_repeat * n)
            kept = ~failed & (lost <= max_lost * n) & (n - lost >= min_words)
            out = {
                "id": ids, "n_words": n,
                "word_chars": [len(r.decode("utf-8", "replace")) - sum(map(r.count, SPACE_LIST)) for r in rows],
                "n_symbols": [sum(map(r.count, SYMBOL_LIST)) for r in rows],
                "n_dup_lines": [c[3] for c in cleaned], "n_repeat_words": again, "n_failed_lines": [c[2] for c in cleaned],
                "n_lost_words": lost, "base_failed": failed, "kept": kept,
            }
            fields = [("id", ids.type), *((k, pa.int64()) for k in list(out)[1:8]), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
            if keep_text:
                out["clean_text"] = [c[0].decode("utf-8", "replace") for c in cleaned]
                fields.append(("clean_text", pa.string()))
            yield batch_of(pa.schema(fields), **out)

        return work

    return arrow_map(docs, [F.col(id_col).alias("id"), text_bytes(text_col)], make, schema).withColumnRenamed("id", id_col)


SPACE_LIST = [SPACES[i:i + 1] for i in range(len(SPACES))]
SYMBOL_LIST = [SYMBOLS[i:i + 1] for i in range(len(SYMBOLS))]


def clean_documents(docs: DataFrame, text_col: str = "text", min_words: int = 10, max_repeat: int = 20, max_lost: float = 0.5) -> DataFrame:
    """The documents that pass, with their failing lines removed and all their columns in place."""
    names = docs.columns
    at = [i for i, c in enumerate(names) if c == text_col][0]
    # positions instead of names: columns may repeat names
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    fields = plain.schema

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            rows = [x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]
            for i in range(0, len(rows), 256):
                part = rows[i:i + 256]
                lists = [r.split() for r in part]
                n = np.fromiter(map(len, lists), np.int64, len(lists))
                again = repeat_words(lists, hashes)
                cleaned = [clean_lines(r) for r in part]
                left = np.fromiter((c[1] for c in cleaned), np.int64, len(cleaned))
                keep = (n >= min_words) & (100 * again <= max_repeat * n) & (n - left <= max_lost * n) & (left >= min_words)
                if keep.any():
                    cols = [b.column(j).slice(i, len(part)).filter(pa.array(keep)) for j in range(b.num_columns)]
                    cols[at] = pa.array([c[0].decode("utf-8", "replace") for c, k in zip(cleaned, keep, strict=True) if k], pa.string())
                    yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([b.schema.field(j).with_type(cols[j].type) for j in range(b.num_columns)]))

    return plain.mapInArrow(run, fields).toDF(*names)
