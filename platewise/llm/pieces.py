"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The distinct marked words of a slice, sorted, form a trie that is walked depth-first: a word
keeps the forward states of the prefix it shares with the word before and adds one state for
each further character. A state holds the best piece that ends there and its back pointer.

What is best depends on the model. For a unigram model it is the largest sum of scores. The
given model file is a BPE, whose scores are merge ranks and not log probabilities: their largest
sum is not what the library encodes. For a BPE a transition is allowed only where the two pieces
stay apart when merged by rank; exactly one path is left, with the library's ids.

Null and empty texts have no pieces. Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import Remembered, arrow_map, batch_of, column, once, text_bytes, texts

MARK = "▁"  # stands for a space
NEVER = 1 << 60
PAIRS = 1_000_000  # neighbours remembered by a worker


def load_vocabulary(path: str) -> dict:
    """Pieces of a model file as plain values. The library only reads the file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    plain = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    pieces = {m.id_to_piece(i): i for i in plain}
    scores = {i: m.get_score(i) for i in plain}
    whole = all(s == int(s) for s in scores.values())
    return {
        "kind": "bpe" if whole else "unigram",  # merge ranks are whole numbers, log probabilities are not
        "pieces": pieces, "scores": scores,
        "bytes": {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}, "unk": m.unk_id(),
    }


class PieceCoder:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: dict):
        self.pieces: dict[str, int] = vocabulary["pieces"]
        self.bytes: dict[int, int] = vocabulary["bytes"]
        self.unk = vocabulary["unk"]
        self.text = {i: p for p, i in self.pieces.items()}
        self.bpe = vocabulary["kind"] == "bpe"
        self.scores = vocabulary["scores"]
        self.rank = {p: -vocabulary["scores"][i] for p, i in self.pieces.items()}
        self.spines: dict[str, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.words = Remembered()
        self.prefixes: dict = {}  # letters lead on; the empty string leads to a piece's id
        for p, i in self.pieces.items():
            place = self.prefixes
            for c in p:
                place = place.setdefault(c, {})
            place[""] = i
        inner = {c for p in self.pieces for c in p.lstrip(MARK)}
        if MARK in inner:
            raise ValueError("pieces with a space inside: words can't be told apart")
        self.splitter = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in inner else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.text_of = {i: p.replace(MARK, " ").encode() for p, i in self.pieces.items()}
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}

    # BPE: do two neighbouring pieces stay apart?

    def merged(self, text: str) -> list[tuple]:
        """All merges of a short text by rank, leftmost first, as a forest of (piece, left, right)."""
        row: list[tuple] = [(c, None, None) for c in text]
        while True:
            best, at = NEVER, -1
            for i in range(len(row) - 1):
                r = self.rank.get(row[i][0] + row[i + 1][0], NEVER)
                if r < best:
                    best, at = r, i
            if at < 0:
                return row
            row[at:at + 2] = [(row[at][0] + row[at + 1][0], row[at], row[at + 1])]

    def spine(self, piece: str) -> tuple:
        """Pieces at the left and at the right edge of a piece while it grows; None if merging doesn't reach it."""
        found = self.spines.get(piece, 0)
        if found == 0:
            row = self.merged(piece)
            if len(row) > 1:
                found = None
            else:
                sides = []
                for side in (1, 2):
                    node, path = row[0], []
                    while node is not None:
                        path.append(node[0])
                        node = node[side]
                    path.reverse()
                    sides.append([(p, self.rank.get(q, NEVER)) for p, q in zip(path, path[1:], strict=False)] + [(path[-1], NEVER)])
                found = (sides[0], sides[1])
            self.spines[piece] = found
        return found

    def reached(self, i: int) -> bool:
        """Whether merging the text of piece i gives piece i; else no encoding has it."""
        return self.spine(self.text[i]) is not None

    def apart(self, a: int, b: int) -> bool:
        """Whether merging both texts gives just pieces a and b, by the growth of both edges over the ranks."""
        known = self.reached(b)
        if known and a >= 0:
            right, left = self.spine(self.text[a])[1], self.spine(self.text[b])[0]
            i = j = 0
            while True:
                (p, up), (q, over) = right[i], left[j]
                r = self.rank.get(p + q, NEVER)
                if r < up and r <= over:
                    known = False
                    break
                if up == over == NEVER:
                    break
                if up <= over:
                    i += 1
                else:
                    j += 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = known
        return known

    # the trie

    def learn(self, words: list[str]) -> None:
        """Encode distinct words in sorted order, keeping the forward states of shared prefixes.

        ``states[i]`` is the score, start and id of the best piece that ends at i. ``reach[i]`` has
        the starts before i from which some piece goes on past i, each with its place among the
        vocabulary's own prefixes.
        """
        root, bpe, scores, pairs = self.prefixes, self.bpe, self.scores, self.pairs
        worst = min(scores.values(), default=0.0) - 10.0
        before, states, reach = "", [(0.0, -1, -1)], [[]]
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1:], reach[shared + 1:]
            for end in range(shared, len(word)):
                c, best, going = word[end], None, []
                for start, place in [*reach[end], (end, root)]:
                    nxt = place.get(c)
                    if nxt is None:
                        continue
                    going.append((start, nxt))
                    i = nxt.get("")
                    if i is None:
                        continue
                    back = states[start]
                    if not bpe:
                        if best is None or back[0] + scores[i] > best[0]:
                            best = (back[0] + scores[i], start, i)
                    elif best is None:
                        u = back[2]
                        ok = pairs.get(u << 32 | i) if u >= 0 else self.reached(i)
                        if ok is None:
                            ok = self.apart(u, i)
                        if ok:
                            best = (0.0, start, i)
                if best is None or (not bpe and c not in root and states[end][0] + worst > best[0]):
                    best = (states[end][0] + worst, end, -1)
                states.append(best)
                reach.append(going)
            out, end = [], len(word)
            while end:
                _, start, i = states[end]
                if i >= 0:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in reversed(word[start:end].encode())]
                else:
                    out.append(self.unk)
                end = start
            out.reverse()
            self.words.now[word] = array("i", out).tobytes()
            before = word

    def split(self, text: str) -> list[str]:
        return self.splitter.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, docs: list[str]) -> list[np.ndarray]:
        split = [self.split(d) for d in docs]
        new = self.words.missing(set().union(*split))
        self.learn(list(new))
        get = self.words.now.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), np.int32) for ws in split]

    def decode(self, ids) -> str:
        """Text of a sequence of ids, without the space that encoding puts in front."""
        text, raw = self.text_of, self.byte_of
        out = b"".join(text.get(i) or raw.get(i, b"") for i in ids).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def encode_pieces(docs: DataFrame, vocabulary: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, its piece ids, and whether decoding gives the text again.

    A literal mark (U+2581) in a text decodes as a space, so ``round_trip`` compares with the
    text after that replacement.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file, of fixed size
    key = ("pieces", uuid.uuid4().hex)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        coder = once(key, lambda: PieceCoder(shared.value))

        def work(part):
            rows = [t.decode("utf-8", "replace") for t in texts(part)]
            ids = column(part, "id")
            coded = coder.encode(rows)
            ok = [coder.decode(c.tolist()) == t.replace(MARK, " ") for c, t in zip(coded, rows, strict=True)]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded) if len(coded) else np.zeros(0, np.int32)))
            schema = pa.schema([("id", ids.type), ("n_pieces", pa.int64()), ("pieces", pa.list_(pa.int32())), ("round_trip", pa.bool_())])
            yield batch_of(schema, id=ids, n_pieces=sizes, pieces=lists, round_trip=ok)

        return work

    out = arrow_map(docs, [F.col(id_col).alias("id"), text_bytes(text_col)], make, f"id {kind}, n_pieces long, pieces array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_pieces(coded: DataFrame, vocabulary: dict, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """One row per sequence: id and text. A null sequence decodes to the empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)
    key = ("pieces", uuid.uuid4().hex)
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = once(key, lambda: PieceCoder(shared.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return coded.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
