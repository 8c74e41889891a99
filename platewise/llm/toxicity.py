"""Toxicity by multiple-instance learning.

Labels are known for documents only; what makes a document toxic is some sentence. A sentence with
features x is toxic with probability p = 1 / (1 + exp(-(b + w x))), a document with probability
1 - prod(1 - p) over its sentences (noisy-or). b and w maximise the likelihood of the document labels under
a ridge penalty. The sentences of a document whose own p reaches the threshold are the offending ones.

Features are the marked, lower-cased word and its pieces of four and five bytes, hashed into 2**HASH_BITS
buckets, so that a root seen in training also tells in words that were not. Training uses a bounded sample of the
labelled ids of the given part (``sample``, the first in hash order), each distinct text and label once, so copies don't outweigh the rest: one pass counts
in how many toxic and other documents each bucket occurs, the ``n_features`` buckets with the largest
likelihood ratio towards toxic are kept (a size of the model), and the likelihood is climbed by L-BFGS whose gradient is
summed over the partitions of the compact sentences. Only sums of n_features + 1 numbers reach the driver.

A sentence ends at a word with a stop mark at its end or at a line break, and after SENTENCE_WORDS words if it has none; each distinct
word of it counts once. Null and empty
texts have no sentence and score 0. Rows without an id have no label. Of several labels of one id the largest
counts; null labels count as absent. Repeated rows are scored each, to the same score. Without labelled rows, or without a toxic one, every score is 0.
Texts are scored whole, whatever their length. Further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import STEP, U64, arrow_map, batch_of, column, mixed, pick, rolling, text_bytes, texts
from platewise.session import cut_lineage

HASH_BITS = 18
SIZES = (4, 5)  # bytes of a piece
N_FEATURES = 4096
SAMPLE = 20_000  # labelled ids that the model learns from
LEAST_SEEN = 3  # toxic documents that must hold a feature
SENTENCE_WORDS = 40
RIDGE = 1.0
STEPS = 60
MEMORY = 8  # curvature pairs of the climb

STOPS = frozenset(".!?…。！？؟।")
CLOSERS = "\"'”’»)]"
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…·•*#-_/\\|`~^$%&+=@¡¿。！？؟।"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of many words, end to end, and where each word's begin and end: the word and its pieces."""
    marked = [b"^" + core.encode("utf-8", "surrogatepass") + b"$" if (core := w.lower().strip(EDGES)) else b"" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(lengths) - lengths
    joined = np.frombuffer(b"".join(marked), np.uint8).astype(U64)
    owner = np.repeat(np.arange(len(words)), lengths)
    mask = U64((1 << HASH_BITS) - 1)
    own, found = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    with np.errstate(over="ignore"):
        for n in SIZES:
            h = rolling(joined + U64(n << 8), n)
            inside = owner[:len(h)] == owner[n - 1:n - 1 + len(h)]
            own.append(owner[:len(h)][inside])
            found.append(mixed(h[inside]) & mask)
        if len(joined):
            some = np.flatnonzero(lengths)
            powers = np.cumprod(np.full(int(lengths.max()), STEP, U64))
            whole = np.add.reduceat((joined + U64(1)) * powers[np.arange(len(joined)) - starts[owner]], starts[some])
            own.append(some)
            found.append(mixed(whole) & mask)
    owner, flat = np.concatenate(own), np.concatenate(found).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


class Codes(dict):
    """Numbers of distinct words in order of first appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Slice:
    """Sentences of some texts as arrays: text of each, first and last token, and its distinct words as (sentence, word)."""

    def __init__(self, many: list[bytes]):
        codes, tokens, sizes, owner = Codes(), [], [], []
        self.texts = [text.decode("utf-8", "replace") for text in many]
        for d, text in enumerate(self.texts):
            for line in text.split("\n"):
                words = line.split()
                if words:
                    tokens.extend(map(codes.__getitem__, words))
                    sizes.append(len(words))
                    owner.append(d)
        self.n, self.words = len(many), list(codes)
        codes_ = np.array(tokens, np.int64)
        line_end = np.cumsum(np.array(sizes, np.int64))
        ends = np.fromiter((w.rstrip(CLOSERS)[-1:] in STOPS for w in self.words), bool, len(self.words))[codes_]
        ends[line_end - 1] = True
        # long sentences are cut into parts
        number = np.cumsum(ends) - ends
        first = np.searchsorted(number, number)
        part = (np.arange(len(codes_)) - first) // SENTENCE_WORDS
        new = np.ones(len(codes_), bool)
        new[1:] = (number[1:] != number[:-1]) | (part[1:] != part[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(codes_))[: len(self.first)] - 1
        doc = np.repeat(np.array(owner, np.int64), np.array(sizes, np.int64))
        self.doc = doc[self.first]
        self.doc_start = np.searchsorted(doc, np.arange(self.n))
        size = max(len(self.words), 1)
        pairs = np.sort((np.cumsum(new) - 1) * size + codes_)
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
        self.sentence, self.word = pairs // size, pairs % size

    def spans(self, which: np.ndarray) -> list[tuple[int, int]]:
        """Start and end, in code points, of some sentences in ascending order."""
        out, d, places = [], -1, []
        for i in which:
            if self.doc[i] != d:
                d = self.doc[i]
                places = [m.span() for m in re.finditer(r"\S+", self.texts[d])]
            base = self.doc_start[d]
            out.append((places[self.first[i] - base][0], places[self.last[i] - base][1]))
        return out


def spread(flat: np.ndarray, edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``which`` of a ragged array one after another, and their lengths."""
    sizes = (edges[1:] - edges[:-1])[which]
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[np.repeat(edges[which], sizes) + inside], sizes


@dataclass
class ToxicModel:
    """Weights of the kept buckets (sorted) and the bias."""

    kept: np.ndarray
    weights: np.ndarray
    bias: float
    steps: int = 0
    slope: float = 0.0
    fitted: bool = field(default=True)

    def word_weights(self, words: list[str]) -> np.ndarray:
        full = np.zeros(1 << HASH_BITS)
        full[self.kept] = self.weights
        flat, edges = word_features(words)
        return np.bincount(np.repeat(np.arange(len(words)), edges[1:] - edges[:-1]), full[flat], len(words))


def labelled(docs: DataFrame, labels: DataFrame, learn_from: Callable[[Column], Column], id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, y) of the distinct texts of at most ``sample`` labelled ids of the part to learn from."""
    known = pick(labels, id=id_col, y=label_col).where("id is not null and y is not null").where(learn_from(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    known = cut_lineage(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = pick(docs, id=id_col, text=text_col).where("id is not null").where(learn_from(F.col("id")))
    # the sample's size bounds what is broadcast, so the documents are not shuffled
    rows = rows.join(F.broadcast(known), "id").select((F.col("y") > 0).cast("int").alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("y", F.md5("text").alias("key")).agg(F.first("text").alias("text")).select(text_bytes(), "y")


def feature_counts(rows: DataFrame) -> DataFrame:
    """bucket, toxic, other: documents of either label that hold the bucket."""

    def make():
        counts = np.zeros((2, 1 << HASH_BITS), np.int64)

        def work(part):
            y, held = column(part, "y").to_pylist(), Slice(texts(part))
            flat, edges = word_features(held.words)
            starts = np.searchsorted(held.doc[held.sentence], np.arange(held.n + 1))
            for d in range(held.n):
                mine = np.unique(held.word[starts[d]:starts[d + 1]])
                counts[y[d], np.unique(spread(flat, edges, mine)[0])] += 1
            return iter(())

        def end():
            at = np.flatnonzero(counts.any(axis=0))
            for piece in np.array_split(at, max(1, len(at) // 10_000)):
                yield batch_of(COUNTS, bucket=piece.astype(np.int32), toxic=counts[1, piece], other=counts[0, piece])

        work.end = end
        return work

    each = arrow_map(rows, ["text", "y"], make, "bucket int, toxic long, other long")
    return each.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


COUNTS = pa.schema([("bucket", pa.int32()), ("toxic", pa.int64()), ("other", pa.int64())])
BAGS = pa.schema([("y", pa.int32()), ("plain", pa.int64()), ("at", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])


def choose(counts: DataFrame, toxic: int, other: int, n_features: int) -> list[int]:
    """The buckets that tell most for toxic, by the likelihood ratio of their counts."""
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    share = (a + b) / float(toxic + other)

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = term(a, share * toxic) + term(b, share * other) + term(toxic - a, (1 - share) * toxic) + term(other - b, (1 - share) * other)
    towards = (a >= LEAST_SEEN) & (a * other > b * toxic)
    best = counts.where(towards).select("bucket", gain.alias("gain")).where("gain > 4").orderBy(F.col("gain").desc(), "bucket").limit(n_features)
    return sorted(r["bucket"] for r in best.collect())


def bags(rows: DataFrame, kept: list[int]) -> DataFrame:
    """Documents as sentences of kept features: ``at`` has the features of all, ``sizes`` how many of each, ``plain`` counts those without."""

    def make():
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[kept] = np.arange(len(kept))

        def work(part):
            held = Slice(texts(part))
            flat, edges = word_features(held.words)
            known = place[flat]
            upto = np.concatenate([[0], np.cumsum(known >= 0)])
            flat, edges = known[known >= 0], upto[edges]
            at, sizes = spread(flat, edges, held.word)
            per = np.bincount(held.sentence, sizes, len(held.doc)).astype(np.int64)  # kept features of each sentence
            live = per > 0
            plain = np.bincount(held.doc[~live], minlength=held.n)
            ends = np.cumsum(np.bincount(held.doc, per, held.n)).astype(np.int64)
            marks = np.cumsum(np.bincount(held.doc[live], minlength=held.n))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], e]), pa.int32()), pa.array(v.astype(np.int32))) for e, v in ((ends, at), (marks, per[live]))]
            yield batch_of(BAGS, y=column(part, "y"), plain=plain, at=lists[0], sizes=lists[1])

        return work

    return arrow_map(rows, ["text", "y"], make, "y int, plain long, at array<int>, sizes array<int>")


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def bag_gradient(batch: pa.RecordBatch, w: np.ndarray, bias: float) -> np.ndarray:
    """Negative log likelihood of some documents and its gradient: loss, bias, weights."""
    y = column(batch, "y").to_numpy()
    plain = column(batch, "plain").to_numpy().astype(float)
    at_col, size_col = column(batch, "at"), column(batch, "sizes")
    at, sizes = at_col.flatten().to_numpy(zero_copy_only=False), size_col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n_sent = np.diff(size_col.offsets.to_numpy())
    doc = np.repeat(np.arange(len(y)), n_sent)
    z = bias + np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[at], len(sizes))
    # 1 - p = exp(-softplus(z)), so a document is clean with probability exp(-s)
    s = np.maximum(np.bincount(doc, softplus(z), len(y)) + plain * softplus(np.array(bias)), 1e-300)
    loss = np.where(y == 1, -np.log(-np.expm1(-s)), s)
    ds = np.where(y == 1, -1.0 / np.expm1(np.minimum(s, 700.0)), 1.0)
    # documents without a sentence can't be toxic and say nothing
    live = (n_sent > 0) | (plain > 0)
    loss, ds = loss * live, ds * live
    dz = ds[doc] / (1.0 + np.exp(-z))
    out = np.zeros(len(w) + 2)
    out[0] = loss.sum()
    out[1] = dz.sum() + (ds * plain).sum() / (1.0 + math.exp(-bias))
    out[2:] = np.bincount(at, np.repeat(dz, sizes), len(w))
    return out


def evaluate(rows: DataFrame, theta: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Penalised loss and gradient at theta = (bias, weights), summed over all partitions."""

    def run(batches):
        total = np.zeros(len(theta) + 1)
        for batch in batches:
            if batch.num_rows:
                total += bag_gradient(batch, theta[1:], theta[0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "g"])

    sums = np.zeros(len(theta) + 1)
    for r in rows.mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
        sums[r["i"]] = r["g"]
    grad = sums[1:].copy()
    grad[1:] += ridge * theta[1:]
    return sums[0] + ridge / 2 * float(theta[1:] @ theta[1:]), grad


def climb(f: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, int, float]:
    """L-BFGS with halved steps; ends when the gradient is small against the loss."""
    value, grad = f(theta)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(steps):
        if np.abs(grad).max() <= tolerance * max(1.0, value):
            return theta, step, float(np.abs(grad).max())
        q, alphas = grad.copy(), []
        for s, t in reversed(pairs):
            alphas.append((s @ q) / (s @ t))
            q -= alphas[-1] * t
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1.0 / max(1.0, float(np.linalg.norm(grad)))
        for (s, t), alpha in zip(pairs, reversed(alphas), strict=True):
            q += (alpha - (t @ q) / (s @ t)) * s
        size = 1.0
        while True:
            new, (v, g) = theta - size * q, f(theta - size * q)
            if v <= value - 1e-4 * size * float(grad @ q) or size < 1e-6:
                break
            size /= 2
        s, t = new - theta, g - grad
        if s @ t > 1e-12:
            pairs = [*pairs, (s, t)][-MEMORY:]
        theta, value, grad = new, v, g
    return theta, steps, float(np.abs(grad).max())


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn_from: Callable[[Column], Column] = lambda i: F.lit(True), id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", sample: int = SAMPLE, n_features: int = N_FEATURES, ridge: float = RIDGE, steps: int = STEPS, tolerance: float = 5e-3,
) -> ToxicModel:
    """Model of the labelled documents whose id ``learn_from`` takes."""
    rows = cut_lineage(labelled(docs, labels, learn_from, id_col, text_col, label_col, sample))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return ToxicModel(np.zeros(0, np.int32), np.zeros(0), -math.inf, fitted=False)
    kept = choose(feature_counts(rows), toxic, other, n_features)
    sets = cut_lineage(bags(rows, kept))
    start = np.zeros(len(kept) + 1)
    start[0] = -4.0
    theta, taken, slope = climb(lambda t: evaluate(sets, t, ridge), start, steps, tolerance)
    return ToxicModel(np.array(kept, np.int32), theta[1:], float(theta[0]), taken, slope)


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, and the offending sentences as (start, end, probability), ends exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = pick(docs, id=id_col, text=text_col)

    def make():
        def work(part):
            ids, held = column(part, "id"), Slice(texts(part))
            z = model.bias + np.bincount(held.sentence, model.word_weights(held.words)[held.word], len(held.doc))
            s = softplus(z)
            score = -np.expm1(-np.bincount(held.doc, s, held.n)) + 0.0
            p = -np.expm1(-s)
            spans: list[list[dict]] = [[] for _ in range(held.n)]
            bad = np.flatnonzero(p >= threshold)
            for i, (start, end) in zip(bad, held.spans(bad), strict=True):
                spans[held.doc[i]].append({"start": start, "end": end, "probability": float(p[i])})
            yield batch_of(pa.schema([("id", ids.type), ("score", pa.float64()), ("offending", SPANS)]), id=ids, score=score, offending=spans)

        return work

    out = arrow_map(rows, ["id", text_bytes()], make, f"id {kind}, score double, offending array<struct<start: int, end: int, probability: double>>")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
