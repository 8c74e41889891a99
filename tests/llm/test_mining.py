"""Hard negatives, conversation trie and toxicity against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import conversation_trie as CT
from platewise.llm import hard_negatives as HN
from platewise.llm import toxicity as TX
from platewise.operators import order

# hard negatives ---------------------------------------------------------------

@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (17, 33, 19), (64, 64, 64), (65, 64, 70), (40, 1, 40)])
def test_strassen_is_exact_modulo_the_ring(shape):
    r = np.random.default_rng(1)
    a, b = r.integers(-2**62, 2**62, shape[:2]), r.integers(-2**62, 2**62, shape[1:])
    assert (HN.strassen(a, b, 2) == a @ b).all()


def plain_negatives(rows, positives=5, negatives=10, low=30, high=90):
    good = []
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) or abs(256 * x) > 2**28 for x in vec):
            continue
        if i % 7 == 0:
            label = (label + 1) % 10
        good.append((i, tuple(math.floor(256 * x) for x in vec), label))
    good = sorted(set(good))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in good:
        if a[0] % 100:
            continue
        same = sorted(((-dot(a[1], c[1]), c[0]) for c in good if c != a and c[2] == a[2]))[:positives]
        for s, p in same:
            s = -s
            other = sorted((-dot(a[1], c[1]), c[0]) for c in good if c[2] != a[2] and low * s <= 100 * dot(a[1], c[1]) <= high * s)
            out += [(a[0], p, k, n, s, -t) for k, (t, n) in enumerate(other[:negatives], 1)]
    return sorted(out)


def vectors(n=700, seed=3):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0.3, 0.4), 2) for _ in range(5)], r.randint(0, 3)) for i in range(n)]
    rows += [(None, [1.0] * 5, 1), (1001, None, 1), (1002, [1.0] * 5, None), (1003, [1.0, None, 1.0], 1), (1004, [float("nan")] * 5, 1), (1005, [float("inf")] * 5, 1)]
    rows += [rows[3], rows[100], rows[100], (2000, [0.5, 0.5], 1), (2100, [], 1), (2200, [1e9] * 5, 1), (2300, [0.0] * 5, 9)]
    rows += [(3000 + i, [0.5, 0.25, 0.0, 0.0, 0.0], i % 2) for i in range(60)]  # ties
    return rows


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.select("*", F.lit("x").alias("Vec_ID"), F.lit("y").alias("LABEL"), F.lit(1).alias("id"), F.lit(2).alias("rid"), F.lit(3).alias("v"), F.lit(4).alias("tile"))
    out = HN.mine_negatives(df, lambda i: i % 100 == 0, relabel=lambda i, x: F.when(i % 7 == 0, (x + 1) % 10).otherwise(x), **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def test_hard_negatives_equal_the_plain_version(spark, monkeypatch):
    rows = vectors()
    want = plain_negatives(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    monkeypatch.setattr(HN, "CANDIDATE_TILE", 40)
    monkeypatch.setattr(HN, "ANCHOR_TILE", 2)
    monkeypatch.setattr(HN, "FAN", 3)
    assert mined(spark, rows) == want


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (100, [1.0], 2)]) == []


# conversation trie -----------------------------------------------------------

def plain_trie(rows, groups=5, spread=9):
    own = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % spread
        base = c - int(math.fmod(c, groups))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    for k, cs in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = sorted(c for c in cs if len(built[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children.get(k, [])), sum(x not in children for x in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def conversations(seed=5):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(-7, 0), 10**12, 10**12 + 1]:
        for t in range(r.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, t, r.choice(["user", "bot", None]), r.choice(["a", "b", "é 中", "", None, "long " * 50])))
    rows += [(None, 0, "user", "lost"), (70, None, "user", "first"), (70, 0, "user", "second"), (5, 3, "u", "x" * 100_000)]
    rows += [(200 + i, 0, "user", "same") for i in range(40)]
    return [x for i, x in enumerate(rows) if (x[0], x[1]) not in {(y[0], y[1]) for y in rows[:i]}]


def trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("conv"), F.lit(3).alias("d"), F.lit("z").alias("Conv_Id"), F.lit("z").alias("path"))
    return CT.conversation_trie(df.repartition(3))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_equals_the_plain_version(spark):
    rows = conversations()
    out = trie(spark, rows)
    got = sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain_trie(rows)
    arcs = sorted(x for r in out.select("enter_at", "exit_at").collect() for x in r)
    assert arcs == list(range(2 * len(got)))


def test_trie_in_small_blocks(spark, monkeypatch):
    rows = conversations(6)
    monkeypatch.setattr(CT, "BLOCK", 3)
    monkeypatch.setattr(CT, "IDS", 2)
    monkeypatch.setattr(order, "ROWS_PER_BUCKET", 10)
    got = sorted((tuple(r) for r in trie(spark, rows).select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain_trie(rows)


def test_trie_with_repeated_rows_and_without_any(spark):
    rows = [(1, 0, "u", "a")] * 6 + [(2, None, None, None)] + [(7, 0, "u", "a")] * 9
    got = sorted((tuple(r) for r in trie(spark, rows).select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain_trie(rows)
    assert trie(spark, []).collect() == []


# toxicity ---------------------------------------------------------------------

def toxic_corpus(n=900, seed=11):
    r = random.Random(seed)
    sentence = lambda bad: " ".join([f"w{r.randint(0, 300)}x" for _ in range(r.randint(3, 12))] + ([r.choice(["vilebad", "vileness", "scumlike"]) + r.choice(["", "ly", "s"])] if bad else [])) + "."
    docs, labels, where = [], [], {}
    for i in range(n):
        bad = i % 5 == 0
        parts = [sentence(False) for _ in range(r.randint(1, 8))]
        if bad:
            k = r.randrange(len(parts) + 1)
            parts.insert(k, sentence(True))
            where[i] = parts[k]
        docs.append((i, " ".join(parts)))
        if i % 3:
            labels.append((i, int(bad)))
    return docs, labels, where


def test_bag_gradient_against_differences():
    import pyarrow as pa

    r = np.random.default_rng(2)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 1, 0], pa.int32()), pa.array([2, 0, 0, 3]), pa.array([[0, 1, 2], [1], [2, 2], []], pa.list_(pa.int32())), pa.array([[2, 1], [1], [2], []], pa.list_(pa.int32()))], names=["y", "plain", "at", "sizes"])
    w, b = r.normal(size=3), -1.0
    g = TX.bag_gradient(batch, w, b)
    for i in range(4):
        d = np.zeros(4)
        d[i] = 1e-6
        up, down = (TX.bag_gradient(batch, w + s * d[1:], b + s * d[0])[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[1 + i]) < 1e-5


def test_toxicity_finds_held_out_documents_and_sentences(spark):
    docs, labels, where = toxic_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("toxic").alias("TEXT"), F.lit(1).alias("Doc_id"), F.lit(1).alias("y"), F.lit(2).alias("score")).repartition(3)
    y = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int").select("*", F.lit(1).alias("Toxic"))
    model = TX.fit_toxicity(d, y, lambda i: i % 4 != 2)
    out = {r.doc_id: r for r in TX.score_toxicity(d, model).collect()}
    held = [i for i, _ in docs if i % 4 == 2]
    right = sum((out[i].predicted == 1) == (i in where) for i in held) / len(held)
    assert right >= 0.98
    text = dict(docs)
    hits = [text[i][o.start:o.end] for i in held if i in where for o in out[i].offending]
    assert hits and sum(any(h.strip() in s for s in where.values()) for h in hits) >= 0.95 * len(hits)
    # the score is the noisy-or of the sentences
    i = held[0]
    clean, held = 1.0, TX.Slice([text[i].encode()])
    for k in range(len(held.first)):
        words = [held.words[w] for w in held.word[held.sentence == k]]
        clean *= 1 - 1 / (1 + math.exp(-(model.bias + model.word_weights(words).sum())))
    assert abs(out[i].score - (1 - clean)) < 1e-9


def test_toxicity_of_awkward_tables(spark):
    from fixtures import awkward_texts, table

    docs = table(spark)
    none = TX.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    out = TX.score_toxicity(docs, none).collect()
    assert len(out) == len(awkward_texts()) and all(r.score == 0.0 and r.predicted == 0 for r in out)
    model = TX.fit_toxicity(docs, spark.createDataFrame([(5, 1), (5, 0), (6, 1), (10, 0), (2, 1), (1, 0), (99, 1)], "doc_id long, toxic int"))
    out = TX.score_toxicity(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in out) and {r.score for r in out if r.doc_id in (1, 2, 3)} == {0.0}
    assert TX.score_toxicity(docs.limit(0), model).collect() == []


def test_features_do_not_depend_on_their_neighbours():
    words = ["stupid", "Stupid!", "", "...", "a", "x" * 3000, "stupidly", "é中"]
    flat, edges = TX.word_features(words)
    for i, w in enumerate(words):
        alone, _ = TX.word_features([w])
        assert (np.sort(flat[edges[i]:edges[i + 1]]) == np.sort(alone)).all()
    one, two = (set(flat[edges[i]:edges[i + 1]]) for i in (0, 6))
    assert (flat[edges[0]:edges[1]] == flat[edges[1]:edges[2]]).all() and len(one & two) >= 4 and edges[2] == edges[3] == edges[4]


def test_sentences_end_at_stops_lines_and_forty_words():
    many = ["One two. Three!\nfour (five.) six", "", " ".join(f"w{i}" for i in range(100)) + "! End", "é 中。 x"]
    held = TX.Slice([t.encode() for t in many])
    spans = held.spans(np.arange(len(held.first)))
    got = [(int(d), many[d][a:b]) for d, (a, b) in zip(held.doc, spans, strict=True)]
    assert got[:4] == [(0, "One two."), (0, "Three!"), (0, "four (five.)"), (0, "six")]
    assert [len(t.split()) for d, t in got if d == 2] == [40, 40, 20, 1] and [t for d, t in got if d == 3] == ["é 中。", "x"]
    for k, (d, t) in enumerate(got):
        assert {held.words[w] for w in held.word[held.sentence == k]} == set(t.split())
    assert len(TX.Slice([]).first) == 0 and len(TX.Slice([b"", b" \n"]).first) == 0
