"""Many forests at once, the blur filter and the whole preprocessing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import forest as T
from platewise.operators import newton as W
from platewise.operators import qc as Q


def table(spark, n=600, plates=3, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=3)
        rows.append((i, f"p{i % plates}", float(x[0]), float(x[1]), float(x[2]), bool((x[0] > 0.3) ^ (x[1] > 0))))
    return spark.createDataFrame(rows, "id int, plate string, a double, b double, c double, y boolean")


def all_features(df, keys, features):
    return T.one_choice(df.select(T.group_key(keys).alias("g")), features)


@pytest.fixture(params=[False, True], ids=["whole", "blocks"])
def blocks(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(T, "BLOCK_ROWS", 70)
        monkeypatch.setattr(T, "PACK_TREES", 3)
        monkeypatch.setattr(W, "PACK_BUCKETS", 2)
        monkeypatch.setattr(W, "FAN", 2)


def plain_tree(pack, t, codes, y, r, depth, least=1.0):
    """The tree of a pack grown again by recursion over the rows."""
    tree = int(pack["trees"][t])
    w = np.searchsorted(T.POISSON, T.spread64(r, tree + 1) / 2.0**64).astype(float)
    feat, value = {}, {}

    def grow(node, at):
        n1, n = w[at][y[at] == 1].sum(), w[at].sum()
        value[node] = n1 / n if n else 0.5
        if 2 * node + 2 >= 2 ** (depth + 1) - 1:
            return
        best = (1e-9, None)
        for f in T.looked_at({"allowed": np.array(pack["allowed"])}, tree, np.array([node]))[0]:
            for b in range(T.BINS):
                left = at & (codes[:, f] <= b)
                right = at & ~left
                nl, nr = w[left].sum(), w[right].sum()
                if nl < least or nr < least:
                    continue
                sq = lambda m: sum(w[m][y[m] == k].sum() ** 2 for k in (0, 1))
                gain = sq(left) / nl + sq(right) / nr - sq(at) / n
                if gain > best[0] * (1 + 1e-12):
                    best = (gain, (int(f), b, left, right))
        if best[1]:
            feat[node] = best[1][:2]
            grow(2 * node + 1, best[1][2])
            grow(2 * node + 2, best[1][3])

    grow(0, np.ones(len(y), bool) & (w > 0))
    return feat, value


def test_forests_equal_their_plain_growth(spark, blocks):
    df = table(spark, 300, 2)
    forests = T.grow_forests(df, ["plate"], ["id"], ["a", "b", "c"], F.col("y"), all_features(df, ["plate"], ["a", "b", "c"]), trees=5, depth=3).collect()
    assert sorted(t for p in forests if "p0" in p.g for t in p.trees) == list(range(5))
    rows = {r.id: r for r in df.withColumn("r", F.xxhash64("id")).collect()}
    for pack in forests:
        mine = [r for r in rows.values() if r.plate in pack.g]
        x, y, r = np.array([[m.a, m.b, m.c] for m in mine]), np.array([int(m.y) for m in mine]), np.array([m.r for m in mine])
        codes = T.binned(x, np.array(pack.cuts))
        size = len(pack.feat) // len(pack.trees)
        for t in range(len(pack.trees)):
            feat, value = plain_tree(pack.asDict(), t, codes, y, r, 3)
            got = {i: (pack.feat[t * size + i], pack.bin[t * size + i]) for i in range(size) if pack.feat[t * size + i] >= 0}
            assert got == feat
            for i, v in value.items():
                assert abs(pack.value[t * size + i] - v) < 1e-9


def test_forests_learn_an_interaction(spark):
    df = table(spark, 1200, 2)
    forests = T.grow_forests(df.where("id < 900"), ["plate"], ["id"], ["a", "b", "c"], F.col("y"), all_features(df, ["plate"], ["a", "b", "c"]), trees=30)
    out = T.score_forests(df.where("id >= 900"), forests, ["plate"], ["id"], ["a", "b", "c"]).collect()
    assert len(out) == 300 and np.mean([(r.prob > 0.5) == r.y for r in out]) > 0.85


def objects(spark, seed=6):
    """Two plates; every third object is blurry: dim, and soft by features that the labels don't use."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(900):
        blurry = i % 3 == 0
        light = rng.normal(2 if blurry else 8, 0.8)
        rows.append((i, 1, i % 2, bool(i % 5 == 0), float(light), float(light + rng.normal(0, 0.1)), float(rng.normal(1 if blurry else 4, 0.7)), float(rng.normal(blurry * 3, 0.7)), 7.0, float(rng.normal()), 500.0 + i % 400, 10.0, 1000.0, 1000.0, blurry))
    return spark.createDataFrame(rows, "id int, line int, plate int, ctrl boolean, mean_a double, copy double, edge double, soft double, flat double, noise double, size double, radius double, cx double, cy double, blurry boolean")


FEATURES = ["mean_a", "copy", "edge", "soft", "flat", "noise"]


def test_blur_choices_leave_out_labelling_and_constant_features(spark):
    df = objects(spark)
    sample = Q.blur_label(df, ["plate"], ["mean_a"], ["id"])
    for r in Q.blur_choices(sample, ["plate"], FEATURES, ["mean_a"]).collect():
        assert not {0, 1, 4} & set(r.allowed) and {5} <= set(r.allowed)


def test_blurry_rows_go(spark, blocks):
    df = objects(spark)
    out = Q.blur_classifier_filter(df, ["plate"], FEATURES, ["mean_a"], ["id"], trees=30, limit=0.97).collect()
    kept = {r.id for r in out}
    assert len(kept) == len(out) and out[0].asDict().keys() == set(df.columns)
    blurry, sharp = ([r.id for r in df.collect() if r.blurry == b] for b in (True, False))
    assert len(kept & set(blurry)) < 0.05 * len(blurry) and len(kept & set(sharp)) > 0.9 * len(sharp)


def test_preprocess_line_has_four_steps(spark):
    df = objects(spark)
    odd = df.where("id = 1").withColumn("id", F.lit(5000)).withColumn("size", F.lit(10.0))
    edge = df.where("id = 1").withColumn("id", F.lit(5001)).withColumn("cx", F.lit(3.0))
    out = Q.preprocess_line(df.unionByName(odd).unionByName(edge), "line", "plate", F.col("ctrl"), ["id"], FEATURES, "size", "radius", "cx", "cy", ["mean_a"], trees=20)
    got = out.collect()
    assert not {5000, 5001} & {r.id for r in got} and sum(r.blurry for r in got) < 0.1 * len(got) and out.columns == df.columns
    mid = {p: np.median([r.edge for r in got if r.ctrl and r.plate == p]) for p in (0, 1)}
    assert abs(mid[0] - mid[1]) < 1e-9


def test_plates_without_usable_features_keep_their_rows(spark):
    df = spark.createDataFrame([(i, 0, float(i), None if i % 4 else float("nan")) for i in range(20)], "id int, plate int, light double, dark double")
    assert Q.blur_classifier_filter(df, ["plate"], ["light", "dark"], ["light"], ["id"], trees=3).count() == 20
    assert Q.blur_classifier_filter(df.limit(0), ["plate"], ["light", "dark"], ["light"], ["id"], trees=3).count() == 0


def test_lines_transfer_and_channels_sweep_in_one_growth(spark):
    from platewise.operators import learn as L

    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        line, dead = i % 3, float(rng.random() < 0.5)
        a = rng.normal(3 * dead if line < 2 else -3 * dead)  # the third line goes the other way
        rows.append((i, line, dead, float(a), float(rng.normal(4 * dead)), float(rng.normal()), "train" if i < 600 else "test"))
    df = spark.createDataFrame(rows, "id int, line int, dead double, a double, b double, c double, split string")
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    out = {(r.line, r.model_line): r for r in L.transfer_matrix(train, test, "line", ["id"], ["a", "c"], "dead").collect()}
    assert len(out) == 9 and all(r.n == 100 for r in out.values())
    assert all((out[i, j].accuracy > 0.85) == ((i < 2) == (j < 2)) for i in range(3) for j in range(3))
    sweep = {r.channels: r for r in L.channel_combo_sweep(df, {"x": ["a"], "y": ["b"], "z": ["c"]}, [("x",), ("y",), ("z",), ("x", "y", "z")], ["id"]).collect()}
    assert sweep["y"].accuracy > 0.93 and sweep["z"].accuracy < 0.65 and sweep["x_y_z"].accuracy > 0.93 and sweep["x"].accuracy < 0.9


def test_small_groups_grow_in_one_pass_like_blocks(spark, monkeypatch):
    """The trees of a plate are the same whether its rows are one block or several, and one block needs one meeting."""
    df = table(spark, 240, 2)
    grow = lambda: {(r.g, r["pack"]): r for r in T.grow_forests(df, ["plate"], ["id"], ["a", "b", "c"], F.col("y"), all_features(df, ["plate"], ["a", "b", "c"]), 4, 4).collect()}
    calls, real = [], T.meet
    monkeypatch.setattr(T, "meet", lambda *a: calls.append(1) or real(*a))
    whole = grow()
    assert len(calls) == 1  # one for every level before
    monkeypatch.setattr(T, "BLOCK_ROWS", 40)
    split = grow()
    assert len(whole) == 2 and whole.keys() == split.keys()
    for key, r in whole.items():
        assert (r.feat, r.bin, r.value, r.weight) == (split[key].feat, split[key].bin, split[key].value, split[key].weight)


def test_nodes_and_whole_arrays_score_alike_and_nodes_are_few(spark, blocks):
    df = table(spark, 300, 2)
    args = df, ["plate"], ["id"], ["a", "b", "c"], F.col("y"), all_features(df, ["plate"], ["a", "b", "c"])
    nodes, whole = T.grow_nodes(*args, trees=5), T.grow_forests(*args, trees=5)
    scores = [{r.id: r.prob for r in T.score_forests(df, f, ["plate"], ["id"], ["a", "b", "c"]).collect()} for f in (nodes, whole)]
    assert scores[0] == scores[1] and len(scores[0]) == 300
    sizes = lambda f, c: sum(len(r[c]) for r in f.collect())
    assert sizes(nodes, "split") == sizes(nodes, "value") < sizes(whole, "feat") / 5
