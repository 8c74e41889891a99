import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import learn as L
from platewise.operators import newton as W


def fit_numpy(x, y, c, steps=50):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    pen = np.full(len(b), 1 / c)
    pen[0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (p - y) + pen * b)
    return b


@pytest.fixture(scope="module")
def screen(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        line, drug = i % 2, ["DMSO", "A", "B"][i % 3]
        rows.append((i, line, drug, drug == "DMSO", float(rng.normal(1.5 if drug == "A" else 0)), float(rng.normal())))
    return spark.createDataFrame(rows, "id int, line int, drug string, ctrl boolean, x double, y double").cache(), rows


def plain_auc(score, case):
    a, b = score[case], score[~case]
    return float((a[:, None] > b[None, :]).mean() + (a[:, None] == b[None, :]).mean() / 2) if len(a) and len(b) else None


@pytest.fixture(params=[False, True], ids=["whole", "blocks"])
def blocks(request, monkeypatch):
    """Force many blocks, packs and buckets on small data."""
    if request.param:
        for name, value in {"BLOCK_ROWS": 60, "PACK_MODELS": 4, "PACK_BUCKETS": 2, "SLICE": 100, "FAN": 2}.items():
            monkeypatch.setattr(W, name, value)


def test_all_models_equal_their_plain_fits(spark, screen, blocks):
    df, rows = screen
    parts = L.classifier_parts(df, ["line"], "drug", F.col("ctrl"), ["id"], ["x", "y"], 2, 3)
    names, packs = L.drug_models(parts, [0.1, 1.0], 2, 3)
    data = {r.r: r for r in parts.rows.collect()}
    keys = {r.g: r for r in names.collect()}
    assert len(keys) == 2 and names.count() == 4
    got = L.coefficients(packs, parts.width).collect()
    auc = {(r.g, r.k, r.fold): r.auc for r in L.areas(parts, packs).collect()}
    assert len(got) == 12 == len(auc)
    for m in got:
        mine = [d for d in data.values() if d.g == m.g and not d.half and d.k in (None, m.k)]
        x, y, fold = np.array([d.x for d in mine]), np.array([d.k is not None for d in mine]), np.array([d.fold_m for d in mine])
        train = fold != m.fold
        want = fit_numpy(x[train][:, 1:], y[train].astype(float), m.c)
        np.testing.assert_allclose(m.beta, want, atol=1e-6)
        assert abs(auc[m.g, m.k, m.fold] - plain_auc(x[~train] @ want, y[~train])) < 1e-9


def test_optimum_is_reported(spark, screen):
    df, _ = screen
    out = L.drug_model_fits(df, ["line"], "drug", F.col("ctrl"), ["id"], ["x", "y"], [0.5], folds=3).collect()
    assert len(out) == 12
    for r in out:
        assert r.slope < 1e-4 and abs(r.mean_p - r.n_case / r.n_train) < 1e-6


def test_classifier_tells_active_from_inactive(screen):
    df, _ = screen
    out = L.drug_vs_control_classifier(df, ["line"], "drug", F.col("ctrl"), ["id"], ["x", "y"], c_grid=[0.1, 1.0], param_folds=2, folds=3).toPandas().set_index(["line", "drug"])
    assert (out.auc_mean.xs("A", level="drug") > 0.75).all() and (out.auc_mean.xs("B", level="drug") < 0.7).all()
    assert (out.mean_x.xs("A", level="drug") > 0.3).all()


def test_permuted_labels_are_as_many_as_the_real_ones(spark, screen, blocks):
    df, _ = screen
    parts = L.classifier_parts(df, ["line"], "drug", F.col("ctrl"), ["id"], ["x", "y"], 2, 3, "perm")
    names = parts.names.withColumn("c", F.lit(0.5))
    packs = W.with_limits(parts, W.start_packs(names, True, parts.width, [(None, 0, p) for p in range(6)])).collect()
    rows = parts.rows.collect()
    for pack in packs:
        mine = [r for r in rows if r.g == pack.g and not r.half and r.k in (None, pack.k)]
        r = np.array([x.r for x in mine])
        for p, limit in zip(pack.perms, pack.limits, strict=True):
            if p:
                assert (W.mixed(r, np.array([p]))[:, 0].astype(np.int64) <= limit).sum() == pack.n_case


def test_permutation_p_separates_active_from_inactive(spark, screen):
    df, _ = screen
    out = L.classifier_permutation_p(df, ["line"], "drug", F.col("ctrl"), ["id"], ["x", "y"], permutations=39, c_grid=[0.1, 1.0], param_folds=2, folds=3).collect()
    p = {(r.line, r.drug): r.p_value for r in out}
    assert len(p) == 4 and all(p[i, "A"] == 1 / 40 for i in (0, 1)) and all(p[i, "B"] > 1 / 40 for i in (0, 1))


def test_control_splits_center_on_a_half(spark, screen):
    df, _ = screen
    out = L.control_split_null(df, "line", F.col("ctrl"), ["id"], ["x", "y"], splits=20, c=0.1, folds=3).toPandas()
    assert len(out) == 40 and abs(out.auc_mean.mean() - 0.5) < 0.08 and sorted(set(out.split)) == list(range(1, 21))


def test_classifiers_of_awkward_tables(spark, screen):
    df, _ = screen
    odd = df.limit(0).unionByName(spark.createDataFrame(
        [(1, 5, "A", False, 1.0, 1.0), (2, 5, "A", False, 2.0, 1.0), (3, 6, "DMSO", True, 1.0, 1.0), (4, 7, "B", False, None, 1.0), (5, 7, "DMSO", True, float("nan"), 1.0), (6, 7, "DMSO", None, 1.0, 1.0)],
        "id int, line int, drug string, ctrl boolean, x double, y double"))
    out = L.drug_vs_control_classifier(odd, ["line"], "drug", F.col("ctrl"), ["id"], ["x", "y"], c_grid=[0.1, 1.0], param_folds=2, folds=2).collect()
    assert {r.line for r in out} <= {5, 7} and all(r.auc_mean is None for r in out)


def test_auc_of_a_constant_score_is_half(spark):
    df = spark.createDataFrame([(1.0, i % 3 == 0) for i in range(30)], "s double, y boolean")
    assert L.auc_rank(df, [], "s", F.col("y")).first().auc == 0.5


def test_roc_area_equals_rank_auc(spark, pieces):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(round(v, 1)), bool(rng.random() < 1 / (1 + np.exp(-v)))) for v in rng.normal(size=400)], "s double, y boolean")
    roc = L.roc_curve(df, [], "s", F.col("y")).toPandas().sort_values("threshold", ascending=False)
    area = np.trapezoid(np.r_[0, roc.tpr], np.r_[0, roc.fpr])
    assert abs(area - L.auc_rank(df, [], "s", F.col("y")).first().auc) < 1e-12


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    fit = L.pca_fit(df, list("abcd"), 4)
    s = np.array([r.pc for r in fit.transform(df).orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    lam = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    np.testing.assert_allclose(s.var(axis=0, ddof=1), lam, rtol=1e-8)
    np.testing.assert_allclose(fit.explained, lam / lam.sum(), rtol=1e-8)
    assert (fit.components[np.abs(fit.components).argmax(axis=0), range(4)] > 0).all()


def test_pca_samples_matches_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 5))
    df = spark.createDataFrame([(i, f"s{j}", float(x[i, j])) for i in range(100) for j in range(5)], "item int, s string, v double")
    got = L.pca_samples(df, "item", "s", "v", [f"s{j}" for j in range(5)], 2).toPandas()
    u, sv, _ = np.linalg.svd((x - x.mean(axis=1, keepdims=True)).T, full_matrices=False)
    for k in (0, 1):
        g = got[got.component == k + 1].sort_values("s").score.to_numpy()
        np.testing.assert_allclose(np.abs(g), np.abs(u[:, k] * sv[k]), rtol=1e-6)


def test_characteristic_row_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4)) * [1, 2, 3, 4] + rng.normal(size=(80, 1))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got = L.characteristic_rows(df, [], ["id"], list("abcd"), n=3).toPandas().sort_values("distance")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    lam, vec = np.linalg.eigh(np.cov(z.T))
    lam, vec = lam[::-1], vec[:, ::-1]
    keep = np.cumsum(lam) / lam.sum() < 0.9
    s = z @ vec[:, keep]
    d = np.sqrt((((s - np.median(s, axis=0)) ** 2) / lam[keep]).sum(axis=1))
    assert list(got.id) == list(np.argsort(d)[:3])
    np.testing.assert_allclose(got.distance, np.sort(d)[:3], rtol=1e-8)


def test_factor_roundtrip(spark):
    w = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 2.0]])
    z = np.array([[1.0, -1.0], [0.5, 3.0]])
    df = spark.createDataFrame([(i, [float(v) for v in w @ r]) for i, r in enumerate(z)], "id int, v array<double>")
    out = L.factor_reconstruct(L.factor_project(df, "v", w), ["factor1", "factor2"], w).orderBy("id").collect()
    np.testing.assert_allclose([[r.factor1, r.factor2] for r in out], z)
    np.testing.assert_allclose([r.reconstructed for r in out], [r.v for r in out])


def test_control_splits_use_every_control(spark, screen, blocks):
    """Each split deals all controls of its line: half of them play the cases, and every row searches or is classified."""
    df, _ = screen
    parts = L.classifier_parts(df.where("ctrl"), ["line"], None, F.lit(True), ["id"], ["x", "y"], 2, 3, "null")
    names = parts.names.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("c", F.lit(0.5))
    rows = parts.rows.collect()
    sides = {main: W.with_limits(parts, W.split_packs(names, main, parts.width, [(None, f) for f in range(3)])).collect() for main in (False, True)}
    used = {g: set() for g in {r.g for r in rows}}
    for one, two in zip(*[sorted(s, key=lambda p: (p.g, p.split)) for s in sides.values()], strict=True):
        mine = [r for r in rows if r.g == one.g]
        r = np.array([x.r for x in mine])
        assert one.limits == two.limits and (W.mixed(r, np.array([one.split]))[:, 0].astype(np.int64) <= one.limits[0]).sum() == len(r) // 2
        halves = [W.fold_of({"r": r}, {"split": p.split, "main": p.main, "folds": np.array(p.folds)})[0]["r"] for p in (one, two)]
        assert sorted(np.concatenate(halves)) == sorted(r) and min(map(len, halves)) > 0
        used[one.g] |= set(halves[1])
    assert all(len(used[g]) > 0.7 * sum(r.g == g for r in rows) for g in used)


def test_areas_of_many_blocks_equal_those_of_one(spark, screen, monkeypatch):
    df, _ = screen
    tied = df.withColumn("x", F.round("x", 1))
    out = []
    for rows in (10_000, 60):
        monkeypatch.setattr(W, "BLOCK_ROWS", rows)
        monkeypatch.setattr(W, "CASE_NUMBERS", 40 if rows == 60 else 500_000)
        out.append([L.drug_vs_control_classifier(tied, ["line"], "drug", F.col("ctrl"), ["id"], ["x", "y"], c_grid=[0.1, 1.0], param_folds=2, folds=3).toPandas(),
                    L.control_split_null(tied, "line", F.col("ctrl"), ["id"], ["x", "y"], splits=2, c_grid=[0.1, 1.0], folds=3).toPandas()])
    for a, b in zip(*out, strict=True):
        keys = list(a.columns[:2])
        a, b = (t.sort_values(keys).reset_index(drop=True) for t in (a, b))
        assert len(a) == 4 and (a[keys] == b[keys]).all().all()
        np.testing.assert_allclose(a.drop(columns=keys).to_numpy(float), b.drop(columns=keys).to_numpy(float), atol=1e-5)
