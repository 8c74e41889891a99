import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewise.functions import special as SP
from platewise.operators import joins as J
from platewise.operators import pairs as P
from platewise.operators import stats as T


def test_special_values():
    # known values: t with 10 df at 2.228 is 5 %, chi-square 1 df at 3.841 is 5 %
    assert abs(SP.t_two_sided(np.array([2.2281388520]), np.array([10.0]))[0] - 0.05) < 1e-9
    assert abs(SP.gamma_upper(np.array([0.5]), np.array([3.8414588207 / 2]))[0] - 0.05) < 1e-9
    assert abs(SP.digamma(1.0) + 0.5772156649015329) < 1e-12
    assert abs(SP.trigamma(1.0) - math.pi ** 2 / 6) < 1e-12
    assert abs(SP.trigamma(SP.trigamma_inverse(0.3)) - 0.3) < 1e-9


def test_hypergeometric_tail_is_brute_force():
    for a, r, c, n in [(3, 5, 8, 20), (0, 4, 4, 9), (5, 5, 5, 11), (1, 10, 3, 30)]:
        want = sum(math.comb(c, k) * math.comb(n - c, r - k) for k in range(a, min(r, c) + 1) if r - k <= n - c) / math.comb(n, r)
        assert abs(SP.hypergeom_upper(a, r, c, n) - want) < 1e-10


def test_log_gamma(spark):
    from platewise.functions.expr import log_gamma

    xs = [0.5, 1.0, 2.5, 10.0, 1234.5, 1e7]
    got = [r.g for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(log_gamma("x").alias("g")).collect()]
    np.testing.assert_allclose(got, [math.lgamma(x) for x in xs], rtol=1e-11, atol=1e-11)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "hot" if i < 150 else "cold", [float(v) for v in rng.normal(size=5)]) for i in range(170)]
    return spark.createDataFrame(rows, "id int, k string, v array<double>").cache(), rows


@pytest.mark.parametrize("metric", ["angle", "euclid", "corr"])
def test_block_pairs(vectors, metric):
    df, rows = vectors
    got = P.block_pairs(df, ["k"], "id", "v", metric, block=40).toPandas()
    assert len(got) == 150 * 149 // 2 + 20 * 19 // 2 and (got.a < got.b).all()
    v = {i: np.array(x) for i, _, x in rows}
    for r in got.sample(200, random_state=1).itertuples():
        a, b = v[r.a], v[r.b]
        want = {"angle": lambda: math.degrees(math.acos(np.clip(a @ b / np.linalg.norm(a) / np.linalg.norm(b), -1, 1))),
                "euclid": lambda: np.linalg.norm(a - b), "corr": lambda: np.corrcoef(a, b)[0, 1]}[metric]()
        assert abs(r.value - want) < 1e-8


def test_angle_graph_is_the_filtered_matrix(vectors):
    df, _ = vectors
    whole = P.angle_matrix(df, ["k"], "id", "v").where("angle <= 45").toPandas()
    g = P.angle_graph(df, ["k"], "id", "v").toPandas()
    assert set(zip(g.source, g.target)) == set(zip(whole.a, whole.b)) and len(g) > 0


def test_cross_products_and_corr(vectors, monkeypatch):
    df, rows = vectors
    monkeypatch.setattr(P, "FLUSH_VALUES", 10)
    got = P.corr_matrix(df, ["k"], "v").toPandas()
    for k in ("hot", "cold"):
        x = np.array([r[2] for r in rows if r[1] == k])
        c = np.corrcoef(x.T)
        for r in got[got.k == k].itertuples():
            assert abs(r.corr - c[r.i - 1, r.j - 1]) < 1e-10


def test_key_grid_is_the_whole_product(spark):
    a, b = spark.range(37).toDF("a"), spark.range(23).toDF("b")
    got = J.key_grid(a, b, rows_per_block=5)
    assert got.distinct().count() == got.count() == 37 * 23
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_interval_count_brute_force(spark):
    rng = np.random.default_rng(9)
    reads = [(int(rng.integers(0, 3)), int(s), int(s + rng.integers(1, 400))) for s in rng.integers(0, 50_000, 3000)]
    ivs = [(i, int(rng.integers(0, 3)), int(s), int(s + rng.integers(1, 30_000))) for i, s in enumerate(rng.integers(0, 50_000, 60))]
    ivs.append((99, 7, 5, 10))  # a chromosome without reads
    got = J.join_interval_count(spark.createDataFrame(ivs, "id int, c int, a long, b long"), spark.createDataFrame(reads, "c int, s long, e long"), ["id"], "c", "a", "b", "s", "e", width=1000).toPandas().set_index("id")
    for i, c, a, b in ivs:
        assert got["count"][i] == sum(1 for rc, s, e in reads if rc == c and s < b and e > a)


def test_keyed_bind_fails_without_partner(spark):
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(4).withColumn("y", F.lit(2))
    with pytest.raises(Exception, match="one to one"):
        J.join_keyed_bind(a, b, ["id"]).collect()


def test_welch(spark):
    x, y = [1.0, 2.0, 3.0, 4.0, 5.5], [2.0, 3.5, 6.0, 8.0]
    df = spark.createDataFrame([("k", v, False) for v in x] + [("k", v, True) for v in y], "k string, v double, g boolean")
    r = T.ttest_welch(df, ["k"], F.col("g"), "v").first()
    a, b = np.var(x, ddof=1) / 5, np.var(y, ddof=1) / 4
    assert abs(r.t - (np.mean(x) - np.mean(y)) / math.sqrt(a + b)) < 1e-12
    assert abs(r.df - (a + b) ** 2 / (a * a / 4 + b * b / 3)) < 1e-12
    assert 0 < r.p_value < 1


def test_moderated_t(spark):
    rng = np.random.default_rng(6)
    s2 = 0.5 / rng.chisquare(8, 400) * 8 * rng.chisquare(6, 400) / 6
    df = spark.createDataFrame([(i, float(v), 0.1, float(s), 6) for i, (v, s) in enumerate(zip(rng.normal(size=400), s2))], "p int, estimate double, unscaled double, sigma2 double, df long").withColumn("term", F.lit("t"))
    out = T.moderated_t(df, "p", ["term"]).toPandas()
    e = np.log(s2) - SP.digamma(3) + math.log(3)
    d0 = 2 * SP.trigamma_inverse(e.var(ddof=1) - SP.trigamma(3))
    s0 = math.exp(e.mean() + SP.digamma(d0 / 2) - math.log(d0 / 2))
    assert np.allclose(out.d0, d0, rtol=1e-6) and np.allclose(out.s0_2, s0, rtol=1e-6)
    row = out[out.p == 3].iloc[0]
    assert abs(row.t - row.estimate / math.sqrt((d0 * s0 + 6 * s2[3]) / (d0 + 6) * 0.1)) < 1e-6


def test_lasso_satisfies_its_optimality_conditions(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 6))
    y = 2 * x[:, 0] - x[:, 3] + 0.5 + rng.normal(size=300) * 0.3
    names = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([("k", i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "k string, id int, " + ", ".join(f"{n} double" for n in names) + ", y double")
    out = T.lasso_per_key(df, ["k"], ["id"], names, "y", folds=5, lambdas=20).toPandas().set_index("term")
    b = np.array([out.coef.get(n, 0.0) for n in names])
    lam = out.lam.iloc[0]
    grad = (x / x.std(axis=0)).T @ (y - out.coef["(Intercept)"] - x @ b) / 300
    assert abs(b[0] - 2) < 0.2 and abs(b[3] + 1) < 0.2
    for g, c in zip(grad, b):
        assert abs(g - math.copysign(lam, c)) < 1e-6 if c else abs(g) <= lam + 1e-6


def test_gsea_brute_force(spark, pieces):
    rng = np.random.default_rng(10)
    score = rng.normal(size=300)
    genes = [f"g{i}" for i in range(300)]
    sets = {f"s{k}": sorted(rng.choice(genes, 25, replace=False)) for k in range(4)}
    df = spark.createDataFrame(list(zip(genes, map(float, score))), "gene string, score double")
    st = spark.createDataFrame([(g, s) for s, m in sets.items() for g in m], "gene string, gs string")
    got = T.gsea_running_sum(df, st, [], "gene", "score", "gs").toPandas().set_index("gs")
    order = np.argsort(-score)
    for s, m in sets.items():
        hit = np.array([genes[i] in m for i in order])
        w = np.abs(score[order]) * hit
        curve = np.cumsum(w) / w.sum() - np.cumsum(~hit) / (~hit).sum()
        es = curve[np.argmax(np.abs(curve))]
        assert abs(got.es[s] - es) < 1e-9


def test_weibull_solves_the_likelihood_equation(spark):
    rng = np.random.default_rng(11)
    v = rng.weibull(1.7, 500) * 30
    fit = T.weibull_fit(spark.createDataFrame([("k", float(x)) for x in v], "k string, v double"), ["k"], "v").first()
    k = fit.shape
    assert abs((v ** k * np.log(v)).sum() / (v ** k).sum() - 1 / k - np.log(v).mean()) < 1e-9
    assert abs(fit.scale - (v ** k).mean() ** (1 / k)) < 1e-6


def test_contingency_mc(spark):
    even = spark.createDataFrame([("a" if i % 2 else "b", i // 2 % 2) for i in range(80)], "r string, c int")
    tied = spark.createDataFrame([("a" if i % 2 else "b", i % 2) for i in range(80)], "r string, c int")
    assert T.contingency_mc_test(even, "r", "c", 200).first().p_value > 0.9
    assert T.contingency_mc_test(tied, "r", "c", 200).first().p_value == pytest.approx(1 / 201)


def test_two_factor_ols(spark):
    rng = np.random.default_rng(13)
    a, b = rng.integers(0, 3, 200), rng.integers(0, 2, 200)
    y = 1 + np.array([0, 2, -1])[a] + 0.5 * b + rng.normal(size=200)
    df = spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in zip(a, b, y)], "a int, b int, y double")
    got = T.ols_terms(df, [], "y", {"a": [0, 1, 2], "b": [0, 1]}).toPandas().set_index("term")
    x = np.column_stack([np.ones(200), a == 1, a == 2, b == 1]).astype(float)
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / 196)
    np.testing.assert_allclose(got.loc[["(Intercept)", "a1", "a2", "b1"]].estimate, beta, rtol=1e-8)
    np.testing.assert_allclose(got.loc[["(Intercept)", "a1", "a2", "b1"]].std_error, se, rtol=1e-8)


def test_fitted_curve_recovers_a_hill_curve(spark):
    c = [0.0016, 0.008, 0.04, 0.2, 1.0]
    rows = [("l", "d", x, 1 / (1 + (x / 0.05) ** 1.5)) for x in c]
    r = T.dose_auc_fitted(spark.createDataFrame(rows, "line string, drug string, c double, v double"), ["line", "drug"], "c", "v").first()
    assert abs(math.log(r.ec50 / 0.05)) < 0.01 and abs(r.hill - 1.5) < 0.02 and 0 < r.auc < 1


def test_polyline(spark):
    path = spark.createDataFrame([("k", 1, 0.0, 0.0), ("k", 2, 10.0, 0.0), ("k", 3, 10.0, 10.0)], "k string, s int, x double, y double")
    pts = spark.createDataFrame([("k", 1, 5.0, 2.0), ("k", 2, 12.0, 5.0), ("k", 3, -3.0, -4.0)], "k string, id int, x double, y double")
    got = T.project_to_polyline(pts, path, ["k"], ["id"], "x", "y", "s").toPandas().set_index("id")
    assert list(got.dist) == [2.0, 2.0, 5.0] or got.dist[[1, 2, 3]].tolist() == [2.0, 2.0, 5.0]
    assert got["lambda"][[1, 2, 3]].tolist() == [5.0, 15.0, 0.0]
    assert got.on_path[[1, 2, 3]].tolist() == [True, True, False]


def test_polyline_of_many_groups(spark, monkeypatch):
    """Paths of unlike length, in slices, against the plain search; a point was a chain of interpreted array functions before."""
    monkeypatch.setattr(T, "POLYLINE_NUMBERS", 50)
    rng = np.random.default_rng(2)
    paths = {k: rng.normal(size=(m, 2)) for k, m in enumerate([1, 2, 5, 9])}
    paths[2][3] = paths[2][2]  # a segment without length
    path = spark.createDataFrame([(k, i, *map(float, v)) for k, p in paths.items() for i, v in enumerate(p)], "k int, s int, x double, y double")
    at = rng.normal(size=(200, 2)) * 2
    rows = [(i % 4, i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(1, 900, None, 0.0), (1, 901, float("nan"), 0.0)]
    out = T.project_to_polyline(spark.createDataFrame(rows, "k int, id int, x double, y double"), path, ["k"], ["id"], "x", "y", "s")
    got = {r.id: r for r in out.collect()}
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString() and len(got) == 152
    for i, p in enumerate(at):
        if i % 4:
            a, d = paths[i % 4][:-1], np.diff(paths[i % 4], axis=0)
            length = np.sqrt((d * d).sum(1))
            t = np.clip(np.where(length > 0, ((p - a) * d).sum(1) / np.maximum(length, 1e-300) ** 2, 0), 0, 1)
            far = np.sqrt(((p - a - t[:, None] * d) ** 2).sum(1))
            j = far.argmin()
            np.testing.assert_allclose([got[i].dist, got[i]["lambda"]], [far[j], length[:j].sum() + t[j] * length[j]], atol=1e-12)
    assert got[900].dist == got[901].dist == math.inf and got[900]["lambda"] == 0


def test_greedy_decorrelate():
    c = pd.DataFrame([(1, 1, 1.0), (1, 2, 0.9), (1, 3, 0.1), (2, 2, 1.0), (2, 3, 0.2), (3, 3, 1.0)], columns=["i", "j", "corr"])
    assert [f for f, _ in T.greedy_decorrelate(c, ["a", "b", "c"], ["a"], 0.85)] == ["a", "c"]


def test_bootstrap_deals_a_short_table_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "DRAWS_PER_TASK", 1000)
    df = spark.range(500).select(F.col("id"), (F.col("id") * F.col("id") % 97).cast("double").alias("v")).coalesce(1)
    out = T.bootstrap_moments(df, ["id"], "v", 20)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()  # one task drew all before
    assert out.count() == 20


def test_interval_bins_follow_the_intervals(spark):
    """Short intervals are met by near points only; before, all points of 10,000 positions were compared."""
    iv = spark.range(500).select(F.col("id").alias("iv"), F.lit("1").alias("c"), (F.col("id") * 20).alias("a"), (F.col("id") * 20 + 10).alias("b"))
    pt = spark.range(10_000).select(F.col("id").alias("p"), F.lit("1").alias("c"))
    out = J.join_interval_points(pt, iv, "c", "p", "a", "b")
    assert "/ 10)" in out._jdf.queryExecution().optimizedPlan().toString().replace(".0", "")
    assert out.count() == 500 * 9
    assert J.join_interval_points(pt, iv.withColumn("b", F.col("a") - 5), "c", "p", "a", "b").count() == 0


def test_pairs_of_floats_travel_as_floats_and_are_exact(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 5)).astype(np.float32)
    df = spark.createDataFrame([("k", i, [float(v) for v in r]) for i, r in enumerate(x)], "k string, id int, v array<float>")
    pairs = P.block_pairs(df, ["k"], "id", "v", "euclid", block=40)
    shuffled = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(v" not in shuffled and P.BLOCK > 512
    got = pairs.toPandas()
    assert len(got) == 90 * 89 // 2
    d = x.astype(float)
    np.testing.assert_array_equal(got.value, np.sqrt(((d[got.a] - d[got.b]) ** 2).sum(axis=1)))
