import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewise.operators import normalize as N
from platewise.operators import qc as Q


@pytest.fixture(scope="module")
def plates(spark):
    rng = np.random.default_rng(5)
    rows = []
    for plate in range(4):
        for i in range(300):
            rows.append((f"u{plate}_{i}", "L1" if plate < 3 else "L2", plate, i % 3 == 0, float(rng.normal(plate * 5, 1 + plate)), float(rng.gamma(2.0))))
    rows += [("nc", "L1", 9, False, 1.0, 1.0)]  # a plate without controls
    return spark.createDataFrame(rows, "uuid string, line string, plate int, ctrl boolean, x double, g double").cache()


def mad(v):
    return np.median(np.abs(v - np.median(v)))


@pytest.mark.parametrize("hot", [False, True])
def test_plate_effect_invariant(plates, hot, request):
    if hot:
        request.getfixturevalue("pieces")
    before = plates.toPandas()
    out = N.plate_effect_correct(plates, "line", "plate", F.col("ctrl"), ["x", "g"]).toPandas()
    assert out[out.uuid == "nc"].x.isna().all() and len(out) == len(before)
    c = before[before.ctrl & (before.line == "L1")]
    centre = c.groupby("plate").x.median().median()
    spread = c.groupby("plate").x.apply(mad).median()
    after = out[out.ctrl & (out.line == "L1")]
    for _, sub in after.groupby("plate"):
        assert np.isclose(sub.x.median(), centre) and np.isclose(mad(sub.x), spread)


def test_vector_form_agrees(plates):
    a = N.plate_effect_correct(plates, "line", "plate", F.col("ctrl"), ["x", "g"]).select("uuid", "x", "g").toPandas().set_index("uuid").sort_index()
    v = plates.select("uuid", "line", "plate", "ctrl", F.array("x", "g").alias("features"))
    b = N.plate_effect_correct_vector(v, "line", "plate", F.col("ctrl")).toPandas().set_index("uuid").sort_index()
    for u in ("u0_0", "u2_17", "u3_299"):
        np.testing.assert_allclose(b.features[u], a.loc[u].to_numpy(float))


def test_zero_mad_gives_null(spark):
    df = spark.createDataFrame([("L", 1, True, 5.0)] * 3 + [("L", 1, False, 6.0), ("L", 2, True, 1.0), ("L", 2, True, 2.0)], "line string, plate int, ctrl boolean, x double")
    out = N.plate_effect_correct(df, "line", "plate", F.col("ctrl"), ["x"]).where("plate = 1").toPandas()
    assert out.x.isna().all()


def test_batch_effect(spark):
    rng = np.random.default_rng(0)
    rows = [("one", float(v)) for v in rng.normal(0, 1, 101)] + [("two", float(v)) for v in rng.normal(10, 3, 101)]
    df = spark.createDataFrame(rows, "line string, x double")
    out = N.batch_effect_correct(df, "line", F.col("line") == "one", F.col("line") == "two", F.col("line") == "two", ["x"]).toPandas()
    a, b = out[out.line == "one"].x, out[out.line == "two"].x
    assert np.isclose(a.median(), b.median()) and np.isclose(mad(a), mad(b))


def skew(v):
    d = v - v.mean()
    return (d ** 3).mean() / (d ** 2).mean() ** 1.5


def test_boxcox_lambda_is_the_root(plates):
    lam = N.boxcox_lambda(plates.where("ctrl").select("plate", "g"), ["plate"], "g").toPandas().set_index("plate")
    pdf = plates.where("ctrl").toPandas()
    for plate, sub in pdf.groupby("plate"):
        v = np.sort(sub.g.to_numpy())
        k = int(0.05 * len(v))
        v = v[k:len(v) - k]
        v = (v - v.min()) / (v.max() - v.min()) + 1e-6
        f = lambda l: abs(skew((v ** l - 1) / l if l > 0 else np.log(v)))
        best = min(f(l) for l in np.linspace(0, 1, 2001)[1:])
        assert abs(lam.abs_skew[plate] - f(lam.lam[plate])) < 1e-6
        assert lam.abs_skew[plate] <= best + 1e-3


def test_boxcox_keeps_median_and_mad(plates):
    out = N.boxcox_transform(plates.where("plate < 9"), "plate", F.col("ctrl"), ["uuid"], ["g"]).toPandas()
    raw = plates.toPandas()
    for plate, sub in out.groupby("plate"):
        r = raw[raw.plate == plate].g
        assert np.isclose(sub.value.median(), r.median()) and np.isclose(mad(sub.value), mad(r))


def test_boxcox_of_a_plate_in_a_task_is_that_of_the_long_form(spark, plates, monkeypatch):
    """Plates that fit a task pass one shuffle; every row went by long form through a search of joins before."""
    odd = [("c1", "L1", 20, True, 2.0, 2.0), ("c2", "L1", 20, True, 2.0, 3.0), ("c3", "L1", 20, False, 5.0, None), ("c4", "L1", 20, True, 2.0, 7.0),
           ("k0", "L1", 21, True, 1.5, 2.0), ("k1", "L1", 21, True, 1.0, 1.0), ("k2", "L1", 21, True, 2.0, float("nan")), ("k3", "L1", 21, True, 4.0, 7.0), ("k4", "L1", None, True, 1.0, 1.0), ("k5", "L1", None, False, 3.0, 3.0)]
    df = plates.unionByName(spark.createDataFrame(odd, plates.schema))
    run = lambda: {(r.uuid, r.feature): (r.value, r.lam) for r in N.boxcox_transform(df, "plate", F.col("ctrl"), ["uuid"], ["x", "g"]).collect()}
    slow = N.boxcox_lambda
    monkeypatch.setattr(N, "boxcox_lambda", None)
    fast = run()
    monkeypatch.setattr(N, "boxcox_lambda", slow)
    monkeypatch.setattr(N.radix, "TASK_VALUES", 5)  # all but the smallest plate by long form
    assert len(fast) == 2 * df.count()
    others = run()
    assert fast.keys() == others.keys()
    for k, (value, lam) in others.items():
        for a, b in ((value, fast[k][0]), (lam, fast[k][1])):
            assert (a is None) == (b is None) and (a is None or np.isclose(a, b, rtol=1e-6, atol=1e-6, equal_nan=True)), (k, others[k], fast[k])


def test_surface_is_recovered(spark):
    rows = []
    for r in range(1, 17):
        for c in range(1, 25):
            y = 100 + 2 * r - 0.1 * r * r + 0.5 * c + 0.02 * c * c
            rows.append(("s", r, c, float(y), (r + c) % 2 == 0))
    df = spark.createDataFrame(rows, "screen string, row int, col int, y double, ctrl boolean")
    out = N.well_surface_correct(df, "screen", "row", "col", "y", F.col("ctrl")).toPandas()
    np.testing.assert_allclose(out.norm_fac, out.y, rtol=1e-6)  # a quadratic is fitted exactly
    np.testing.assert_allclose(out.y_norm, out.norm_fac.median(), rtol=1e-6)


def test_surface_points_are_fitted_together(monkeypatch):
    """Every point was a least-squares call of its own before; now only points whose neighbours do not fix a quadratic."""
    rng = np.random.default_rng(8)
    grid = np.array([(r, c) for r in range(1, 17) for c in range(1, 25)], float)
    at = rng.permutation(len(grid))[:180]
    n, y = rng.integers(1, 4, 180).astype(float), rng.normal(30_000, 9_000, 180)
    slow = N.np.linalg.lstsq
    calls = []
    monkeypatch.setattr(N.np.linalg, "lstsq", lambda *a, **k: calls.append(1) or slow(*a, **k))
    fast = N._loess_fit(n, y, grid[at], grid, 0.75)
    assert not calls
    monkeypatch.setattr(N, "SURFACE_CONDITION", 0.0)
    np.testing.assert_allclose(fast, N._loess_fit(n, y, grid[at], grid, 0.75), rtol=1e-9)
    assert len(calls) == len(grid)
    line = grid[grid[:, 0] == 1][:9]
    monkeypatch.setattr(N, "SURFACE_CONDITION", 1e8)
    assert np.isfinite(N._loess_fit(np.ones(9), y[:9], line, grid, 0.75)).all() and len(calls) == 2 * len(grid)


def test_trimmed_stats(plates, pieces):
    got = N.trimmed_stats(plates.where("plate < 9"), ["plate"], "x", 0.1).toPandas().set_index("plate")
    for plate, sub in plates.where("plate < 9").toPandas().groupby("plate"):
        v = np.sort(sub.x.to_numpy())
        k = int(0.1 * len(v))
        v = v[k:len(v) - k]
        assert np.isclose(got.trim_mean[plate], v.mean()) and np.isclose(got.trim_sd[plate], v.std())


def test_quantile_normalize_shares_quantiles(spark, pieces):
    rng = np.random.default_rng(2)
    rows = [(s, i, float(rng.normal(s, s + 1))) for s in range(3) for i in range(200)]
    out = N.quantile_normalize(spark.createDataFrame(rows, "s int, i int, v double"), "s", "i", "v").toPandas()
    ref = np.sort(out[out.s == 0].normalized)
    for s in (1, 2):
        np.testing.assert_allclose(np.sort(out[out.s == s].normalized), ref)
    raw = pd.DataFrame(rows, columns=["s", "i", "v"])
    np.testing.assert_allclose(ref, np.mean([np.sort(raw[raw.s == s].v) for s in range(3)], axis=0))


def test_non_finite_features(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("a", 2.0, float("nan"), 2.0), ("b", 3.0, 3.0, float("inf"))], "line string, x double, y double, z double")
    got = {r.feature: r.common for r in Q.finite_common_features(df, "line", ["x", "y", "z"]).collect()}
    assert got == {"x": True, "y": False, "z": False}


def test_schema_check(spark):
    rows = [(u, n) for u in (1, 2, 3) for n in ("a", "b")]
    df = spark.createDataFrame(rows, "u int, n string")
    assert Q.feature_schema_check(df, ["u"], "n").first().consistent
    bad = df.union(spark.createDataFrame([(3, "c")], df.schema))
    assert {r.consistent for r in Q.feature_schema_check(bad, ["u"], "n").collect()} == {False}


def test_blur_labels_are_balanced(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i % 2, i, float(v)) for i, v in enumerate(rng.random(400))], "plate int, id int, m double")
    out = Q.blur_label(df, ["plate"], ["m"], ["id"]).toPandas()
    n = out.groupby(["plate", "label"]).size().unstack()
    assert (n.good == n.blurry).all() and (n.good == 60).all()
    assert out.duplicated(["plate", "label", "id"]).any()  # drawn with replacement
