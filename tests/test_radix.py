"""Wide exact quantiles against numpy, whole groups and digit by digit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import radix as R


@pytest.fixture(params=[False, True], ids=["whole", "digits"])
def digits(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(R, "TASK_VALUES", 120)
        monkeypatch.setattr(R, "BLOCK_VALUES", 100)
        monkeypatch.setattr(R, "HELD_VALUES", 400)
    return request.param


def rows(seed=2, n=900):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 else rng.choice(["a", "b", "c", None])
        values = [float(rng.normal() * 10.0 ** rng.integers(-8, 9)), float(round(rng.normal(), 1)), float(i % 7 - 3), None if i % 5 else 1.5]
        if i % 50 == 0:
            values[0] = rng.choice([np.inf, -np.inf, np.nan, 5e-324, -0.0])
        out.append((key, i % 2, *[None if v is None else float(v) for v in values]))
    return out + [("lone", 0, 1.0, None, None, None), ("none", 0, float("nan"), None, None, None)]


F4 = ["w", "x", "y", "z"]


def test_statistics_equal_numpy(spark, digits):
    data = rows()
    df = spark.createDataFrame(data, "k string, j int, w double, x double, y double, z double").repartition(3)
    probs = {"lo": 0.0, "q": 0.3, "med": 0.5, "hi": 0.95}
    out = {(r.k, r.j): r for r in R.named_statistics(df, ["k", "j"], F4, {"med": 0.5, **probs}, "mad", count_as="n").collect()}
    groups = {(r[0], r[1]) for r in data}
    assert set(out) == groups
    for key in groups:
        for j, f in enumerate(F4):
            v = np.array([r[2 + j] for r in data if r[:2] == key and r[2 + j] is not None and not np.isnan(r[2 + j])])
            r = out[key]
            assert r[f"n_{f}"] == len(v)
            for name, p in probs.items():
                if not len(v):
                    assert r[f"{name}_{f}"] is None
                    continue
                s, pos = np.sort(v), p * (len(v) - 1)
                a, b = s[int(np.floor(pos))], s[int(np.ceil(pos))]
                want = a if a == b else a + (b - a) * (pos - np.floor(pos))
                got = r[f"{name}_{f}"]
                assert (got is None and np.isnan(want)) or got == want or abs(got - want) <= 1e-12 * abs(want)
            if len(v) and np.isfinite(r[f"med_{f}"]):
                away = np.abs(v - r[f"med_{f}"])
                assert abs(r[f"mad_{f}"] - np.median(away)) <= 1e-12 * abs(np.median(away))


def test_bits_go_back_to_the_same_double(spark):
    rng = np.random.default_rng(5)
    values = [0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1e-310, *map(float, rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300))]
    u = R.ordered_bits(np.array(values))
    assert (np.argsort(u, kind="stable") == np.argsort(values, kind="stable")).all()
    df = spark.createDataFrame([(int(b), v) for b, v in zip(u, values, strict=True)], "u long, v double")
    assert df.where(R.from_bits(F.col("u")) != F.col("v")).count() == 0


def test_a_wide_table_keeps_its_rows_wide(spark, digits):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 486))
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "g int, x array<double>")
    out = {r.g: np.array(r.stats) for r in R.array_statistics(df, ["g"], 486, [0.5], True).collect()}
    for g in range(3):
        mine = x[np.arange(200) % 3 == g]
        med = np.median(mine, axis=0)
        np.testing.assert_allclose(out[g][:, 0], med, rtol=1e-12)
        np.testing.assert_allclose(out[g][:, 1], np.median(np.abs(mine - med), axis=0), rtol=1e-12)


def test_nothing_in_nothing_out(spark):
    df = spark.createDataFrame([], "g int, a double")
    assert R.named_statistics(df, ["g"], ["a"], {"m": 0.5}, "mad").count() == 0


def test_the_largest_group_of_a_task_needs_little_memory():
    import tracemalloc

    x = np.random.default_rng(5).normal(size=(R.TASK_VALUES // 2, 2))
    tracemalloc.start()
    R.whole_groups(x, np.zeros(len(x), np.int64), 1, [0.5], True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak + x.nbytes < 120_000_000  # 4 times that before
