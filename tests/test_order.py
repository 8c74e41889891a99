"""Order statistics against brute force, with one key holding most rows and one value a third of them."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from platewise.operators import order as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 6000
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abcdefgh"), n))
    value = np.round(rng.normal(size=n) * 100, 1)
    value[rng.random(n) < 0.33] = 7.0
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "value": value, "y": rng.random(n) < 0.3})
    return spark.createDataFrame(pdf).cache(), pdf


@pytest.mark.parametrize("split", [False, True])
def test_quantiles(skewed, split, request):
    if split:
        request.getfixturevalue("pieces")
    df, pdf = skewed
    got = O.group_quantiles(df, ["key"], "value", {"a": 0.5, "b": 0.95, "c": 0.1, "lo": 0.0, "hi": 1.0}, "n").toPandas().set_index("key").sort_index()
    for name, p in (("a", 0.5), ("b", 0.95), ("c", 0.1), ("lo", 0.0), ("hi", 1.0)):
        want = pdf.groupby("key").value.quantile(p).sort_index()
        np.testing.assert_allclose(got[name], want, rtol=1e-12)
    assert (got.n == pdf.groupby("key").size().sort_index()).all()


def test_global_quantile_and_nulls(spark, pieces):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,), (float("nan"),)], "v double")
    assert O.group_quantiles(df, [], "v", {"m": 0.5}).first().m == 50.0


def test_median_mad(skewed, pieces):
    df, pdf = skewed
    got = O.group_median_mad(df, ["key"], "value").toPandas().set_index("key").sort_index()
    med = pdf.groupby("key").value.median()
    mad = pdf.groupby("key").value.apply(lambda s: (s - s.median()).abs().median())
    np.testing.assert_allclose(got["median"], med.sort_index())
    np.testing.assert_allclose(got["mad"], mad.sort_index())


@pytest.mark.parametrize("descending", [False, True])
def test_value_order(skewed, pieces, descending):
    from pyspark.sql import functions as F

    df, pdf = skewed
    got = O.value_order(df, ["key"], "value", {"pos": F.col("y").cast("int")}, descending).toPandas()
    for key, sub in pdf.groupby("key"):
        g = got[got.key == key].sort_values("value", ascending=not descending)
        c = sub.groupby("value").agg(n=("id", "size"), pos=("y", "sum")).sort_index(ascending=not descending)
        assert list(g.n) == list(c.n)
        assert list(g.before_n) == list(c.n.cumsum() - c.n)
        assert list(g.before_pos) == list(c.pos.cumsum() - c.pos)
        assert set(g.total_n) == {len(sub)}


@pytest.mark.parametrize("descending", [False, True])
def test_row_order_is_a_sort_with_md5_ties(skewed, pieces, descending):
    df, pdf = skewed
    got = O.row_order(df, ["key"], "value", ["id"], "r", descending, "n").toPandas()
    pdf = pdf.assign(t=[hashlib.md5(f"{i}_".encode()).hexdigest() for i in pdf.id])
    for key, sub in pdf.groupby("key"):
        want = list(sub.sort_values(["value", "t"], ascending=[not descending, True]).id)
        assert list(got[got.key == key].sort_values("r").id) == want


def test_massed_value_is_spread(skewed, pieces):
    df, _ = skewed
    cuts = O.cut_points(df, "value")
    assert len(cuts) > 50 and cuts.count(7.0) > 10


def test_hash_order_is_a_permutation(skewed):
    df, pdf = skewed
    got = O.hash_order(df, ["key"], ["id"], salt="s", name="r").toPandas()
    for key, sub in got.groupby("key"):
        assert sorted(sub.r) == list(range(1, len(sub) + 1))
        want = sorted(sub.id, key=lambda i: hashlib.md5(f"{i}_s".encode()).hexdigest())
        assert list(sub.sort_values("r").id) == want


def test_average_rank(skewed, pieces):
    df, pdf = skewed
    got = O.average_rank(df, ["key"], "value").toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(got["rank"], pdf.groupby("key").value.rank().to_numpy())


def test_bh(spark, pieces):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(500), 2)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(p)] + [(999, None)], "id int, p double")
    got = O.bh_adjust(df, [], "p", "q").toPandas().set_index("id").sort_index()
    assert np.isnan(got.q[999])
    o = np.argsort(p, kind="stable")[::-1]
    want = np.empty(500)
    want[o] = np.minimum(1, np.minimum.accumulate(p[o] * 500 / np.arange(500, 0, -1)))
    np.testing.assert_allclose(got.q[:500], want)
    s = got.sort_values("p").q.dropna().to_numpy()
    assert (np.diff(s) >= -1e-12).all()
