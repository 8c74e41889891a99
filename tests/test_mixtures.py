"""k-means and mixtures of many settings at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import mixtures as X


def frame(spark, x, partitions=3):
    names = "abcdefgh"[: x.shape[1]]
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(partitions), list(names)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [8, 0, 0], [0, 9, 4]])
    return np.concatenate([c + rng.normal(size=(120, 3)) * 0.7 for c in centres])


def test_every_k_rests_at_a_fixed_point(spark, blobs):
    df, names = frame(spark, blobs)
    rows = X.vector_rows(df, names)
    n, low, high = X.bounding_box(rows, 3)
    assert n == 360 and np.allclose(low, blobs.min(0)) and np.allclose(high, blobs.max(0))
    fits = X.kmeans_all(rows, 3, [X.Source(0, low, high), X.Source(1, low, high)], [1, 2, 3, 5])
    r = np.array([x["r"] for x in rows.collect()])
    data = {0: np.array([x["x"] for x in rows.collect()])}
    data[1] = X.Source(1, low, high)(r, data[0])
    assert (data[1] >= low).all() and (data[1] <= high).all() and abs((data[1].mean(0) - (low + high) / 2) / (high - low)).max() < 0.06
    for (b, k), f in fits.items():
        d = ((data[b][:, None, :] - f.centres[None]) ** 2).sum(-1)
        own = d.argmin(1)
        assert f.converged and abs(d.min(1).sum() - f.within) < 1e-6 * f.within
        if k > 1:
            moved = np.array([data[b][own == j].mean(0) for j in range(k)])
            assert ((data[b][:, None, :] - moved[None]) ** 2).sum(-1).min(1).sum() >= f.within * (1 - 1e-4)
    assert fits[0, 3].within < 0.2 * fits[0, 2].within


def test_gap_is_largest_at_the_planted_number(spark, blobs):
    df, names = frame(spark, blobs)
    out = {r.k: r for r in X.gap_statistic(df, names, 6, 3).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6] and all(r.converged for r in out.values())
    assert next(k for k in range(1, 6) if out[k].gap >= out[k + 1].gap - out[k + 1].se) == 3
    w1 = np.log(((blobs - blobs.mean(0)) ** 2).sum())
    assert abs(out[1].log_w - w1) < 1e-9


def density(m, x):
    out = []
    for w, mean, cov in zip(m.weights, m.means, m.covs, strict=True):
        full = cov if cov.ndim == 2 else np.diag(cov)
        away = x - mean
        out.append(np.log(w) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(full)[1] + np.einsum("ni,ij,nj->n", away, np.linalg.inv(full), away)))
    return np.array(out).T


def test_one_component_is_the_closed_form(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 2)) @ np.array([[1, 0.4], [0, 2]])
    df, names = frame(spark, x)
    out = {r.family: r for r in X.mixture_bic(df, names, [1]).collect()}
    cov = np.cov(x.T, bias=True)
    want = -75 * (2 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + 2)
    assert abs(out["VVV"].log_lik - want) < 1e-8 and out["VVV"].parameters == 5 and abs(out["EEE"].log_lik - want) < 1e-8
    diagonal = -75 * (2 * np.log(2 * np.pi) + np.log(np.diag(cov)).sum() + 2)
    assert abs(out["VVI"].log_lik - diagonal) < 1e-8 and out["EII"].parameters == 3 and out["VVI"].parameters == 4


def test_likelihoods_follow_from_the_parameters_and_are_stationary(spark, blobs):
    df, names = frame(spark, blobs)
    n, fits = X.fit_mixtures(df, names, [2, 3])
    assert n == 360 and len(fits) == 12
    for (family, g), m in fits.items():
        log_p = density(m, blobs)
        ll = np.log(np.exp(log_p - log_p.max(1, keepdims=True)).sum(1)) + log_p.max(1)
        assert m.converged and abs(ll.sum() - m.log_lik) < 1e-6 * abs(m.log_lik)
        share = np.exp(log_p - ll[:, None])
        assert np.allclose(share.mean(0), m.weights, atol=2e-3) and np.allclose(share.T @ blobs / share.sum(0)[:, None], m.means, atol=0.05)
        if family[0] == "E":
            assert np.allclose(m.covs, m.covs[0])
        if family[1:] == "II":
            assert np.allclose(m.covs, m.covs[:, :1])


def test_best_model_and_its_classes(spark, blobs):
    df, names = frame(spark, blobs)
    bic = X.mixture_bic(df, names, [1, 2, 3, 4]).orderBy(F.col("bic").desc()).first()
    assert bic.g == 3 and bic.family == "EII"
    ids = df.withColumn("blob", F.when(F.col("a") > 4, 1).when(F.col("b") > 4, 2).otherwise(0))
    out = X.mixture_predict(df, ids.unionByName(ids.limit(1).withColumn("a", F.lit(None).cast("double"))), names, [1, 2, 3]).collect()
    assert len(out) == 361 and sum(r.cluster is None for r in out) == 1
    assert len({(r.blob, r.cluster) for r in out if r.cluster is not None}) == 3


def test_fewer_rows_than_components(spark):
    df, names = frame(spark, np.array([[0.0, 1.0], [0.0, 1.0], [2.0, 1.0]]))
    out = X.gap_statistic(df, names, 4, 2).collect()
    assert len(out) == 4
    assert X.mixture_bic(df, names, [1, 3]).count() == 12
    assert X.gap_statistic(df.limit(0), names, 2, 1).count() == 0 and X.mixture_bic(df.limit(0), names, [1]).count() == 0


def test_a_short_table_is_dealt_to_the_cores(spark, blobs, monkeypatch):
    """One file was one task in every pass before, and each pass wrote its sums."""
    monkeypatch.setattr(X, "ROWS_PER_TASK", 100)
    df, names = frame(spark, blobs, 1)
    rows = X.vector_rows(df, names)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 360


def test_sums_of_all_models_are_those_of_each(spark, blobs, monkeypatch):
    df, names = frame(spark, blobs, 7)
    rows = X.vector_rows(df, names)
    monkeypatch.setattr(X, "FAN", 2)  # partial sums are added by Spark first
    means, covs = blobs[[0, 130, 250]], np.array([[1.0, 2, 3], [2, 1, 1], [1, 1, 4]])
    full = np.array([np.diag(c) + 0.3 for c in covs])
    models = {"VVI/3": X.Mixture("VVI", np.array([0.2, 0.5, 0.3]), means, covs), "VVV/3": X.Mixture("VVV", np.array([0.2, 0.5, 0.3]), means, full)}
    got = X.sums_over(rows, 3, X.expected(models))
    for name, m in models.items():
        log_p = density(m, blobs)
        ll = np.log(np.exp(log_p).sum(1))
        share = np.exp(log_p - ll[:, None])
        second = np.einsum("ng,ni,nj->gij", share, blobs, blobs) if name == "VVV/3" else share.T @ (blobs * blobs)
        want = np.concatenate([share.sum(0), (share.T @ blobs).ravel(), second.ravel(), [ll.sum()]])
        s = got[name]
        np.testing.assert_allclose(X.by_component(s[:-1].reshape(3, -1), 3, name == "VVV/3", s[-1]), want, rtol=1e-9)
