"""k-means and Gaussian mixtures for many settings at once.

All models of a search (every K and reference set; every number of components and covariance family) advance
together: an iteration is one pass over the rows, in which a task adds up, for each model that still moves, the sums
its next step needs, by matrix products over a slice; products of a row's values are formed once for all models. The rows are
dealt to as many tasks as there are cores. The sums of tasks are added 32 at a time until at most 32 are left, which the driver adds:
sums of that many tasks, whose size depends on dimensions and components only. Reference data are never
written: a task draws a row's uniform numbers from the hash of (row, set, dimension).

Covariance families, by (volume, shape, orientation): EII and VII spherical, EEI and VVI diagonal, EEE and VVV full;
E is shared by the components, V is their own. Rows with a value that is not finite take no part in a fit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.expr import is_finite
from platewise.operators.forest import spread64
from platewise.operators.newton import DOUBLES, FAN, ddl, table
from platewise.session import cut_lineage

FAMILIES = ["EII", "VII", "EEI", "VVI", "EEE", "VVV"]
ROUNDS = 3  # of seeding
FLOOR = 1e-6  # least variance of a component in units of the mean variance
ROWS_PER_TASK = 2048  # least rows of a task, about; more tasks than cores are never asked for
SLICE = 1_000_000  # products held at once

Work = Callable[[np.ndarray, np.ndarray], np.ndarray]
Works = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]
PARTS = [("k", pa.string()), ("block", pa.int32()), ("s", DOUBLES)]


def vector_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """(r, x): finite feature vectors with a hash that tells rows apart; equal rows share it."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    sound = F.forall("x", lambda v: v.isNotNull() & is_finite(v))
    rows = cut_lineage(df.select(x.alias("x")).where(sound).select(F.xxhash64("x").alias("r"), "x"))
    # a short table is one file and would be one task in every pass
    wanted = min(rows.count() // ROWS_PER_TASK + 1, df.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(rows.repartition(wanted)) if rows.rdd.getNumPartitions() < wanted else rows


def matrices(batches, width: int):
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, width)


def each(works: dict[str, Work]) -> Works:
    return lambda r, x: {name: work(r, x) for name, work in works.items()}


def sums_over(rows: DataFrame, width: int, works: Works) -> dict[str, np.ndarray]:
    """For each named work the sum of its arrays over all rows."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        step = max(64, SLICE // (width * (width + 1) // 2))
        for r, x in matrices(batches, width):
            for i in range(0, len(x), step):
                for name, s in works(r[i:i + step], x[i:i + step]).items():
                    total[name] = total[name] + s if name in total else s
        block = TaskContext.get().partitionId()
        yield from table(PARTS, [{"k": k, "block": block, "s": s} for k, s in total.items()]).to_batches()

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        return table(PARTS, [{"k": t["k"][0].as_py(), "block": t["block"][0].as_py() // FAN, "s": np.sum([np.asarray(v.values) for v in t["s"]], axis=0)}])

    src = rows.select("r", "x")
    tasks = src.rdd.getNumPartitions()
    parts = src.mapInArrow(run, ddl(PARTS))
    while tasks > FAN:
        parts = parts.groupBy("k", F.floor(F.col("block") / F.lit(FAN))).applyInArrow(add, ddl(PARTS))
        tasks = -(-tasks // FAN)
    out: dict[str, np.ndarray] = {}
    for part in sorted(parts.toArrow().to_batches(), key=lambda p: p["block"][0].as_py() if p.num_rows else -1):
        for k, v in zip(part["k"].to_pylist(), part["s"], strict=True):
            s = np.asarray(v.values)
            out[k] = out[k] + s if k in out else s
    return out


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0.0)


@dataclass
class Source:
    """The data themselves (set 0) or a uniform reference set in their bounding box."""

    number: int
    low: np.ndarray
    high: np.ndarray

    def __call__(self, r: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not self.number:
            return x
        u = spread64(r[:, None], self.number, np.arange(x.shape[1])[None, :] + 1) / 2.0**64
        return self.low + u * (self.high - self.low)


def nearest(source: Source, centres: np.ndarray) -> Work:
    """Rows, sums and squared distance by nearest centre."""

    def work(r: np.ndarray, x: np.ndarray) -> np.ndarray:
        y = source(r, x)
        d = distances(y, centres)
        own = d.argmin(axis=1)
        hot = np.zeros((len(y), len(centres)))
        hot[np.arange(len(y)), own] = 1.0
        return np.concatenate([hot.sum(0), (hot.T @ y).ravel(), [d[np.arange(len(y)), own].sum()]])

    return work


def drawn(rows: DataFrame, width: int, sources: list[Source], chance: dict[int, tuple[np.ndarray, float]], tag: int) -> dict[int, np.ndarray]:
    """Rows of each source drawn with a chance in proportion to the squared distance from its centres."""
    fields = [("b", pa.int32()), ("x", DOUBLES)]

    def run(batches):
        for r, x in matrices(batches, width):
            out = []
            for source in sources:
                centres, rate = chance[source.number]
                y = source(r, x)
                hit = spread64(r, source.number + 1, tag + 1000) / 2.0**64 < distances(y, centres).min(1) * rate
                out += [{"b": source.number, "x": v} for v in y[hit]]
            yield from table(fields, out).to_batches()

    found = rows.select("r", "x").mapInArrow(run, "b int, x array<double>").distinct().collect()
    return {s.number: np.array([r["x"] for r in found if r["b"] == s.number]).reshape(-1, width) for s in sources}


def seeds(rows: DataFrame, width: int, sources: list[Source], most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Candidates for centres of every source with the number of rows nearest to each, by oversampling."""
    first = [np.array(x) for x in (r["x"] for r in rows.orderBy("r").limit(1).collect())]
    found = {s.number: s(np.array([0]), first[0][None, :]) for s in sources}
    for round_ in range(ROUNDS):
        cost = sums_over(rows, width, each({str(s.number): nearest(s, found[s.number]) for s in sources}))
        more = drawn(rows, width, sources, {s.number: (found[s.number], 2.0 * most / max(cost[str(s.number)][-1], 1e-300)) for s in sources}, round_)
        found = {b: np.unique(np.concatenate([c, more[b]]), axis=0) for b, c in found.items()}
    counts = sums_over(rows, width, each({str(s.number): nearest(s, found[s.number]) for s in sources}))
    return {b: (c, counts[str(b)][: len(c)]) for b, c in found.items()}


def start_centres(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted candidates, far from each other, then moved to the middle of their candidates."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(weight), p=weight / weight.sum()))]
    while len(chosen) < min(k, len(candidates)):
        far = distances(candidates, candidates[chosen]).min(1) * weight
        if far.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(far), p=far / far.sum())))
    centres = candidates[chosen]
    for _ in range(10):
        hot = np.eye(len(centres))[distances(candidates, centres).argmin(1)] * weight[:, None]
        n = hot.sum(0)
        centres = np.where(n[:, None] > 0, hot.T @ candidates / np.maximum(n, 1e-300)[:, None], centres)
    return centres


@dataclass
class Clusters:
    """Centres of a k-means fit, the squared distance within and whether it came to rest."""

    centres: np.ndarray
    within: float
    converged: bool


def kmeans_all(rows: DataFrame, width: int, sources: list[Source], ks: list[int], seed: int = 1, passes: int = 100, tolerance: float = 1e-7) -> dict[tuple[int, int], Clusters]:
    """k-means of every source for every k, all advanced by the same passes; keys are (source, k)."""
    candidates = seeds(rows, width, sources, max(ks))
    by = {s.number: s for s in sources}
    fits = {(b, k): Clusters(start_centres(*candidates[b], k, seed), np.inf, False) for b in by for k in ks}
    for _ in range(passes):
        moving = [key for key, f in fits.items() if not f.converged]
        if not moving:
            break
        sums = sums_over(rows, width, each({f"{b}/{k}": nearest(by[b], fits[b, k].centres) for b, k in moving}))
        for b, k in moving:
            fit, s = fits[b, k], sums[f"{b}/{k}"]
            size = len(fit.centres)
            n, total = s[:size], s[size:-1].reshape(size, width)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1e-300)[:, None], fit.centres)
            rest = fit.within - s[-1] <= tolerance * s[-1]
            fits[b, k] = Clusters(fit.centres if rest else centres, float(s[-1]), bool(rest))
    return fits


def bounding_box(rows: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    box = rows.agg(F.count("*"), F.array(*[F.min(F.col("x")[i]) for i in range(width)]), F.array(*[F.max(F.col("x")[i]) for i in range(width)])).first()
    return box[0], np.array(box[1], float), np.array(box[2], float)


@dataclass
class Mixture:
    """Weights, means and covariances of a Gaussian mixture; log_lik is that of these parameters."""

    family: str
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray  # (components, d, d) for full families, else (components, d)
    log_lik: float = -np.inf
    converged: bool = False

    @property
    def parameters(self) -> int:
        g, d = self.means.shape
        return g * d + g - 1 + {"EII": 1, "VII": g, "EEI": d, "VVI": g * d, "EEE": d * (d + 1) // 2, "VVV": g * d * (d + 1) // 2}[self.family]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of every row and component."""
        d = self.means.shape[1]
        full = self.covs.ndim == 3
        if full:
            roots = np.linalg.cholesky(self.covs)
            whiten = np.linalg.inv(roots).transpose(0, 2, 1)
            log_det = 2 * np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(1)
        else:
            whiten = 1 / np.sqrt(self.covs)
            log_det = np.log(self.covs).sum(1)
        level = np.log(np.maximum(self.weights, 1e-300)) - 0.5 * (d * np.log(2 * np.pi) + log_det)
        out = np.empty((len(x), len(level)))
        for j, (mean, w) in enumerate(zip(self.means, whiten, strict=True)):
            away = (x - mean) @ w if full else (x - mean) * w
            out[:, j] = level[j] - 0.5 * np.einsum("nd,nd->n", away, away)
        return out

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities, and the log-likelihood of each row."""
        log_p = self.log_density(x)
        top = log_p.max(1)
        share = np.exp(log_p - top[:, None])
        whole = share.sum(1)
        return share / whole[:, None], top + np.log(whole)

    def updated(self, s: np.ndarray, floor: float, tolerance: float) -> Mixture:
        """The maximising parameters, or the same ones at rest where the likelihood has ceased to grow."""
        g, d = self.means.shape
        n, ll = np.maximum(s[:g], 1e-10), float(s[-1])
        if ll - self.log_lik <= tolerance * abs(ll):
            return Mixture(self.family, self.weights, self.means, self.covs, ll, True)
        means = s[g:g + g * d].reshape(g, d) / n[:, None]
        second = s[g + g * d:-1].reshape(self.covs.shape) / n.reshape(-1, *[1] * (self.covs.ndim - 1))
        own = second - (means[:, :, None] * means[:, None, :] if self.covs.ndim == 3 else means * means)
        return Mixture(self.family, n / n.sum(), means, constrained(own, n, self.family, floor), ll)


def moments(x: np.ndarray, full: bool) -> np.ndarray:
    """1, the values, and their squares or all products of two of them, for every row."""
    if not full:
        return np.column_stack([np.ones(len(x)), x, x * x])
    i, j = np.triu_indices(x.shape[1])
    return np.column_stack([np.ones(len(x)), x, x[:, i] * x[:, j]])


def by_component(s: np.ndarray, width: int, full: bool, ll: float) -> np.ndarray:
    """Sums of ``moments`` per component in the order ``Mixture.updated`` reads."""
    n, first, second = s[:, 0], s[:, 1:width + 1], s[:, width + 1:]
    if full:
        i, j = np.triu_indices(width)
        square = np.empty((len(s), width, width))
        square[:, i, j] = square[:, j, i] = second
        second = square
    return np.concatenate([n, first.ravel(), second.ravel(), [ll]])


def expected(models: dict[str, Mixture]) -> Works:
    """Sums that the next parameters of all models follow from, short of the mirrored products: (components, moments) and the log-likelihood."""

    def work(_: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for full in (False, True):
            names = [k for k, m in models.items() if (m.covs.ndim == 3) == full]
            if not names:
                continue
            found = [models[k].shares(x) for k in names]
            sums = np.concatenate([share for share, _ in found], axis=1).T @ moments(x, full)
            ends = np.cumsum([share.shape[1] for share, _ in found])[:-1]
            for k, s, (_, ll) in zip(names, np.split(sums, ends), found, strict=True):
                out[k] = np.append(s.ravel(), ll.sum())
        return out

    return work


def constrained(own: np.ndarray, n: np.ndarray, family: str, floor: float) -> np.ndarray:
    """Covariances of a family from those of the single components."""
    g, d = len(n), own.shape[1]
    shape = (-1, *[1] * (own.ndim - 1))
    if family[0] == "E":
        own = np.repeat((own * n.reshape(shape)).sum(0, keepdims=True) / n.sum(), g, axis=0)
    if family in ("EII", "VII"):
        own = np.repeat(own.mean(1, keepdims=True), d, axis=1)
    if own.ndim == 2:
        return np.maximum(own, floor)
    own = (own + own.transpose(0, 2, 1)) / 2
    value, vector = np.linalg.eigh(own)
    return np.einsum("gij,gj,gkj->gik", vector, np.maximum(value, floor), vector)


def fit_mixtures(df: DataFrame, features: list[str], components: list[int], families: list[str] = FAMILIES, seed: int = 1, passes: int = 200, tolerance: float = 1e-5) -> tuple[int, dict[tuple[str, int], Mixture]]:
    """Number of rows, and a fitted mixture for every family and number of components."""
    rows, width = vector_rows(df, features), len(features)
    n, low, high = bounding_box(rows, width)
    if not n:
        return 0, {}
    groups = kmeans_all(rows, width, [Source(0, low, high)], components, seed)
    total = sums_over(rows, width, lambda _, x: {"all": moments(x, False).sum(0)})["all"]
    spread = np.maximum(total[width + 1:] / n - (total[1:width + 1] / n) ** 2, 0.0)
    floor = FLOOR * max(float(spread.mean()), 1e-300)

    def hard(_: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        shares = {g: np.eye(len(groups[0, g].centres))[distances(x, groups[0, g].centres).argmin(1)] for g in components}
        return {f"{full}/{g}": (share.T @ m).ravel() for full in (False, True) for m in [moments(x, full)] for g, share in shares.items()}

    begin = sums_over(rows, width, hard)
    fits = {}
    for family in families:
        full = family in ("EEE", "VVV")
        for g in components:
            size = len(groups[0, g].centres)
            blank = Mixture(family, np.ones(size), np.zeros((size, width)), np.zeros((size, width, width) if full else (size, width)))
            fits[family, g] = blank.updated(by_component(begin[f"{full}/{g}"].reshape(size, -1), width, full, 0.0), floor, -1.0)
            fits[family, g].log_lik = -np.inf
    for _ in range(passes):
        moving = [key for key, f in fits.items() if not f.converged]
        if not moving:
            break
        sums = sums_over(rows, width, expected({f"{f}/{g}": fits[f, g] for f, g in moving}))
        for f, g in moving:
            fit, s = fits[f, g], sums[f"{f}/{g}"]
            fits[f, g] = fit.updated(by_component(s[:-1].reshape(len(fit.weights), -1), width, fit.covs.ndim == 3, float(s[-1])), floor, tolerance)
    return n, fits


def gap_statistic(df: DataFrame, features: list[str], k_max: int = 10, references: int = 5, seed: int = 1) -> DataFrame:
    """k, log_w, ref_log_w, gap, se and converged: log within-distance of uniform reference data less that of the data, K = 1..k_max."""
    rows, width = vector_rows(df, features), len(features)
    n, low, high = bounding_box(rows, width)
    out = []
    if n:
        sources = [Source(b, low, high) for b in range(references + 1)]
        ks = list(range(1, k_max + 1))
        fits = kmeans_all(rows, width, sources, ks, seed)
        for k in ks:
            w = [float(np.log(max(fits[b, k].within, 1e-300))) for b in range(references + 1)]
            ref = np.array(w[1:])
            out.append((k, w[0], float(ref.mean()), float(ref.mean() - w[0]), float(ref.std() * np.sqrt(1 + 1 / references)), all(fits[b, k].converged for b in range(references + 1))))
    return df.sparkSession.createDataFrame(out, "k int, log_w double, ref_log_w double, gap double, se double, converged boolean")


def mixture_bic(df: DataFrame, features: list[str], components: list[int], families: list[str] = FAMILIES, seed: int = 1) -> DataFrame:
    """family, g, log_lik, parameters, bic = 2·logLik - p·ln n (larger is better), converged."""
    n, fits = fit_mixtures(df, features, components, families, seed)
    rows = [(f, g, m.log_lik, m.parameters, 2 * m.log_lik - m.parameters * float(np.log(n)), m.converged) for (f, g), m in fits.items()]
    return df.sparkSession.createDataFrame(rows, "family string, g int, log_lik double, parameters int, bic double, converged boolean")


def mixture_predict(sample: DataFrame, df: DataFrame, features: list[str], components: list[int], families: list[str] = FAMILIES, seed: int = 1) -> DataFrame:
    """Fit on a sample, take the best BIC, classify every row: all columns, ``cluster`` and its ``certainty``; null where a feature is not finite."""
    n, fits = fit_mixtures(sample, features, components, families, seed)
    best = max(fits.values(), key=lambda m: 2 * m.log_lik - m.parameters * np.log(n))
    width = len(features)
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    src = df.withColumn("_x", x)
    names = [*df.columns, "cluster", "certainty"]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns), "cluster int, certainty double"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            good = np.isfinite(y).all(1)
            share = np.zeros((len(y), len(best.weights)))
            share[good] = best.shares(y[good])[0]
            own = share.argmax(1).astype(np.int32)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(own, mask=~good), pa.array(share.max(1), mask=~good)], names=names)

    return src.mapInArrow(run, schema)
