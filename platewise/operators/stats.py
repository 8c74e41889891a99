"""Correlation, tests, linear models, enrichment and distribution fits.

Everything is a mergeable aggregate, a bucketed rank or a running sum; special
functions are applied to the summary rows only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.expr import hash_text, hash_unit, log_factorial, nsjoin, ratio, with_group_stats
from platewise.functions.special import digamma, fisher_greater, t_pvalue, trigamma, trigamma_inverse
from platewise.operators.joins import key_grid
from platewise.operators.pairs import cross_products
from platewise.operators.permute import random_set_scores, random_set_sums, test_key
from platewise.operators.order import average_rank, bh_adjust, group_median, group_quantiles, row_order, running, value_order
from platewise.session import cut_lineage


# correlation ---------------------------------------------------------------

def corr_pearson_grouped(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.where(both).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("corr"))


def corr_spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    r = average_rank(average_rank(both, keys, x, "_rx"), keys, y, "_ry")
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("corr"))


def replicate_feature_corr(df: DataFrame, keys: list[str], well: list[str], rep: str, reps: tuple, value: str) -> DataFrame:
    """Correlation of two replicates over the wells both have, per key (line, feature), best first.

    Replicates become two columns of one aggregate, so no self-join is needed.
    """
    a, b = reps
    wide = df.groupBy(*keys, *well).agg(F.avg(F.when(F.col(rep) == a, F.col(value))).alias("_a"), F.avg(F.when(F.col(rep) == b, F.col(value))).alias("_b"))
    return corr_pearson_grouped(wide, keys, "_a", "_b").orderBy(F.col("corr").desc_nulls_last())


def corr_distance(c: str | Column) -> Column:
    return (1 - (F.col(c) if isinstance(c, str) else c)) / 2


def greedy_decorrelate(corr: pd.DataFrame, names: list[str], key_features: list[str], limit: float = 0.85) -> list[tuple[str, float]]:
    """Feature selection on a d×d correlation table (i, j, corr; 1-based), d bounded by the schema.

    Starts from the key features; the remaining feature least correlated with the
    selected ones joins them, those at or above the limit leave.
    """
    d = len(names)
    m = np.eye(d)
    m[corr.i.to_numpy() - 1, corr.j.to_numpy() - 1] = np.abs(corr["corr"].to_numpy(float))
    m = np.maximum(m, m.T)
    at = {f: k for k, f in enumerate(names)}
    chosen = [at[f] for f in key_features]
    score = {k: 0.0 for k in chosen}
    left = [k for k in range(d) if k not in chosen]
    while left:
        worst = m[np.ix_(left, chosen)].max(axis=1)
        k = left[int(np.argmin(worst))]
        score[k] = float(worst.min())
        left = [f for f, w in zip(left, worst) if f != k and w < limit]
        chosen.append(k)
    return [(names[k], score[k]) for k in chosen]


# contingency ---------------------------------------------------------------

def cluster_label_enrichment(df: DataFrame, keys: list[str], item: str, cluster: str, label: str, min_cluster: int = 1) -> DataFrame:
    """2×2 counts, odds ratio, one-sided Fisher p and its BH adjustment per (cluster, label).

    Every cluster of the group is tested with every label of it, so BH runs over pairs that never
    occur too. An item may carry several labels (rows).
    """
    items = df.select(*keys, item, cluster).distinct()
    sizes = items.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("cluster_size"))
    total = items.groupBy(*keys).agg(F.count_distinct(item).alias("n"))
    tagged = df.where(F.col(label).isNotNull()).select(*keys, item, cluster, label).distinct()
    labels = tagged.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("label_size"))
    hits = tagged.groupBy(*keys, cluster, label).agg(F.count(F.lit(1)).alias("a"))
    large = sizes.where(F.col("cluster_size") >= min_cluster)
    t = nsjoin(nsjoin(nsjoin(large, labels, keys), hits, [*keys, cluster, label], "left").fillna(0, ["a"]), total, keys)
    b, c = F.col("cluster_size") - F.col("a"), F.col("label_size") - F.col("a")
    d = F.col("n") - F.col("a") - b - c
    odds = F.when((b == 0) | (c == 0), F.lit(float("inf"))).otherwise(F.try_divide((F.col("a") * d).cast("double"), (b * c).cast("double")))
    t = t.withColumn("odds_ratio", odds).withColumn("p_value", fisher_greater("a", "cluster_size", "label_size", "n"))
    return bh_adjust(cut_lineage(t), keys, "p_value", "p_adj")


def log_odds_matrix(df: DataFrame, line: str, label: str, odds: str, binary: bool = False, labels: list | None = None) -> DataFrame:
    """Line × label table of the largest odds ratio: Inf becomes the finite maximum,
    non-zero entries log2, absent ones 0; or 1/0 for present/absent."""
    cells = df.groupBy(line, label).agg(F.max(odds).alias("_o"))
    top = cells.where(F.col("_o") != float("inf")).agg(F.max("_o")).scalar()
    o = F.when(F.col("_o") == float("inf"), top).otherwise(F.col("_o"))
    v = F.when(o != 0, F.lit(1.0) if binary else F.log2(o)).otherwise(F.lit(0.0))
    g = cells.withColumn("_v", v).groupBy(line)
    return (g.pivot(label, labels) if labels else g.pivot(label)).agg(F.max("_v")).fillna(0.0)


def contingency_chisq(df: DataFrame, row: str, column: str) -> DataFrame:
    """All cells (zeros too) with Pearson residual (O-E)/√E and the table's χ²."""
    n = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = n.groupBy(row).agg(F.sum("n").alias("_r")), n.groupBy(column).agg(F.sum("n").alias("_c"))
    total = n.agg(F.sum("n")).scalar()
    grid = nsjoin(key_grid(rows, cols), n, [row, column], "left").fillna(0, ["n"])
    e = F.col("_r").cast("double") * F.col("_c") / total
    cells = cut_lineage(grid.withColumn("residual", (F.col("n") - e) / F.sqrt(e)).drop("_r", "_c"))
    chi = cells.agg(F.sum(F.col("residual") * F.col("residual"))).scalar()
    return cells.withColumn("chisq", chi)


def _draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw at any size: inversion over the ratios of neighbouring probabilities around the mode.

    Twelve standard deviations and 50 counts on either side leave out less than a double resolves.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    t = good + bad
    mode = min(max((n + 1) * (good + 1) // (t + 2), low), high)
    reach = int(12 * math.sqrt(n * (good / t) * (bad / t) * ((t - n) / max(t - 1, 1)))) + 50
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=float)
    ratio_ = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    log_p = np.concatenate([[0.0], np.cumsum(ratio_)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[np.searchsorted(p, rng.random() * p[-1], side="right").clip(max=len(k) - 1)])


def contingency_mc_test(df: DataFrame, row: str, column: str, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """Monte-Carlo p of the table under fixed margins, p = (1 + #{sim <= obs}) / (B + 1).

    Statistic: minus the sum of log factorials of the cells. A replicate draws a table from the
    margins (one number per row and column level) whatever the number of rows, and
    replicates are spread over tasks.
    """
    n = cut_lineage(df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n")))
    observed = n.agg(-F.sum(log_factorial("n"))).scalar()
    r = n.groupBy(row).agg(F.sum("n").alias("s")).agg(F.array_sort(F.collect_list("s"))).scalar()
    c = n.groupBy(column).agg(F.sum("n").alias("s")).agg(F.array_sort(F.collect_list("s"))).scalar()
    reps = df.sparkSession.range(replicates).withColumn("rows", r).withColumn("cols", c)

    def simulate(batches):
        for pdf in batches:
            out = []
            for rid, rows, cols in zip(pdf["id"], pdf["rows"], pdf["cols"]):
                rng = np.random.default_rng([seed, int(rid)])
                left = [int(x) for x in cols]
                total = 0.0
                for need in (int(x) for x in rows):
                    pool = sum(left)
                    for k in range(len(left)):
                        pool -= left[k]
                        x = _draw_hypergeometric(rng, left[k], pool, need)
                        left[k] -= x
                        need -= x
                        total -= math.lgamma(x + 1)
                out.append(total)
            yield pd.DataFrame({"statistic": out})

    sim = reps.mapInPandas(simulate, "statistic double")
    hits = F.count_if(F.col("statistic") <= observed + F.abs(observed) * 1e-9)
    return sim.agg(observed.alias("statistic"), F.count(F.lit(1)).alias("replicates"), ((hits + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def multinom_aic(df: DataFrame, outcome: str, factors: list[str]) -> DataFrame:
    """AIC of outcome ~ 1 and outcome ~ factor, one factor each, in closed form.

    The one-factor fit is the cell frequencies: LL = Σ n·ln(n/N_g), k = (K-1)·G.
    """
    long = df.select(outcome, F.explode(F.array(
        F.struct(F.lit("intercept").alias("model"), F.lit("").alias("level")),
        *[F.struct(F.lit(f).alias("model"), F.col(f).cast("string").alias("level")) for f in factors])).alias("m")).select(outcome, "m.*")
    cells = long.groupBy("model", "level", outcome).agg(F.count(F.lit(1)).alias("n"))
    cells = with_group_stats(cells, ["model", "level"], F.sum("n").alias("_g"))
    classes = df.agg(F.count_distinct(outcome)).scalar()
    ll = cells.groupBy("model").agg(F.sum(F.col("n") * F.ln(F.col("n") / F.col("_g"))).alias("log_lik"), F.count_distinct("level").alias("_groups"))
    k = (classes - 1) * F.col("_groups")
    return ll.select("model", k.alias("df"), "log_lik", (2 * k - 2 * F.col("log_lik")).alias("aic")).orderBy("aic")


# two-sample tests ----------------------------------------------------------

def ttest_welch(df: DataFrame, keys: list[str], group: Column, value: str, with_p: bool = True) -> DataFrame:
    """Means of both groups, Welch t and degrees of freedom (t positive when group 0 is larger)."""
    one, zero = F.when(group, F.col(value)), F.when(~group, F.col(value))
    s = df.groupBy(*keys).agg(
        F.count(zero).alias("n0"), F.count(one).alias("n1"), F.avg(zero).alias("mean0"), F.avg(one).alias("mean1"),
        F.var_samp(zero).alias("_v0"), F.var_samp(one).alias("_v1")).where("n0 > 1 AND n1 > 1")
    a, b = F.col("_v0") / F.col("n0"), F.col("_v1") / F.col("n1")
    out = s.withColumn("t", ratio(F.col("mean0") - F.col("mean1"), F.sqrt(a + b)))
    out = out.withColumn("df", ratio((a + b) * (a + b), a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))).drop("_v0", "_v1")
    return out.withColumn("p_value", t_pvalue("t", "df")) if with_p else out


def permutation_test(df: DataFrame, test: str, unit: str, value: str, status: DataFrame, factor: str, permutations: int = 9999, seed: str = "perm") -> DataFrame:
    """Monte-Carlo difference test of ``value`` between units with and without each factor.

    df: one row per (test, unit); status: (unit, factor) pairs that are positive. A
    permutation orders the units by hash; the first n1 of them are its positive
    group, so its prefixes serve every factor at once (see ``permute``).
    Two-sided p = (1 + #{|perm - mean| >= |obs - mean|}) / (B + 1).
    """
    base = df.select(test, unit, value).where(F.col(value).isNotNull())
    tot = base.groupBy(test).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_t"), F.var_samp(value).alias("variance"))
    pos = base.join(status.select(unit, factor).distinct(), unit).groupBy(test, factor).agg(F.count(F.lit(1)).alias("_n1"), F.sum(value).alias("_s1"))
    obs = cut_lineage(nsjoin(pos, tot, [test]).where("_n1 < _n").withColumn("g", test_key([test])))
    sums = random_set_sums(base, [test], unit, F.col(value), obs.select("g", F.col("_n1").alias("size")), permutations, seed)
    diff = lambda s: s / F.col("_n1") - (F.col("_t") - s) / (F.col("_n") - F.col("_n1"))
    sims = sums.withColumnRenamed("size", "_n1").join(obs, ["g", "_n1"])
    hit = F.abs(diff(F.col("sum"))) >= F.abs(diff(F.col("_s1"))) - 1e-9
    out = sims.groupBy(test, factor).agg(
        F.first(diff(F.col("_s1"))).alias("estimate"), F.first("variance").alias("variance"),
        ((F.count_if(hit) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    return bh_adjust(cut_lineage(out), [], "p_value", "p_adj")


def wilcoxon_rank_sum(df: DataFrame, keys: list[str], group: Column, value: str) -> DataFrame:
    """Rank-sum W of group 1 and its normal z with tie and continuity correction."""
    v = value_order(df, keys, value, {"one": F.when(group, 1).otherwise(0).cast("long")})
    mid = F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)
    s = v.groupBy(*keys).agg(
        F.sum("one").alias("n1"), F.max("total_n").alias("_n"), F.sum(mid * F.col("one")).alias("_r"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("_ties"))
    n1, n, n0 = F.col("n1"), F.col("_n"), F.col("_n") - F.col("n1")
    w = F.col("_r") - n1 * (n1 + 1) / 2
    d = w - n1 * n0 / 2
    sigma = F.sqrt(n1 * n0 / F.lit(12.0) * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    return s.select(*keys, n1.alias("n1"), n0.alias("n0"), w.alias("w"), ratio(d - F.signum(d) * 0.5, sigma).alias("z"))


# linear models -------------------------------------------------------------

def ols_factor(df: DataFrame, keys: list[str], y: str, factor: str, reference: str) -> DataFrame:
    """lm(y ~ factor): one coefficient per level against the reference, in closed form."""
    gk = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    g = src.groupBy(*gk, factor).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("_m"), F.var_pop(y).alias("_v"))
    fit = g.groupBy(*gk).agg(
        F.sum(F.col("n") * F.col("_v")).alias("_rss"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"),
        F.max(F.when(F.col(factor) == reference, F.col("_m"))).alias("_m0"), F.max(F.when(F.col(factor) == reference, F.col("n"))).alias("_n0"))
    t = nsjoin(g, fit, gk)
    df_res = F.col("_n") - F.col("_k")
    s2 = ratio("_rss", df_res)
    base = F.col(factor) == reference
    coef = F.when(base, F.col("_m")).otherwise(F.col("_m") - F.col("_m0"))
    se = F.sqrt(s2 * F.when(base, 1 / F.col("_n0")).otherwise(1 / F.col("n") + 1 / F.col("_n0")))
    term = F.when(base, F.lit("(Intercept)")).otherwise(F.concat(F.lit(factor), F.col(factor).cast("string")))
    return t.select(*keys, term.alias("term"), coef.alias("estimate"), se.alias("std_error"), ratio(coef, se).alias("statistic"), df_res.alias("df"))


def ols_terms(df: DataFrame, keys: list[str], y: str, factors: dict[str, list]) -> DataFrame:
    """lm(y ~ f1 + f2 + ...): dummy coding against each factor's first level.

    Cross-products are summed by Spark; the small normal equations are solved per key.
    """
    terms = [(f, lv) for f, levels in factors.items() for lv in levels[1:]]
    dummies = [F.when(F.col(f) == lv, 1.0).otherwise(0.0) for f, lv in terms]
    rows = df.select(*keys, F.array(*dummies, F.col(y).cast("double")).alias("_v"))
    gk = keys or ["_all"]
    cells = cross_products(rows if keys else rows.withColumn("_all", F.lit(0)), gk, "_v")
    names = ["(Intercept)"] + [f"{f}{lv}" for f, lv in terms]
    p = len(names)
    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in gk) + ", term string, estimate double, std_error double, statistic double, df long"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((p + 1, p + 1))
        m[pdf.i, pdf.j] = pdf.s
        m = m + np.triu(m, 1).T
        x, xy, yy, n = m[:p, :p], m[:p, p], m[p, p], m[0, 0]
        inv = np.linalg.pinv(x)
        beta = inv @ xy
        rank = np.linalg.matrix_rank(x)
        s2 = max(yy - beta @ xy, 0.0) / (n - rank)
        se = np.sqrt(np.maximum(np.diag(inv), 0) * s2)
        with np.errstate(all="ignore"):
            out = pd.DataFrame({"term": names, "estimate": beta, "std_error": se, "statistic": beta / se, "df": int(n - rank)})
        for k in reversed(gk):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    out = cells.groupBy(*gk).applyInPandas(solve, schema)
    return out if keys else out.drop("_all")


def linear_model_rows(expr: DataFrame, design: DataFrame, probe: str, sample: str, value: str, terms: list[str]) -> DataFrame:
    """The same linear model for every probe: estimate, se, sigma² and df per term.

    Samples are shared, so (XᵀX)⁻¹ is one small matrix (terms × terms) computed from
    the design; per probe only Xᵀy and yᵀy are summed.
    """
    d = design.select(sample, *[F.col(x).cast("double").alias(x) for x in terms])
    k = len(terms)
    one = d.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]).first()
    xtx = np.array([[one[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    inv = np.linalg.pinv(xtx)
    df_res = int(one["n"]) - int(np.linalg.matrix_rank(xtx))
    sums = expr.join(d, sample).groupBy(probe).agg(*[F.sum(F.col(x) * F.col(value)).alias(f"_xy{i}") for i, x in enumerate(terms)], F.sum(F.col(value) * F.col(value)).alias("_yy"))
    betas = [sum((F.lit(float(inv[i, j])) * F.col(f"_xy{j}") for j in range(k)), F.lit(0.0)) for i in range(k)]
    fit = sums.select(probe, "_yy", *[f"_xy{i}" for i in range(k)], *[b.alias(f"_b{i}") for i, b in enumerate(betas)])
    rss = F.col("_yy") - sum((F.col(f"_b{i}") * F.col(f"_xy{i}") for i in range(k)), F.lit(0.0))
    s2 = F.greatest(rss, F.lit(0.0)) / F.lit(float(df_res))
    rows = [F.struct(F.lit(x).alias("term"), F.col(f"_b{i}").alias("estimate"), F.lit(float(inv[i, i])).alias("unscaled")) for i, x in enumerate(terms)]
    out = fit.select(probe, s2.alias("sigma2"), F.lit(df_res).cast("long").alias("df"), F.inline(F.array(*rows)))
    se = F.sqrt(F.col("sigma2") * F.col("unscaled"))
    return out.withColumn("std_error", se).withColumn("statistic", ratio("estimate", se))


def contrast_test(expr: DataFrame, probe: str, level: str, value: str, contrasts: dict[str, dict]) -> DataFrame:
    """Cell-means model per probe; each contrast is a weighted sum of level means."""
    g = expr.groupBy(probe, level).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    weights = F.explode(F.array(*[
        F.struct(F.lit(name).alias("contrast"), F.coalesce(*[F.when(F.col(level) == lv, F.lit(float(w))) for lv, w in c.items()], F.lit(0.0)).alias("w"))
        for name, c in contrasts.items()]))
    s = g.select(probe, "_n", "_m", "_v", weights.alias("c")).groupBy(probe, F.col("c.contrast").alias("contrast")).agg(
        F.sum(F.col("c.w") * F.col("_m")).alias("estimate"), F.sum(F.col("c.w") * F.col("c.w") / F.col("_n")).alias("unscaled"),
        F.sum(F.col("_n") * F.col("_v")).alias("_rss"), (F.sum("_n") - F.count(F.lit(1))).alias("df"))
    out = s.withColumn("sigma2", ratio("_rss", "df")).drop("_rss")
    se = F.sqrt(F.col("sigma2") * F.col("unscaled"))
    return out.withColumn("std_error", se).withColumn("statistic", ratio("estimate", se))


def moderated_t(fit: DataFrame, probe: str, by: list[str]) -> DataFrame:
    """Empirical-Bayes shrinkage of sigma2 towards a common prior; moderated t, p and BH.

    fit has estimate, unscaled, sigma2, df per (probe, by). The prior (d0, s0²) matches
    mean and variance of log sigma2 over probes, two numbers from one aggregate.
    """
    per = fit.where("sigma2 > 0 AND df > 0").groupBy(probe).agg(F.first("sigma2").alias("s"), F.first("df").alias("d"))
    z = F.ln("s")
    # digamma and trigamma depend on df only, which takes few values
    dims = per.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(z).alias("z1"), F.sum(z * z).alias("z2")).collect()
    total = sum(r.n for r in dims)
    shift = {r.d: -digamma(r.d / 2) + math.log(r.d / 2) for r in dims}
    mean = sum(r.z1 + r.n * shift[r.d] for r in dims) / total
    var = sum(r.z2 + 2 * shift[r.d] * r.z1 + r.n * shift[r.d] ** 2 for r in dims) / max(total - 1, 1) - mean ** 2 * total / max(total - 1, 1)
    excess = var - sum(r.n * trigamma(r.d / 2) for r in dims) / total
    if excess > 0:
        d0 = 2 * trigamma_inverse(excess)
        s0 = math.exp(mean + digamma(d0 / 2) - math.log(d0 / 2))
        post, dfs = (d0 * F.lit(s0) + F.col("df") * F.col("sigma2")) / (d0 + F.col("df")), F.col("df") + d0
    else:
        d0, s0 = float("inf"), math.exp(mean)
        post, dfs = F.lit(s0), F.lit(1e12)
    t = ratio("estimate", F.sqrt(post * F.col("unscaled")))
    out = fit.withColumn("s2_post", post).withColumn("df_total", dfs.cast("double")).withColumn("t", t)
    out = out.withColumn("p_value", t_pvalue("t", "df_total")).withColumn("d0", F.lit(float(d0))).withColumn("s0_2", F.lit(float(s0)))
    return bh_adjust(cut_lineage(out), by, "p_value", "p_adj")


def lasso_per_key(df: DataFrame, keys: list[str], ids: list[str], features: list[str], y: str, folds: int = 10, lambdas: int = 50) -> DataFrame:
    """L1 regression per key with λ from cross-validation; non-zero standardised-scale solutions on the raw scale.

    Every quantity comes from cross-product sums per (key, fold): a training fold is
    the total minus its hold-out, and hold-out error is a quadratic form. A key's
    rows are never gathered.
    """
    fold = F.floor(hash_unit(*ids, salt="fold") * folds).cast("int")
    rows = df.select(*keys, fold.alias("_fold"), F.array(*[F.col(f).cast("double") for f in [*features, y]]).alias("_v"))
    cells = cross_products(rows, [*keys, "_fold"], "_v")
    p = len(features)
    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", term string, coef double, lam double"

    def centred(m):
        n = m[0, 0]
        mean = m[0, 1:] / n
        return n, mean, m[1:, 1:] / n - np.outer(mean, mean)

    def descend(c, lam, b):
        sd = np.sqrt(np.maximum(np.diag(c)[:p], 1e-300))
        g, r = c[:p, :p] / np.outer(sd, sd), c[:p, p] / sd
        b = b.copy()
        for _ in range(1000):
            old = b.copy()
            for k in range(p):
                rho = r[k] - g[k] @ b + g[k, k] * b[k]
                b[k] = np.sign(rho) * max(abs(rho) - lam, 0.0) / max(g[k, k], 1e-12)
            if np.abs(b - old).max() < 1e-10:
                break
        return b, b / sd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {}
        for f, sub in pdf.groupby("_fold"):
            m = np.zeros((p + 2, p + 2))
            m[sub.i, sub.j] = sub.s
            parts[f] = m + np.triu(m, 1).T
        total = sum(parts.values())
        _, mean, c = centred(total)
        sd = np.sqrt(np.maximum(np.diag(c)[:p], 1e-300))
        top = np.abs(c[:p, p] / sd).max()
        path = top * np.logspace(0, -3, lambdas)
        err = np.zeros(lambdas)
        for held in parts.values():
            n, mu, ct = centred(total - held)
            b = np.zeros(p)
            for i, lam in enumerate(path):
                b, raw = descend(ct, lam, b)
                full = np.concatenate([[-(mu[p] - mu[:p] @ raw)], -raw, [1.0]])
                err[i] += full @ held @ full
        lam = path[int(np.argmin(err))]
        _, raw = descend(c, lam, np.zeros(p))
        out = pd.DataFrame({"term": ["(Intercept)", *features], "coef": [mean[p] - mean[:p] @ raw, *raw], "lam": lam})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out[(out.coef != 0)]

    return cells.groupBy(*keys).applyInPandas(solve, schema)


def corr_edges(corr: DataFrame, limit: float, drug_edges: DataFrame) -> DataFrame:
    """Gene–gene edges above the limit (both directions) and drug–gene edges in one list."""
    strong = corr.where((F.col("i") != F.col("j")) & (F.col("corr") > limit))
    both = F.explode(F.array(F.struct(F.col("i").alias("source"), F.col("j").alias("target")), F.struct(F.col("j").alias("source"), F.col("i").alias("target"))))
    genes = strong.select(both.alias("e"), F.col("corr").alias("val")).select(
        F.col("e.source").cast("string").alias("source"), F.col("e.target").cast("string").alias("target"), "val", F.lit("gene_cor").alias("edge_type"))
    return genes.unionByName(drug_edges.select("source", "target", "val", F.lit("drug_assoc").alias("edge_type")))


# enrichment ----------------------------------------------------------------

def gsea_running_sum(ranked: DataFrame, sets: DataFrame, keys: list[str], gene: str, score: str, set_name: str, power: float = 1.0) -> DataFrame:
    """Enrichment score per (keys, set): largest deviation of hits minus misses down the list.

    The curve only turns at members, so it is evaluated just before and at each
    member: the list is ranked once and joined to the sets, never copied per set.
    Returns es, set size, and the leading edge's last rank.
    """
    pos = row_order(ranked.select(*keys, gene, score), keys, score, [gene], "_pos", descending=True, total_as="_n")
    return _es_from_hits(nsjoin(pos, sets.select(gene, set_name).distinct(), [gene]), keys, score, set_name, power)


def _es_from_hits(hits: DataFrame, keys: list[str], score: str, set_name: str, power: float) -> DataFrame:
    weight = F.pow(F.abs(F.col(score)), F.lit(float(power)))
    cells = hits.select(*keys, set_name, "_pos", "_n", weight.alias("_w")).withColumn("_b", F.floor(F.col("_pos") / 50_000))
    r = running(cells, [*keys, set_name], "_b", [F.col("_pos")], {"w": F.col("_w"), "one": F.lit(1).cast("long")})
    misses = (F.col("_pos") - 1 - F.col("before_one")) / (F.col("_n") - F.col("total_one"))
    after, before = (F.col("before_w") + F.col("_w")) / F.col("total_w") - misses, F.col("before_w") / F.col("total_w") - misses
    r = r.withColumn("_up", after).withColumn("_down", before)
    g = r.groupBy(*keys, set_name).agg(
        F.max("total_one").alias("size"), F.max("_up").alias("_max"), F.min("_down").alias("_min"),
        F.min_by("_pos", -F.col("_up")).alias("_pmax"), F.min_by("_pos", F.col("_down")).alias("_pmin"))
    up = F.col("_max") >= -F.col("_min")
    return g.select(*keys, set_name, "size", F.when(up, F.col("_max")).otherwise(F.col("_min")).alias("es"), F.when(up, F.col("_pmax")).otherwise(F.col("_pmin")).alias("edge_rank"))


def gsea_permutation(ranked: DataFrame, sets: DataFrame, gene: str, score: str, set_name: str, permutations: int = 100_000, power: float = 1.0, seed: str = "gsea", smallest: int = 1, largest: int | None = None) -> DataFrame:
    """es, NES, p and adjusted p per set of ``smallest`` to ``largest`` ranked genes, against random sets of its size.

    A replicate's nested random sets give the null score of every size at once (see ``permute``). NES and p
    use the null scores of the observed sign.
    """
    genes = cut_lineage(row_order(ranked.select(gene, score), [], score, [gene], "_pos", descending=True, total_as="_n"))
    members = sets.select(gene, set_name).distinct()
    observed = _es_from_hits(nsjoin(genes, members, [gene]), [], score, set_name, power).where(F.col("size") >= smallest)
    observed = cut_lineage(observed.where(F.col("size") <= largest) if largest else observed)
    weight = F.pow(F.abs(F.col(score)), F.lit(float(power)))
    null = random_set_scores(genes, gene, weight, F.col("_pos"), observed.select("size"), permutations, seed)
    t = null.withColumnRenamed("es", "_e").join(observed, "size")
    same = F.signum("_e") == F.signum("es")
    out = t.groupBy(set_name, "size", "es", "edge_rank").agg(
        ratio(F.col("es"), F.avg(F.when(same, F.abs("_e")))).alias("nes"),
        ((F.count_if(same & (F.abs("_e") >= F.abs("es") - 1e-12)) + 1) / (F.count_if(same) + 1)).alias("p_value"))
    return bh_adjust(cut_lineage(out), [], "p_value", "p_adj")


def gene_set_matrix(sets: DataFrame, set_name: str, gene: str, names: list | None = None) -> DataFrame:
    """gene × set table of 0/1."""
    g = sets.select(set_name, gene).distinct().groupBy(gene)
    return (g.pivot(set_name, names) if names else g.pivot(set_name)).agg(F.lit(1)).fillna(0)


SIGNS = ("all", "negative", "positive")


def factor_set_enrichment(loadings: DataFrame, sets: DataFrame, factor: str, gene: str, weight: str, set_name: str) -> DataFrame:
    """Members against the rest by pooled t per (factor, set, sign).

    all: absolute loadings; positive / negative: the other sign counts as 0.
    """
    w = F.col(weight)
    x = loadings.select(factor, gene, F.explode(F.array(
        F.struct(F.lit("all").alias("sign"), F.abs(w).alias("x")),
        F.struct(F.lit("negative").alias("sign"), F.greatest(-w, F.lit(0.0)).alias("x")),
        F.struct(F.lit("positive").alias("sign"), F.greatest(w, F.lit(0.0)).alias("x")))).alias("s")).select(factor, gene, "s.*")
    total = x.groupBy(factor, "sign").agg(F.count(F.lit(1)).alias("_n"), F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("x")).alias("_q"))
    inside = nsjoin(x, sets.select(gene, set_name).distinct(), [gene]).groupBy(factor, "sign", set_name).agg(
        F.count(F.lit(1)).alias("size"), F.sum("x").alias("_s1"), F.sum(F.col("x") * F.col("x")).alias("_q1"))
    t = nsjoin(inside, total, [factor, "sign"]).where("size < _n")
    n1, n0 = F.col("size"), F.col("_n") - F.col("size")
    m1, m0 = F.col("_s1") / n1, (F.col("_s") - F.col("_s1")) / n0
    rss = F.col("_q1") - n1 * m1 * m1 + (F.col("_q") - F.col("_q1")) - n0 * m0 * m0
    df = F.col("_n") - 2
    return t.select(factor, "sign", set_name, "size", (m1 - m0).alias("difference"), ratio(m1 - m0, F.sqrt(rss / df * (1 / n1 + 1 / n0))).alias("t"), df.alias("df"))


def factor_set_permutation(loadings: DataFrame, sets: DataFrame, factor: str, gene: str, weight: str, set_name: str, permutations: int = 100_000, seed: str = "fse") -> DataFrame:
    """Permutation p of the mean absolute loading of each set, and its adjustment within the factor.

    A permutation orders genes by hash; its first n1 genes stand for a random set of
    that size, so its prefixes serve all sets (see ``permute``).
    """
    x = loadings.select(factor, gene, F.abs(weight).alias("x"))
    inside = nsjoin(x, sets.select(gene, set_name).distinct(), [gene]).groupBy(factor, set_name).agg(F.count(F.lit(1)).alias("size"), F.sum("x").alias("_s1"))
    inside = cut_lineage(inside.withColumn("g", test_key([factor])))
    sums = random_set_sums(x, [factor], gene, F.col("x"), inside.select("g", "size"), permutations, seed)
    out = sums.join(inside, ["g", "size"]).groupBy(factor, set_name, "size").agg(
        (F.first("_s1") / F.col("size")).alias("mean_weight"), ((F.count_if(F.col("sum") >= F.col("_s1") - 1e-9) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    return bh_adjust(cut_lineage(out), [factor], "p_value", "p_adj")


def leading_edge_compare(a: DataFrame, b: DataFrame, genes: DataFrame, gene: str, stat: str, keys: list[str]) -> DataFrame:
    """Correlate two platforms' statistics over the genes of each set."""
    both = a.select(gene, F.col(stat).alias("_a")).join(b.select(gene, F.col(stat).alias("_b")), gene)
    return corr_pearson_grouped(nsjoin(both, genes, [gene]), keys, "_a", "_b")


# distributions -------------------------------------------------------------

def lnorm_fit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value) > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.ln(value)).alias("meanlog"), F.stddev_pop(F.ln(value)).alias("sdlog"))


def weibull_fit(df: DataFrame, keys: list[str], value: str, tolerance: float = 1e-10, limit: int = 100) -> DataFrame:
    """Maximum-likelihood shape and scale per group by Newton steps on mergeable sums.

    Values are divided by the group's maximum and counted per distinct value once. Steps go on
    until no group's shape moves by more than the tolerance; if some still does after
    ``limit`` steps, that raises. A group of one value has no finite shape and comes back as null.
    """
    v = df.where(F.col(value) > 0).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    top = v.groupBy(*keys).agg(F.max(value).alias("_top"))
    v = cut_lineage(nsjoin(v, top, keys).select(*keys, "_c", "_top", F.ln(F.col(value) / F.col("_top")).alias("_l")))
    ml = F.sum(F.col("_c") * F.col("_l")) / F.sum("_c")
    sd = F.sqrt(F.sum(F.col("_c") * F.col("_l") * F.col("_l")) / F.sum("_c") - ml * ml)
    state = cut_lineage(v.groupBy(*keys).agg(F.sum("_c").alias("n"), F.max("_top").alias("_top"), ml.alias("_ml"), ratio(F.lit(1.2825), sd).alias("shape")))
    for _ in range(limit):
        x = nsjoin(v.drop("_top"), state, keys)
        p = F.col("_c") * F.exp(F.col("shape") * F.col("_l"))
        s = x.groupBy(*keys, "n", "_top", "_ml", "shape").agg(F.sum(p).alias("_a"), F.sum(p * F.col("_l")).alias("_b"), F.sum(p * F.col("_l") * F.col("_l")).alias("_d"))
        f = F.col("_b") / F.col("_a") - 1 / F.col("shape") - F.col("_ml")
        slope = (F.col("_d") * F.col("_a") - F.col("_b") * F.col("_b")) / (F.col("_a") * F.col("_a")) + 1 / (F.col("shape") * F.col("shape"))
        step = F.greatest(F.col("shape") - f / slope, F.col("shape") / 4)
        state = cut_lineage(s.select(*keys, "n", "_top", "_ml", step.alias("shape"), F.abs(step / F.col("shape") - 1).alias("_moved")))
        moved = state.agg(F.max("_moved")).first()[0]
        state = state.drop("_moved")
        if moved is None or moved <= tolerance:
            break
    else:
        raise RuntimeError(f"Weibull shapes still move by {moved} after {limit} steps")
    x = nsjoin(v.drop("_top"), state, keys)
    return x.groupBy(*keys, "n", "shape").agg((F.first("_top") * F.pow(F.sum(F.col("_c") * F.exp(F.col("shape") * F.col("_l"))) / F.col("n"), 1 / F.col("shape"))).alias("scale"))


def poisson_edges() -> list[float]:
    """Cumulative probabilities of a Poisson(1) count, as far as a double resolves them."""
    edges, total, p = [], 0.0, math.exp(-1)
    while total + p > total:
        total += p
        edges.append(total)
        p /= len(edges)
    return [e for e in edges if e < 1.0]


def poisson_one(u: Column) -> Column:
    """Poisson(1) count from a uniform number."""
    edges = poisson_edges()
    return F.coalesce(*[F.when(u < e, F.lit(k)) for k, e in enumerate(edges)], F.lit(len(edges)))


DRAWS_PER_TASK = 2_000_000  # rows x replicates


def bootstrap_moments(df: DataFrame, ids: list[str], value: str, replicates: int, seed: str = "boot") -> DataFrame:
    """Skewness and kurtosis of Poisson bootstrap replicates.

    Each row weighs itself per replicate from its hash; partial sums leave the map
    side as one row per replicate and task. The number of tasks follows rows x replicates, since
    a short table in one file would be drawn by a single core.
    """
    tasks = max(1, -(-df.count() * replicates // DRAWS_PER_TASK))
    m = df.agg(F.avg(value)).scalar()
    x = df.select(*ids, F.col(value).cast("double").alias("_v")).repartition(tasks, *ids).withColumn("_d1", F.col("_v") - m)
    for k in (2, 3, 4):
        x = x.withColumn(f"_d{k}", F.col(f"_d{k - 1}") * F.col("_d1"))
    x = x.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    # no filter on the weight: pushed down it would hash each draw again for every limit
    x = x.withColumn("_u", hash_unit(*ids, "replicate", salt=seed)).withColumn("_w", poisson_one(F.col("_u")))
    s = x.groupBy("replicate").agg(F.sum("_w").alias("n"), *[F.sum(F.col("_w") * F.col(f"_d{k}")).alias(f"_s{k}") for k in (1, 2, 3, 4)])
    a, b, c, d = (F.col(f"_s{k}") / F.col("n") for k in (1, 2, 3, 4))
    m2 = b - a * a
    m3 = c - 3 * a * b + 2 * a * a * a
    m4 = d - 4 * a * c + 6 * a * a * b - 3 * a * a * a * a
    return s.select("replicate", "n", ratio(m3, F.pow(m2, F.lit(1.5))).alias("skewness"), ratio(m4, m2 * m2).alias("kurtosis"))


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct value with the share of rows at or below it."""
    v = value_order(df, keys, value)
    return v.select(*keys, value, "n", ((F.col("before_n") + F.col("n")) / F.col("total_n")).alias("ecdf"))


# dose response -------------------------------------------------------------

def dose_auc(df: DataFrame, keys: list[str], conc: str, viability: str) -> DataFrame:
    """Trapezoid area of mean viability over ln(concentration), divided by the ln range.

    Rows are first averaged per dose; a curve then has as many rows as doses.
    """
    d = df.where(F.col(conc) > 0).groupBy(*keys, conc).agg(F.avg(viability).alias("_v")).withColumn("_x", F.ln(conc))
    w = Window.partitionBy(*keys).orderBy("_x")
    d = d.withColumn("_a", (F.col("_x") - F.lag("_x").over(w)) * (F.col("_v") + F.lag("_v").over(w)) / 2)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("doses"), ratio(F.sum("_a"), F.max("_x") - F.min("_x")).alias("auc")).where("doses > 1")


def dose_auc_fitted(df: DataFrame, keys: list[str], conc: str, viability: str) -> DataFrame:
    """Area under a fitted Hill curve 1/(1 + (c/ec50)^h) between the end doses.

    Least squares over a grid of (ec50, h) refined three times, on the per-dose
    means of a curve (bounded by the number of doses), many curves in parallel.
    """
    d = df.where(F.col(conc) > 0).groupBy(*keys, conc).agg(F.avg(viability).cast("double").alias("_v"), F.count(F.lit(1)).cast("double").alias("_n")).withColumn("_x", F.ln(conc))
    types = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", doses long, ec50 double, hill double, auc double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, v, n = (pdf[c].to_numpy(float) for c in ("_x", "_v", "_n"))
        lo, hi = x.min(), x.max()
        span = max(hi - lo, 1e-9)
        a0, a1, h0, h1 = lo - 2 * span, hi + 2 * span, math.log(0.05), math.log(20)
        for _ in range(4):
            e, h = np.meshgrid(np.linspace(a0, a1, 41), np.linspace(h0, h1, 41), indexing="ij")
            z = np.clip(np.exp(h)[..., None] * (x - e[..., None]), -500, 500)
            sse = (n * (v - 1 / (1 + np.exp(z))) ** 2).sum(axis=-1)
            i, j = np.unravel_index(np.argmin(sse), sse.shape)
            be, bh, de, dh = e[i, j], h[i, j], (a1 - a0) / 20, (h1 - h0) / 20
            a0, a1, h0, h1 = be - de, be + de, bh - dh, bh + dh
        k = math.exp(bh)
        soft = lambda t: np.logaddexp(0, -k * (t - be)) / -k  # antiderivative of the curve
        area = (soft(hi) - soft(lo)) / span if hi > lo else np.nan
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in keys}, "doses": len(x), "ec50": math.exp(be), "hill": k, "auc": area}])

    return d.groupBy(*keys).applyInPandas(fit, schema)


def assay_discordance(df: DataFrame, dead: Column, a: str, b: str) -> DataFrame:
    """Rows alive in one assay and dead in the other.

    dead limit = median + IQR of the known-dead rows, live limit = median - IQR of all rows, per assay.
    """
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    limits = {}
    for name, c in (("a", a), ("b", b)):
        d, al = group_quantiles(df.where(dead), [], c, probs), group_quantiles(df, [], c, probs)
        limits[f"dead_{name}"] = d.select(F.col("q2") + (F.col("q3") - F.col("q1"))).scalar()
        limits[f"live_{name}"] = al.select(F.col("q2") - (F.col("q3") - F.col("q1"))).scalar()
    kind = F.when((F.col(a) < limits["dead_a"]) & (F.col(b) > limits["live_b"]), F.lit("dead_a_live_b")).when(
        (F.col(a) > limits["live_a"]) & (F.col(b) < limits["dead_b"]), F.lit("live_a_dead_b"))
    return df.withColumn("kind", kind).where("kind IS NOT NULL")


def drug_mutation_matrix(tests: DataFrame, drug: str, mutation: str, estimate: str, p: str, drugs: list | None = None) -> DataFrame:
    """mutation × drug table of -log10 p with the sign of the estimate."""
    v = -F.log10(p)
    g = tests.withColumn("_v", F.when(F.col(estimate) < 0, -v).otherwise(v)).groupBy(mutation)
    return (g.pivot(drug, drugs) if drugs else g.pivot(drug)).agg(F.first("_v"))


def mutation_count_filter(df: DataFrame, gene: str, line: str, more_than: int = 2) -> DataFrame:
    """Genes mutated in more than ``more_than`` lines."""
    return df.select(gene, line).distinct().groupBy(gene).agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") > more_than)


POLYLINE_NUMBERS = 1_000_000  # coordinates of paths held at once


def nearest_place(at: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and arc length of the nearest place, for points (2, n) with a path of their own each, (vertices, 2, n).

    Of places equally near the first counts. A point that is not finite is infinitely far from the start.
    """
    done, best, lam = np.zeros(at.shape[1]), np.full(at.shape[1], np.inf), np.zeros(at.shape[1])
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for a, b in zip(corners[:-1], corners[1:], strict=True):
            along, away = b - a, at - a
            squared = along[0] * along[0] + along[1] * along[1]
            t = np.where(squared == 0, 0.0, (away[0] * along[0] + away[1] * along[1]) / squared)
            t = np.minimum(np.maximum(t, 0.0), 1.0)
            rest = away - t * along
            d, length = np.sqrt(rest[0] * rest[0] + rest[1] * rest[1]), np.sqrt(squared)
            nearer = d < best
            best = np.where(nearer, d, best)
            lam = np.where(nearer, done + t * length, lam)
            done = done + length
    return best, lam


def project_to_polyline(points: DataFrame, path: DataFrame, keys: list[str], ids: list[str], x: str, y: str, step: str) -> DataFrame:
    """Nearest place of each point on its group's polyline: distance, arc length, and whether
    the distance is at most the group's median.

    A path is short (one vertex per dose); it is packed into an array per group and goes with each
    point to the task, so points are not multiplied by segments: all points of a batch meet one segment at a time.
    """
    packed = F.sort_array(F.collect_list(F.struct(F.col(step), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    nan = F.lit(float("nan"))
    flat = F.flatten(F.transform(packed, lambda v: F.array(F.coalesce(v["x"], nan), F.coalesce(v["y"], nan))))
    verts = cut_lineage(path.groupBy(*keys).agg(flat.alias("_v")).where(F.size("_v") > 2))
    own = [F.coalesce(F.col(c).cast("double"), nan).alias(n) for c, n in ((x, "_x"), (y, "_y"))]
    p = nsjoin(points.select(*keys, *ids, *own), verts, keys)
    kept = [*keys, *ids]
    schema = ", ".join([*(f"`{c}` {p.schema[c].dataType.simpleString()}" for c in kept), "dist double", "lambda double"])

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_x", "_y")])
            v = batch.column(batch.schema.get_field_index("_v"))
            sizes, numbers = v.value_lengths().to_numpy(), v.flatten().to_numpy()
            start = np.cumsum(sizes) - sizes
            dist, lam = np.empty(len(at)), np.empty(len(at))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                for rows in np.array_split(own, -(-len(own) * int(size) // POLYLINE_NUMBERS)):
                    corners = numbers[start[rows][None, :] + np.arange(size)[:, None]].reshape(-1, 2, len(rows))
                    dist[rows], lam[rows] = nearest_place(at[rows].T, corners)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dist), pa.array(lam, mask=np.isnan(lam))], names=[*kept, "dist", "lambda"])

    p = p.mapInArrow(place, schema)
    p = cut_lineage(p)  # read three times below
    med = group_median(p, keys, "dist", "_med")
    return nsjoin(p, med, keys).withColumn("on_path", F.col("dist") <= F.col("_med")).drop("_med")
