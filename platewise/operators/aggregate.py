"""Well, treatment and line summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.expr import MAD_TO_SD, nsjoin, with_group_stats
from platewise.operators.radix import named_statistics
from platewise.operators.order import group_median, group_median_mad, group_quantiles, one_bucket, row_order, running, value_order


def well_median_mad(df: DataFrame, keys: list[str], features: list[str], first: list[str]) -> DataFrame:
    """Per well: object count, metadata (smallest value), median and MAD of each feature."""
    wide = named_statistics(df, keys, features, {"median": 0.5}, "mad")
    meta = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_objects"), *[F.min(m).alias(m) for m in first])
    return nsjoin(meta, wide, keys, "left")


def well_mean_summaries(df: DataFrame, keys: list[str], size: str, intensities: list[str]) -> DataFrame:
    means = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_objects"), F.avg(size).alias("mean_size"), *[F.avg(c).alias(f"mean_{c}") for c in intensities])
    return nsjoin(means, group_median(df, keys, size, "median_size"), keys, "left")


def treatment_mean_profile(df: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in components])


def live_dead_well_summary(df: DataFrame, keys: list[str], dead: Column, p_live: str, p_dead: str, first: list[str]) -> DataFrame:
    """Object count, shares and mean certainty among the objects called live / dead."""
    return df.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in first],
        F.count(F.lit(1)).alias("num_objects"),
        F.avg(dead.cast("double")).alias("percent_dead"),
        (1 - F.avg(dead.cast("double"))).alias("percent_live"),
        F.avg(F.when(~dead, F.col(p_live))).alias("mean_certainty_live"),
        F.avg(F.when(dead, F.col(p_dead))).alias("mean_certainty_dead"),
    )


def median_se_band(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, se = 1.4826·MAD/√n and the ±2 se band."""
    st = group_median_mad(df, keys, value, "med_val", "_mad", count_as="_n", scale=MAD_TO_SD)
    se = F.col("_mad") / F.sqrt(F.col("_n").cast("double"))
    return st.select(*keys, "med_val", se.alias("se"), (F.col("med_val") - 2 * se).alias("ymin"), (F.col("med_val") + 2 * se).alias("ymax"))


def dose_band(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("min_live"), F.max(value).alias("max_live"), ((F.min(value) + F.max(value)) / 2).alias("mean"))


def group_quantile(df: DataFrame, keys: list[str], value: str, prob: float, name: str) -> DataFrame:
    return group_quantiles(df, keys, value, {name: prob}).orderBy(name)


def whisker_bounds(df: DataFrame, keys: list[str], value: str, reach: float = 1.5) -> DataFrame:
    q = group_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, (F.col("q1") - reach * iqr).alias("lower"), (F.col("q3") + reach * iqr).alias("upper"))


def histogram_bins(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal-width bins 1..bins; 0 and bins+1 collect what lies outside."""
    b = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.where(F.col(value).isNotNull()).groupBy(*keys, b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def plate_time_mean(df: DataFrame, times: DataFrame, on: list[str], keys: list[str], value: str) -> DataFrame:
    return nsjoin(df, times, on).groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"))


def counts_distinct(df: DataFrame, keys: list[str], what: list[str], name: str = "n") -> DataFrame:
    """Distinct combinations per key, as two mergeable aggregates."""
    return df.select(*keys, *what).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def share_of_total(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """n, share n/sum(n), and the smallest and largest share of the group."""
    counts = with_group_stats(df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n")), keys, F.sum("n").alias("_t"))
    shares = counts.withColumn("share", F.col("n") / F.col("_t")).drop("_t")
    return with_group_stats(shares, keys, F.min("share").alias("min_share"), F.max("share").alias("max_share"))


def active_count(df: DataFrame, line: str, auc: str, limit: float = 0.85) -> DataFrame:
    """Active treatments per line; lines without any are kept with 0."""
    return df.groupBy(line).agg(F.count_if(F.col(auc) >= limit).alias("n_active"))


def active_table(df: DataFrame, drug: str, line: str, auc: str, limit: float = 0.85, lines: list | None = None) -> DataFrame:
    """drug × line 0/1 table of activity."""
    act = (F.max(F.col(auc)) >= limit).cast("int")
    p = df.groupBy(drug)
    return (p.pivot(line, lines) if lines else p.pivot(line)).agg(act).fillna(0)


def active_conc_count(df: DataFrame, keys: list[str], auc: str, limit: float = 0.85) -> DataFrame:
    """Number of active concentrations per (drug, line), then how often each number occurs."""
    per = df.groupBy(*keys).agg(F.count_if(F.col(auc) >= limit).alias("n_active"))
    return per.groupBy("n_active").agg(F.count(F.lit(1)).alias("frequency"))


def lethality_degree(df: DataFrame, drug: str, line: str, viability: str, limit: float = 0.25) -> DataFrame:
    """Lethal treatments per drug, never more than there are lines."""
    n_lines = df.agg(F.count_distinct(line)).scalar()
    hits = df.groupBy(drug).agg(F.count_if(F.col(viability) <= limit).alias("_h"))
    return hits.select(drug, F.least(F.col("_h"), n_lines).alias("lethality"))


def dynamic_range(df: DataFrame, drug: str, line: str, auc: str, minimum: float = 0.21) -> DataFrame:
    """max - min over lines of the mean AUC; drugs above ``minimum``."""
    per = df.groupBy(drug, line).agg(F.avg(auc).alias("_a"))
    return per.groupBy(drug).agg((F.max("_a") - F.min("_a")).alias("dynamic_range")).where(F.col("dynamic_range") > minimum)


def cv_top_fraction(df: DataFrame, probe: str, value: str, fraction: float = 0.1) -> DataFrame:
    """sd/mean per probe, the floor(fraction·n) most variable probes."""
    cv = df.groupBy(probe).agg((F.try_divide(F.stddev_samp(value), F.avg(value))).alias("cv"))
    ranked = row_order(cv.where("cv IS NOT NULL"), [], "cv", [probe], "_r", descending=True, total_as="_n")
    return ranked.where(F.col("_r") <= F.floor(F.col("_n") * F.lit(fraction))).drop("_r", "_n")


def var_top_n(df: DataFrame, feature: str, value: str, n: int) -> DataFrame:
    """The n features of largest sd (ties by name). A top-k report."""
    return df.groupBy(feature).agg(F.stddev_samp(value).alias("sd")).orderBy(F.col("sd").desc(), F.col(feature)).limit(n)


def pivot_mean(df: DataFrame, rows: list[str], column: str, value: str, fill=None, columns: list | None = None) -> DataFrame:
    g = df.groupBy(*rows)
    out = (g.pivot(column, columns) if columns else g.pivot(column)).agg(F.avg(value))
    return out if fill is None else out.fillna(fill)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def collapse_strings(df: DataFrame, keys: list[str], value: str, name: str, sep: str = ";") -> DataFrame:
    """Distinct values in order, pasted; repeats are dropped map-side first."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), sep).alias(name))


def contingency_margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long cross-table with a TOTAL row and column, ordered by the margins."""
    c = df.cube(row, column).agg(F.count(F.lit(1)).alias("n"), F.grouping(row).alias("_gr"), F.grouping(column).alias("_gc"))
    name = lambda c, g: F.when(F.col(g) == 1, F.lit("TOTAL")).otherwise(F.col(c).cast("string"))
    return c.select(name(row, "_gr").alias(row), name(column, "_gc").alias(column), "n").orderBy(F.col("n").desc(), row, column)


def pixel_histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


# The quantiles reported per channel
HISTOGRAM_PROBS = {"q1": 0.01, "q5": 0.05, "q10": 0.10, "q25": 0.25, "q75": 0.75, "q90": 0.90, "q95": 0.95, "q99": 0.99, "median": 0.5}


def histogram_quantiles(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Smallest value whose running count reaches p·N, from (value, count) rows, with min, max, mean."""
    cells = value_counts_running(counts, keys, value, n)
    aggs = [F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("mean")]
    for name, p in HISTOGRAM_PROBS.items():
        aggs.append(F.min(F.when(F.col("before_c") + F.col(n) >= F.col("total_c") * p, F.col(value))).alias(name))
    return cells.groupBy(*keys).agg(*aggs)


def value_counts_running(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    v = value_order(counts, keys, value, {"c": F.col(n)})
    return v.select(*keys, value, F.col("c").alias(n), "before_c", "total_c")


def coverage_matrix(df: DataFrame, interval: str, sample: str, reads: str, samples: list | None = None) -> DataFrame:
    """Intervals × samples with the row mean, ordered by it, and the overall mean as what to expect."""
    g = df.groupBy(interval)
    wide = (g.pivot(sample, samples) if samples else g.pivot(sample)).agg(F.sum(reads)).fillna(0)
    cols = [c for c in wide.columns if c != interval]
    mean = sum((F.col(f"`{c}`") for c in cols), F.lit(0.0)) / len(cols)
    wide = wide.withColumn("mean", mean)
    expected = wide.agg(F.avg("mean")).scalar()
    return wide.withColumn("expected", expected).orderBy("mean")


def running_share(df: DataFrame, order: str, value: str) -> DataFrame:
    """value / sum and its running sum in ``order``, for a short list such as components."""
    r = running(df.withColumn("_b", one_bucket(order)), [], "_b", [F.col(order).asc()], {"v": F.col(value)})
    return r.withColumn("share", F.col(value) / F.col("total_v")).withColumn("cumulative", (F.col("before_v") + F.col(value)) / F.col("total_v")).drop("_b", "before_v", "total_v")
