"""Normalisation against controls and batch correction.

Statistics come from the control rows in long form; the correction is joined to
the wide objects as one row per plate (or line), so the big side is neither
exploded nor sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.expr import MAD_TO_SD, attach, nsjoin, ratio
from platewise.operators import radix
from platewise.operators.order import group_median, group_median_mad, row_order, value_order
from platewise.operators.radix import array_statistics, named_statistics
from platewise.session import cut_lineage


SURFACE_NUMBERS = 1_000_000  # distances of a surface held at once
SURFACE_CONDITION = 1e8  # of normal equations; beyond it a point is fitted by itself


def _long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(ids, features, "feature", "value")


def _widen(stats: DataFrame, keys: list[str], features: list[str], values: list[str]) -> DataFrame:
    """One row per key with ``_<value>_<feature>`` columns."""
    aggs = [F.max(F.when(F.col("feature") == f, F.col(v))).alias(f"_{v}_{f}") for f in features for v in values]
    return cut_lineage(stats.groupBy(*keys).agg(*aggs))


def plate_effects(df: DataFrame, line: str, plate: str, control: Column, features: list[str]) -> DataFrame:
    """One row per plate: ``_middle_<f>`` (control median), ``_centre_<f>`` and ``_factor_<f>``.

    The centre is the median of the line's plate medians, the factor the median of its plate MADs over the plate's own.
    """
    plates = named_statistics(df.where(control), [line, plate], features, {"_middle": 0.5}, "_dev")
    own = [f"{s}_{f}" for s in ("_middle", "_dev") for f in features]
    lines = named_statistics(plates, [line], own, {"_of": 0.5})
    both = nsjoin(plates, lines, [line])
    return cut_lineage(both.select(line, plate, *[c for f in features for c in (F.col(f"_middle_{f}"), F.col(f"_of__middle_{f}").alias(f"_centre_{f}"), ratio(f"_of__dev_{f}", f"_dev_{f}").alias(f"_factor_{f}"))]))


def plate_effect_correct(df: DataFrame, line: str, plate: str, control: Column, features: list[str]) -> DataFrame:
    """Shift each plate's control median to the line's centre, scale about it to the line's spread.

    A plate without controls, or with zero MAD, gives nulls.
    """
    out = nsjoin(df, plate_effects(df, line, plate, control, features), [line, plate], "left")
    fixed = {f: ((F.col(f) - F.col(f"_middle_{f}")) * F.col(f"_factor_{f}") + F.col(f"_centre_{f}")).alias(f) for f in features}
    return out.select(*[fixed.get(c, F.col(c)) for c in df.columns])


def plate_effect_correct_vector(df: DataFrame, line: str, plate: str, control: Column, vector: str = "features") -> DataFrame:
    """The same on an array column of equal length in every row, which stays an array throughout."""
    nan = F.lit(float("nan"))
    full = F.transform(vector, lambda v: F.coalesce(v.cast("double"), nan))
    width = df.agg(F.max(F.size(vector))).first()[0] or 0
    if width < 1:
        return df
    rows = df.where(control & (F.size(vector) == width)).select(line, plate, full.alias("x"))
    at = lambda i: F.transform("stats", lambda s: s[i])
    plates = cut_lineage(array_statistics(rows, [line, plate], width, [0.5], True).select(line, plate, at(0).alias("middle"), at(1).alias("dev")))
    both = array_statistics(plates.select(line, F.concat("middle", "dev").alias("x")), [line], 2 * width, [0.5])
    lines = both.select(line, F.slice(at(0), 1, width).alias("centre"), F.slice(at(0), width + 1, width).alias("spread"))
    effects = nsjoin(plates, lines, [line])
    factor = F.zip_with("spread", "dev", lambda a, b: F.try_divide(a, b))
    effects = effects.select(line, plate, F.arrays_zip("middle", "centre", factor.alias("factor")).alias("_fx"))
    out = attach(df, effects, [line, plate], "left")
    null = lambda v: F.when(~F.isnan(v), v)
    fixed = F.zip_with(vector, "_fx", lambda x, e: null((x - e["middle"]) * e["factor"] + e["centre"]))
    return out.withColumn(vector, fixed).drop("_fx")


def batch_effect_correct(df: DataFrame, line: str, batch1: Column, batch2: Column, target: Column, features: list[str]) -> DataFrame:
    """Map the target lines from batch 2 onto batch 1.

    shift = med(b1) - med(b2), stretch = MAD(b1)/MAD(b2); every target line is shifted,
    then stretched about its own shifted median.
    """
    ids = [line]
    both = _long(df.where(batch1 | batch2).withColumn("_batch", F.when(batch1, 1).otherwise(2)), ["_batch"], features)
    stats = group_median_mad(both, ["_batch", "feature"], "value", "med", "mad")
    one, two = F.col("_batch") == 1, F.col("_batch") == 2
    shift = stats.groupBy("feature").agg(
        (F.max(F.when(one, F.col("med"))) - F.max(F.when(two, F.col("med")))).alias("shift"),
        F.max(F.when(one, F.col("mad"))).alias("_m1"), F.max(F.when(two, F.col("mad"))).alias("_m2"),
    ).select("feature", "shift", ratio("_m1", "_m2").alias("stretch"))
    own = group_median(_long(df.where(target), ids, features), [*ids, "feature"], "value", "own")
    wide = _widen(nsjoin(own, shift, ["feature"]), ids, features, ["own", "shift", "stretch"])
    out = nsjoin(df, wide, ids, "left")
    moved = lambda f: (F.col(f) - F.col(f"_own_{f}")) * F.col(f"_stretch_{f}") + F.col(f"_own_{f}") + F.col(f"_shift_{f}")
    fixed = {f: F.when(target, moved(f)).otherwise(F.col(f)).alias(f) for f in features}
    return out.select(*[fixed.get(c, F.col(c)) for c in df.columns])


def _boxcox(x: Column, lam: Column) -> Column:
    return F.when(F.abs(lam) < 1e-12, F.ln(x)).otherwise((F.pow(x, lam) - 1) / lam)


def boxcox_lambda(df: DataFrame, keys: list[str], value: str, max_lambda: float = 5.0, trim: float = 0.05, tolerance: float = 1e-8) -> DataFrame:
    """λ per group that brings the skew of the trimmed, min–max scaled values nearest 0.

    The search runs for all groups at once: each pass evaluates 33 candidates from
    mergeable power sums and keeps the interval in which the skew changes sign,
    which narrows it to a 32nd, until it is within the tolerance. The range is [0, 1] for right skew at λ = 1,
    otherwise [1, max_lambda]. Constant groups are left out.
    """
    v = value_order(df.select(*keys, value).where(~F.isnan(value)), keys, value)
    cut = F.floor(F.lit(trim) * F.col("total_n"))
    kept = F.greatest(F.lit(0), F.least(F.col("before_n") + F.col("n"), F.col("total_n") - cut) - F.greatest(F.col("before_n"), cut))
    v = v.withColumn("_w", kept).where("_w > 0")
    rng = v.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max")).where("_max > _min")
    x = nsjoin(v, rng, keys).select(*keys, "_w", ((F.col(value) - F.col("_min")) / (F.col("_max") - F.col("_min")) + 1e-6).alias("_x"))
    x = cut_lineage(x)

    def skews(grid: DataFrame) -> DataFrame:
        t = nsjoin(x, grid, keys).withColumn("_t", _boxcox(F.col("_x"), F.col("lam")))
        s = t.groupBy(*keys, "lam").agg(
            F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_t")).alias("s1"),
            F.sum(F.col("_w") * F.pow("_t", F.lit(2.0))).alias("s2"), F.sum(F.col("_w") * F.pow("_t", F.lit(3.0))).alias("s3"))
        m = F.col("s1") / F.col("n")
        m2 = F.col("s2") / F.col("n") - m * m
        m3 = F.col("s3") / F.col("n") - 3 * m * F.col("s2") / F.col("n") + 2 * m * m * m
        return s.select(*keys, "lam", F.try_divide(m3, F.pow(F.greatest(m2, F.lit(0.0)), F.lit(1.5))).alias("skew"))

    start = skews(rng.select(*keys, F.lit(1.0).alias("lam")))
    right = F.col("skew") > 0
    box = start.select(*keys, F.when(right, 0.0).otherwise(1.0).alias("lo"), F.when(right, 1.0).otherwise(float(max_lambda)).alias("hi"))
    width = max(1.0, float(max_lambda) - 1.0)
    while width > tolerance:
        width /= 32
        grid = box.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / 32)).alias("lam"))
        got = skews(grid).where(F.col("skew").isNotNull())
        # skew grows with λ: the last negative and the first positive candidate bracket the root
        box = cut_lineage(got.groupBy(*keys).agg(
            F.coalesce(F.max(F.when(F.col("skew") <= 0, F.col("lam"))), F.min("lam")).alias("lo"),
            F.coalesce(F.min(F.when(F.col("skew") >= 0, F.col("lam"))), F.max("lam")).alias("hi"),
            F.min_by("lam", F.abs("skew")).alias("best"), F.min(F.abs("skew")).alias("abs_skew")))
    return box.select(*keys, F.col("best").alias("lam"), "abs_skew")


def _boxcox_root(v: np.ndarray, max_lambda: float, trim: float = 0.05, tolerance: float = 1e-8) -> float:
    """λ of ``boxcox_lambda`` for the values of one group, NaN where they are constant."""
    v = np.sort(v[~np.isnan(v)])
    cut = int(np.floor(trim * len(v)))
    v, w = np.unique(v[cut:len(v) - cut], return_counts=True)
    if len(v) < 2:
        return np.nan
    x, w = (v - v[0]) / (v[-1] - v[0]) + 1e-6, w / w.sum()

    def skews(lam: np.ndarray) -> np.ndarray:
        power = np.where(np.abs(lam) < 1e-12, 1.0, lam)[:, None]
        t = np.where(np.abs(lam)[:, None] < 1e-12, np.log(x)[None, :], (x[None, :] ** power - 1) / power)
        t -= (t @ w)[:, None]
        return ((t * t * t) @ w) / ((t * t) @ w) ** 1.5

    lo, hi = (0.0, 1.0) if skews(np.ones(1))[0] > 0 else (1.0, float(max_lambda))
    width, best = max(1.0, float(max_lambda) - 1.0), 0.0
    while width > tolerance:
        width /= 32
        lam = lo + (hi - lo) * np.arange(33) / 32
        skew = skews(lam)
        lam, skew = lam[~np.isnan(skew)], skew[~np.isnan(skew)]
        if not len(lam):
            break
        best = lam[np.abs(skew).argmin()]
        lo, hi = lam[skew <= 0].max(initial=lam.min()), lam[skew >= 0].min(initial=lam.max())
    return float(best)


def boxcox_transform(df: DataFrame, plate: str, control: Column, ids: list[str], features: list[str], max_lambda: float = 5.0) -> DataFrame:
    """Box–Cox per plate and feature with λ from the controls; keeps each plate's median and MAD.

    Long result (ids, plate, feature, value, lam); constant control features pass through. The rows are written once
    and dealt by plate once, wide; plates that fit a task are finished there. Larger ones go by long form.
    """
    wide = cut_lineage(df.select(*ids, plate, F.coalesce(control, F.lit(False)).alias("_control"), *[F.col(f).cast("double").alias(f) for f in features]))
    large = cut_lineage(wide.groupBy(plate).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * len(features) > radix.TASK_VALUES).select(plate))
    if large.isEmpty():
        return _boxcox_in_task(wide, plate, ids, features, max_lambda)
    rest = _boxcox_in_task(radix.without(wide, large, [plate]), plate, ids, features, max_lambda)
    return rest.unionByName(_boxcox_long(cut_lineage(nsjoin(wide, large, [plate])), plate, ids, features, max_lambda))


def _boxcox_in_task(wide: DataFrame, plate: str, ids: list[str], features: list[str], max_lambda: float) -> DataFrame:
    """``boxcox_transform`` for plates that fit a task; the rows of a plate follow each other in a partition."""
    kept = [*ids, plate]
    schema = f"{radix.key_schema(wide, kept)}, feature string, value double, lam double"

    def result(table: pa.Table):
        code, first = radix.group_codes([table[plate]])
        groups, control = len(first), table["_control"].to_numpy()
        x = np.column_stack([table[f].to_numpy().astype(float) for f in features])
        null = np.column_stack([table[f].is_null().to_numpy() for f in features])
        starts = np.sort(first)
        lam = np.full((groups, len(features)), np.nan)
        for a, b in zip(starts, np.append(starts[1:], len(x)), strict=True):
            own = x[a:b][control[a:b]]
            lam[code[a]] = [_boxcox_root(own[:, j], max_lambda) for j in range(len(features))]
        # NaN is the largest number
        numbers = np.where(np.isnan(x), np.where(null, -np.inf, np.nan), x)
        low, high = np.empty_like(lam), np.empty_like(lam)
        low[code[starts]] = np.fmin.reduceat(np.where(np.isnan(x), np.inf, x), starts, axis=0)
        high[code[starts]] = np.maximum.reduceat(numbers, starts, axis=0)
        own_lam = lam[code]
        power = np.where(np.abs(own_lam) < 1e-12, 1.0, own_lam)
        y = np.where((high == low)[code], np.nan, (x - low[code]) / (high - low)[code]) + 2e-6
        t = np.where(np.abs(own_lam) < 1e-12, np.log(y), (y ** power - 1) / power)
        before, after = (radix.whole_groups(v, code, groups, [0.5], True)[1] for v in (x, t))
        centre, spread, own_spread = before[:, :, 0], before[:, :, 1], after[:, :, 1]
        moved = (t - after[code][:, :, 0]) * (spread / np.where(own_spread == 0, np.nan, own_spread))[code] + centre[code]
        same = np.isnan(own_lam)
        value = np.where(same, x, moved)
        # no number where the plate is constant or has no spread left
        none = null | ~same & ((high == low) | np.isnan(own_spread) | (own_spread == 0) | np.isnan(spread))[code]
        who = table.select(kept).combine_chunks()
        for j, f in enumerate(features):
            columns = [*who.columns, pa.array([f]).take(pa.array(np.zeros(len(x), np.int32))), pa.array(value[:, j], mask=none[:, j]), pa.array(own_lam[:, j], mask=same[:, j])]
            yield from pa.Table.from_arrays(columns, names=[*kept, "feature", "value", "lam"]).to_batches(max_chunksize=10_000)

    def run(batches):
        rest: pa.Table | None = None
        with np.errstate(all="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([rest, table]) if rest is not None else table
                code, _ = radix.group_codes([table[plate]])
                cut = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
                if cut:
                    yield from result(table.slice(0, cut))
                rest = table.slice(cut)
            if rest is not None:
                yield from result(rest)

    return wide.repartition(F.col(plate)).sortWithinPartitions(plate).mapInArrow(run, schema)


def _boxcox_long(df: DataFrame, plate: str, ids: list[str], features: list[str], max_lambda: float) -> DataFrame:
    """``boxcox_transform`` for plates of any size, with controls marked by ``_control``."""
    keys = [plate, "feature"]
    rows = _long(df, [*ids, plate], features)
    lam = boxcox_lambda(_long(df.where("_control"), [plate], features), keys, "value", max_lambda)
    stats = group_median_mad(rows, keys, "value", "_med", "_mad")
    span = rows.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    model = nsjoin(nsjoin(stats, span, keys), lam.select(*keys, "lam"), keys, "left")
    x = nsjoin(rows, model, keys).withColumn("_x", ratio(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")) + 2e-6)
    x = x.withColumn("_t", _boxcox(F.col("_x"), F.col("lam")))
    after = group_median_mad(x.where("_t IS NOT NULL").select(*keys, "_t"), keys, "_t", "_tmed", "_tmad")
    out = nsjoin(x, after, keys, "left")
    moved = (F.col("_t") - F.col("_tmed")) * ratio("_mad", "_tmad") + F.col("_med")
    return out.select(*ids, plate, "feature", F.when(F.col("lam").isNull(), F.col("value")).otherwise(moved).alias("value"), "lam")


def dmso_center_zscore(df: DataFrame, line: str, control: Column, features: list[str], by_control: bool = False) -> DataFrame:
    """x - mean(controls), then z-scored over the line, or divided by the controls' sd."""
    aggs = []
    for f in features:
        aggs.append(F.avg(F.when(control, F.col(f))).alias(f"_c_{f}"))
        aggs.append(F.avg(f).alias(f"_m_{f}"))
        aggs.append((F.stddev_samp(F.when(control, F.col(f))) if by_control else F.stddev_samp(f)).alias(f"_s_{f}"))
    out = attach(df, df.groupBy(line).agg(*aggs), [line])
    for f in features:
        x = F.col(f) - F.col(f"_c_{f}")
        z = x if by_control else x - (F.col(f"_m_{f}") - F.col(f"_c_{f}"))
        out = out.withColumn(f, ratio(z, f"_s_{f}"))
    return out.drop(*[f"_{k}_{f}" for f in features for k in "cms"])


def global_scale(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """Centre and z-scale on all rows (or within keys)."""
    aggs = [a for f in features for a in (F.avg(f).alias(f"_m_{f}"), F.stddev_samp(f).alias(f"_s_{f}"))]
    if keys:
        out = attach(df, df.groupBy(*keys).agg(*aggs), keys)
    else:
        one = df.agg(*aggs)
        out = df.withColumn("_st", one.select(F.struct(*one.columns)).scalar())
        out = out.select(*df.columns, *[F.col(f"_st._{k}_{f}").alias(f"_{k}_{f}") for f in features for k in "ms"])
    for f in features:
        out = out.withColumn(f, ratio(F.col(f) - F.col(f"_m_{f}"), f"_s_{f}")).drop(f"_m_{f}", f"_s_{f}")
    return out


def trimmed_stats(df: DataFrame, keys: list[str], value: str, trim: float = 0.1) -> DataFrame:
    """Mean and population sd after cutting floor(trim·n) rows from each end.

    Works on distinct values with multiplicities, so ties across the cut are shared out exactly.
    """
    v = value_order(df.where(~F.isnan(F.col(value).cast("double"))), keys, value)
    cut = F.floor(F.lit(trim) * F.col("total_n"))
    kept = F.greatest(F.lit(0), F.least(F.col("before_n") + F.col("n"), F.col("total_n") - cut) - F.greatest(F.col("before_n"), cut))
    v = v.withColumn("_w", kept.cast("double")).where("_w > 0")
    mean = nsjoin(v, v.groupBy(*keys).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("trim_mean")), keys)
    return mean.groupBy(*keys).agg(
        F.first("trim_mean").alias("trim_mean"),
        F.sqrt(F.sum(F.col("_w") * F.pow(F.col(value) - F.col("trim_mean"), F.lit(2.0))) / F.sum("_w")).alias("trim_sd"))


def trimmed_robust_z(df: DataFrame, keys: list[str], value: str, name: str, trim: float = 0.1) -> DataFrame:
    """(x - trimmed mean) / trimmed sd."""
    out = attach(df, trimmed_stats(df, keys, value, trim), keys)
    return out.withColumn(name, ratio(F.col(value) - F.col("trim_mean"), "trim_sd")).drop("trim_mean", "trim_sd")


def dmso_trimmed_norm(df: DataFrame, line: str, control: Column, features: list[str], trim: float = 0.1) -> DataFrame:
    """Scale by the controls' trimmed mean and sd per line; a feature that is not
    finite somewhere in the line becomes 0 there."""
    stats = trimmed_stats(_long(df.where(control), [line], features), [line, "feature"], "value", trim)
    wide = _widen(stats, [line], features, ["trim_mean", "trim_sd"])
    out = nsjoin(df, wide, [line], "left")
    for f in features:
        out = out.withColumn(f, ratio(F.col(f) - F.col(f"_trim_mean_{f}"), f"_trim_sd_{f}"))
    out = out.drop(*[f"_{v}_{f}" for f in features for v in ("trim_mean", "trim_sd")])
    ok = out.groupBy(line).agg(*[F.min((F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf"))).cast("int")).alias(f"_ok_{f}") for f in features])
    out = attach(out, ok, [line])
    for f in features:
        out = out.withColumn(f, F.when(F.col(f"_ok_{f}") == 1, F.col(f)).otherwise(F.lit(0.0)))
    return out.drop(*[f"_ok_{f}" for f in features])


def replicate_robust_z(df: DataFrame, keys: list[str], ids: list[str], features: list[str]) -> DataFrame:
    """Long (ids, keys, feature, value, z): (x - median) / (1.4826·MAD) per (line, replicate)."""
    rows = _long(df, [*ids, *keys], features)
    st = group_median_mad(rows, [*keys, "feature"], "value", "_med", "_mad", scale=MAD_TO_SD)
    return nsjoin(rows, st, [*keys, "feature"]).withColumn("z", ratio(F.col("value") - F.col("_med"), "_mad")).drop("_med", "_mad")


def dmso_median_subtract(df: DataFrame, keys: list[str], control: Column, features: list[str]) -> DataFrame:
    """Subtract the controls' median of each (line, replicate)."""
    med = group_median(_long(df.where(control), keys, features), [*keys, "feature"], "value", "med")
    out = nsjoin(df, _widen(med, keys, features, ["med"]), keys, "left")
    for f in features:
        out = out.withColumn(f, F.col(f) - F.col(f"_med_{f}"))
    return out.drop(*[f"_med_{f}" for f in features])


def _loess_fit(n: np.ndarray, y: np.ndarray, px: np.ndarray, qx: np.ndarray, span: float) -> np.ndarray:
    """Local quadratic fit with tricube weights at qx; points px carry n equal rows of mean y."""
    scale = []
    for j in range(2):
        # sd of the coordinate after cutting a tenth of the rows from each end
        o = np.argsort(px[:, j], kind="stable")
        upto = np.cumsum(n[o])
        cut = np.floor(0.1 * upto[-1])
        w = np.maximum(0.0, np.minimum(upto, upto[-1] - cut) - np.maximum(upto - n[o], cut))
        x, total = px[o, j], max(w.sum(), 1.0)
        mean = (w * x).sum() / total
        sd = np.sqrt((w * (x - mean) ** 2).sum() / max(total - 1.0, 1.0))
        scale.append(sd if sd > 0 else 1.0)
    ps, qs = px / scale, qx / scale
    want = max(int(np.floor(n.sum() * span + 1e-5)), 1)
    step = max(1, SURFACE_NUMBERS // len(ps))
    return np.concatenate([_loess_at(n, y, ps, qs[i:i + step], want, span) for i in range(0, len(qs), step)])


def _quadratic(u: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(u)), u[:, 0], u[:, 1], u[:, 0] ** 2, u[:, 0] * u[:, 1], u[:, 1] ** 2])


def _loess_at(n: np.ndarray, y: np.ndarray, ps: np.ndarray, qs: np.ndarray, want: int, span: float) -> np.ndarray:
    """The fits at all points qs at once.

    A quadratic about q spans what one about the middle does, so all points share a basis and their normal equations are
    one product with the weights; a step on the residuals makes up for squaring the condition. Where the
    equations are near singular, least squares of the single point decide.
    """
    d = np.sqrt((ps[None, :, 0] - qs[:, None, 0]) ** 2 + (ps[None, :, 1] - qs[:, None, 1]) ** 2)
    order = np.argsort(d, axis=1)
    place = np.minimum((np.cumsum(n[order], axis=1) < want).sum(axis=1), len(ps) - 1)
    rows = np.arange(len(qs))
    reach = np.maximum(d[rows, order[rows, place]] * (1 if span <= 1 else np.sqrt(span)), 1e-12)[:, None]
    w = np.where(d < reach * 0.999, (1 - np.minimum(d / reach, 1) ** 3) ** 3, 0.0) * n
    middle, level = ps.mean(axis=0), y.mean()
    basis, rest = _quadratic(ps - middle), y - level
    i, j = np.triu_indices(6)
    gram = np.empty((len(qs), 6, 6))
    gram[:, i, j] = gram[:, j, i] = w @ (basis[:, i] * basis[:, j])
    try:
        inverse = np.linalg.inv(gram)
    except np.linalg.LinAlgError:
        inverse = np.full_like(gram, np.nan)
        for k in rows:
            if np.linalg.matrix_rank(gram[k]) == 6:
                inverse[k] = np.linalg.inv(gram[k])
    beta = np.zeros((len(qs), 6))
    for _ in range(2):
        beta += np.einsum("qij,qj->qi", inverse, (w * (rest - beta @ basis.T)) @ basis)
    out = level + (_quadratic(qs - middle) * beta).sum(axis=1)
    condition = np.abs(gram).sum(axis=1).max(axis=1) * np.abs(inverse).sum(axis=1).max(axis=1)
    for k in np.flatnonzero(~(condition < SURFACE_CONDITION)):
        sw = np.sqrt(w[k])
        out[k] = np.linalg.lstsq(_quadratic(ps - qs[k]) * sw[:, None], y * sw, rcond=None)[0][0]
    return out


def well_surface_correct(df: DataFrame, screen: str, row: str, col: str, value: str, control: Column, span: float = 0.75) -> DataFrame:
    """Subtract a smooth row/column surface fitted to the controls of each screen.

    Adds ``norm_fac`` and ``<value>_norm`` = value - (fit - median fit over the rows).
    Rows are first reduced to plate positions (at most the wells of a plate), so the
    per-screen numpy step has a bounded input however many rows a screen holds.
    """
    cells = df.groupBy(screen, row, col).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(control, F.col(value))).alias("n"), F.avg(F.when(control, F.col(value))).alias("y"))

    def fit(t: pa.Table) -> pa.Table:
        n, y, rows = (t[c].to_numpy().astype(float) for c in ("n", "y", "rows"))
        at = np.column_stack([t[c].to_numpy().astype(float) for c in (row, col)])
        c = n > 0
        f = _loess_fit(n[c], y[c], at[c], at, span) if c.sum() >= 6 else np.full(len(n), np.nan)
        o = np.argsort(f)
        cum = np.cumsum(rows[o])
        total = int(cum[-1])
        mid = f[o][np.searchsorted(cum, [(total - 1) // 2, total // 2], side="right")].mean()
        return t.select([screen, row, col]).append_column("norm_fac", pa.array(f)).append_column("_shift", pa.array(f - mid))

    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = f"`{screen}` {types[screen]}, `{row}` {types[row]}, `{col}` {types[col]}, norm_fac double, _shift double"
    surface = cells.groupBy(screen).applyInArrow(fit, schema)
    out = attach(df, surface, [screen, row, col])
    return out.withColumn(f"{value}_norm", F.col(value) - F.col("_shift")).drop("_shift")


def clip_negative(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.greatest(F.lit(0.0), F.col(value)))


def control_ratio(df: DataFrame, keys: list[str], value: str, control: Column, name: str = "viability") -> DataFrame:
    """value / median of the screen's controls; screens without controls drop out."""
    med = group_median(df.where(control), keys, value, "_med")
    return nsjoin(df, med, keys).withColumn(name, ratio(value, "_med")).drop("_med")


def quantile_normalize(df: DataFrame, sample: str, item: str, value: str, name: str = "normalized") -> DataFrame:
    """Give all samples the mean distribution by rank; samples must be equally long."""
    ranked = row_order(df, [sample], value, [item], "_rank")
    means = ranked.groupBy("_rank").agg(F.avg(value).alias(name))
    return attach(ranked, means, ["_rank"]).drop("_rank")


def feature_scale_by_view(df: DataFrame, keys: list[str], value: str, view: str, scale_only: list[str], name: str) -> DataFrame:
    """z-scale within (feature, view); the listed views are divided by sd without centring."""
    st = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    centre = F.when(F.col(view).isin(scale_only), 0.0).otherwise(F.col("_m"))
    return attach(df, st, keys).withColumn(name, ratio(F.col(value) - centre, "_s")).drop("_m", "_s")


def matrix_center_scale(df: DataFrame, keys: list[str], value: str, name: str, center: bool = True, scale: bool = True) -> DataFrame:
    """Column-wise centring and/or scaling of a long matrix; keys name the column."""
    st = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    x = F.col(value) - F.col("_m") if center else F.col(value)
    return attach(df, st, keys).withColumn(name, ratio(x, "_s") if scale else x).drop("_m", "_s")


def center_by_group_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    med = group_median(df, keys, value, "_med")
    return nsjoin(df, med, keys).withColumn(name, F.col(value) - F.col("_med")).drop("_med")


def zscore_columns(df: DataFrame, keys: list[str], value: str, name: str = "z") -> DataFrame:
    return matrix_center_scale(df, keys, value, name)
