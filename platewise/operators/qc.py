"""Object quality filters and feature checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.expr import hash_unit, is_finite, nsjoin
from platewise.operators.forest import DEPTH, group_key, grow_nodes, score_forests
from platewise.operators.normalize import plate_effect_correct
from platewise.operators.order import group_quantiles, hash_order, running
from platewise.session import cut_lineage

MIN_SIZE = 300  # fixed value: smallest object area kept
IMAGE_WIDTH = 2048  # fixed value: pixels per image side


def size_outlier_filter(df: DataFrame, keys: list[str], size: str, low: float = MIN_SIZE, prob: float = 0.95) -> DataFrame:
    """low <= size < p95 of the group (line)."""
    top = group_quantiles(df, keys, size, {"_top": prob})
    return nsjoin(df, top, keys).where((F.col(size) >= low) & (F.col(size) < F.col("_top"))).drop("_top")


def eccentricity_filter(df: DataFrame, ecc: str, limit: float = 0.95) -> DataFrame:
    return df.where(F.col(ecc) < limit)


def boundary_filter(df: DataFrame, radius: str, cx: str, cy: str, width: float = IMAGE_WIDTH) -> DataFrame:
    """Largest radius smaller than the distance from the centre to each image edge."""
    edge = F.least(F.col(cx), width - F.col(cx), F.col(cy), width - F.col(cy))
    return df.where(F.col(radius) < edge)


def blur_label(df: DataFrame, keys: list[str], means: list[str], ids: list[str], good: float = 0.5, bad: float = 0.3, seed: str = "blur") -> DataFrame:
    """Pseudo-labels per plate, both classes drawn with replacement to the smaller size.

    score = largest channel mean; good at or above its median, blurry at or below
    its 30th percentile. Draw i of a class takes the row whose shuffled position is
    floor(u·size)+1; the rows themselves enumerate the draws, so nothing is
    generated per plate in one place.
    """
    scored = df.withColumn("_score", F.greatest(*means) if len(means) > 1 else F.col(means[0]))
    cuts = group_quantiles(scored, keys, "_score", {"_good": good, "_bad": bad})
    labelled = nsjoin(scored, cuts, keys)
    labels = F.array_compact(F.array(
        F.when(F.col("_score") >= F.col("_good"), F.lit("good")), F.when(F.col("_score") <= F.col("_bad"), F.lit("blurry"))))
    labelled = labelled.withColumn("label", F.explode(labels)).drop("_score", "_good", "_bad")
    cell = [*keys, "label"]
    sized = cut_lineage(hash_order(labelled, cell, ids, salt=seed, name="_i", total_as="_size"))
    sizes = sized.groupBy(*cell).agg(F.count(F.lit(1)).alias("_s"))
    least = sizes.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 2, F.min("_s")).otherwise(F.lit(0)).alias("_draws"))
    sized = nsjoin(sized, least, keys)
    u = hash_unit(*keys, "label", "_i", salt=seed)
    draws = sized.where(F.col("_i") <= F.col("_draws")).select(*cell, F.col("_i").alias("draw"), (F.floor(u * F.col("_size")) + 1).alias("_i"))
    return nsjoin(draws, sized.drop("_size", "_draws"), [*cell, "_i"]).drop("_i")


def correlation(a: str, b: str) -> Column:
    """Correlation as one aggregate; null where a column is constant, which Spark's own does not tolerate."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def blur_feature_select(sample: DataFrame, features: list[str], key_features: list[str], limit: float = 0.9) -> DataFrame:
    """feature, sd, max_corr with the labelling features, keep. One aggregate pass."""
    aggs: list[Column] = []
    for i, f in enumerate(features):
        aggs.append(F.stddev_pop(f).alias(f"sd{i}"))
        aggs += [correlation(f, k).alias(f"c{i}_{j}") for j, k in enumerate(key_features)]
    one = sample.agg(*aggs)
    rows = []
    for i, f in enumerate(features):
        cs = [F.abs(F.col(f"c{i}_{j}")) for j in range(len(key_features))]
        rows.append(F.struct(F.lit(f).alias("feature"), F.col(f"sd{i}").alias("sd"), (F.greatest(*cs) if len(cs) > 1 else cs[0]).alias("max_corr")))
    keep = (F.col("sd") != 0) & (F.coalesce(F.col("max_corr"), F.lit(0.0)) < limit)
    return one.select(F.inline(F.array(*rows))).withColumn("keep", keep)


def blur_choices(sample: DataFrame, keys: list[str], features: list[str], means: list[str], limit: float = 0.9) -> DataFrame:
    """(g, k, allowed): per plate the features that vary in its sample and follow no labelling feature, in one pass."""
    aggs = [F.stddev_pop(f).alias(f"_s{i}") for i, f in enumerate(features)] + [correlation(f, m).alias(f"_c{i}_{j}") for i, f in enumerate(features) for j, m in enumerate(means)]
    one = sample.groupBy(group_key(keys).alias("g")).agg(*aggs)
    # a constant labelling feature correlates with nothing
    close = lambda i: reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(f"_c{i}_{j}")) >= limit, F.lit(False)) for j in range(len(means))])
    keep = [F.when((F.col(f"_s{i}") > 0) & ~close(i), F.lit(i)) for i in range(len(features))]
    return one.select("g", F.lit("blur").alias("k"), F.array_compact(F.array(*keep)).alias("allowed"))


def blur_classifier_filter(df: DataFrame, keys: list[str], features: list[str], means: list[str], ids: list[str], trees: int = 100, depth: int = DEPTH,
                           limit: float = 0.9) -> DataFrame:
    """Rows that their plate's random forest, trained on the pseudo-labels, calls good.

    A forest per plate, all grown at once. Features that correlate with a labelling feature at ``limit`` or
    more in the plate's sample are left out, as are constant ones; 75 % of the draws train. A plate without a
    usable feature has no forest and keeps its rows, and so does a row that has a null or NaN feature only if its leaf says good.
    """
    sample = cut_lineage(blur_label(df, keys, means, ids))
    choices = cut_lineage(blur_choices(sample, keys, features, means, limit))
    train = sample.where(hash_unit(*ids, "draw", salt="split") < 0.75)
    forests = grow_nodes(train, keys, [*ids, "label", "draw"], features, F.col("label") == "good", choices, trees, depth)
    scored = score_forests(df, forests, keys, ids, features, "_prob")
    good = scored.where("_prob > 0.5").select(*df.columns)
    have = forests.select("g").distinct()
    return good.unionByName(df.withColumn("_g", group_key(keys)).join(have.withColumnRenamed("g", "_g"), "_g", "left_anti").select(*df.columns))


def preprocess_line(df: DataFrame, line: str, plate: str, control: Column, ids: list[str], features: list[str], size: str, radius: str, cx: str, cy: str,
                    means: list[str] | None, low: float = MIN_SIZE, prob: float = 0.95, trees: int = 100, controls: str = "_control") -> DataFrame:
    """The preprocessing of raw objects: size, boundary and blur filters, then plate and batch correction of all features.

    Without ``means`` the blur step is left out. All columns come back, the features corrected.
    """
    rows = boundary_filter(size_outlier_filter(df.withColumn(controls, control), [line], size, low, prob), radius, cx, cy)
    if means:
        rows = cut_lineage(blur_classifier_filter(cut_lineage(rows), [line, plate], features, means, ids, trees))
    return plate_effect_correct(rows, line, plate, F.col(controls), features).drop(controls)


def size_histogram(df: DataFrame, keys: list[str], area: str, delta: float = 5.0) -> DataFrame:
    """Counts of floor(sqrt(area)/delta), their share and running share per group."""
    bins = df.withColumn("bin", (F.floor(F.sqrt(area) / F.lit(delta)) * F.lit(int(delta))).cast("long")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    out = running(bins.withColumn("_b", F.floor(F.col("bin") / 1000)), keys, "_b", [F.col("bin").asc()], {"n": F.col("n")})
    out = out.withColumn("fraction", F.col("n") / F.col("total_n")).withColumn("cumulative", (F.col("before_n") + F.col("n")) / F.col("total_n"))
    return out.drop("_b", "before_n", "total_n")


def top_size_quantile(df: DataFrame, keys: list[str], size: str, prob: float, largest: bool = True) -> DataFrame:
    """Rows at or above (or, mirrored, at or below) the quantile of their group."""
    q = nsjoin(df, group_quantiles(df, keys, size, {"_q": prob}), keys)
    return q.where(F.col(size) >= F.col("_q") if largest else F.col(size) <= F.col("_q")).drop("_q")


def feature_schema_check(names: DataFrame, unit: list[str], name: str) -> DataFrame:
    """Units per distinct feature-name set, with whether there is just one set.

    A unit's names are bounded by the feature schema.
    """
    per_unit = names.select(*unit, name).distinct().groupBy(*unit).agg(F.md5(F.concat_ws(",", F.sort_array(F.collect_set(name)))).alias("signature"))
    sets = per_unit.groupBy("signature").agg(F.count(F.lit(1)).alias("units"))
    total = sets.agg(F.count(F.lit(1))).scalar()
    return sets.withColumn("consistent", total == 1)


def finite_common_features(df: DataFrame, line: str, features: list[str]) -> DataFrame:
    """Features finite in every row of every line, with the number of lines that spoil the others."""
    per_line = df.groupBy(line).agg(*[F.max((~is_finite(f)).cast("int")).alias(f) for f in features])
    spoiled = per_line.unpivot([line], features, "feature", "bad").groupBy("feature").agg(F.sum("bad").alias("bad_lines"))
    return spoiled.withColumn("common", F.col("bad_lines") == 0)
