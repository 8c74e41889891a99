"""Dimension reduction, classifiers and clustering.

MLlib where it has the method. The per-drug classifiers, of which there are
thousands, are fitted all at once by the blocked Newton steps of ``newton``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.expr import hash_text, hash_unit, nsjoin, ratio, with_group_stats
from platewise.operators.forest import grow_nodes, score_forests
from platewise.operators.joins import key_grid
from platewise.operators.newton import Prepared, areas, coefficients, fitted, optimality, prepare, searched, split_packs, start_packs, with_limits
from platewise.operators.order import group_median, group_quantiles, hash_order, row_order, value_order
from platewise.operators.pairs import block_pairs, cross_products
from platewise.operators.sampling import balanced_sample, number_in_group, train_test_split
from platewise.session import cut_lineage

# Inverse regularisation strengths tried, and folds
C_GRID = [5e-4, 1e-4, 5e-3, 1e-3, 5e-2, 1e-2]
PARAM_FOLDS = 5
MODEL_FOLDS = 10


# PCA -----------------------------------------------------------------------

class FittedPCA:
    """Scaler and PCA fitted on a table, with signs fixed by the largest loading."""

    def __init__(self, features: list[str], k: int, scaler: PipelineModel, components: np.ndarray, explained: np.ndarray):
        self.features, self.k, self.scaler = features, k, scaler
        self.components, self.explained = components, explained

    def transform(self, df: DataFrame, name: str = "pc") -> DataFrame:
        """Adds an array column with the k scores, by one matrix product a batch; null where a feature is null."""
        mean, scale = (np.asarray(v, float) for v in self.scaler)
        weights, k, width = self.components / scale[:, None], self.k, len(self.features)
        names = [*df.columns, name]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{name}` array<double>"])
        x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features])

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    y = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    scores = ((y - mean) @ weights).ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k), pa.array(scores, mask=np.isnan(scores)))
                    yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], lists], names=names)

        return df.withColumn("_x", x).mapInArrow(run, schema)

    def loadings(self, spark) -> DataFrame:
        rows = [(f, c + 1, float(self.components[i, c])) for i, f in enumerate(self.features) for c in range(self.k)]
        return spark.createDataFrame(rows, "feature string, component int, loading double")

    def variances(self, spark) -> DataFrame:
        return spark.createDataFrame([(c + 1, float(v)) for c, v in enumerate(self.explained)], "component int, explained double")


def pca_fit(df: DataFrame, features: list[str], k: int, scale: bool = True) -> FittedPCA:
    """Standardise, then MLlib PCA (its transform does not centre, so scores are taken here)."""
    vec = VectorAssembler(inputCols=features, outputCol="_x").transform(df.select(*features)).select("_x")
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=scale).fit(vec)
    model = PCA(k=k, inputCol="_z", outputCol="_p").fit(scaler.transform(vec))
    pc = model.pc.toArray()
    sign = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(k)])
    std = np.array(scaler.std.toArray()) if scale else np.ones(len(features))
    std[std == 0] = 1.0
    return FittedPCA(features, k, (scaler.mean.toArray(), std), pc * sign, model.explainedVariance.toArray())


def pca_control_only(df: DataFrame, control: Column, features: list[str], k: int, distance: str | None = None, prob: float = 0.8) -> tuple[FittedPCA, DataFrame]:
    """PCA of the control rows only, optionally without the rows beyond the distance quantile."""
    ctrl = df.where(control)
    if distance:
        limit = group_quantiles(ctrl, [], distance, {"q": prob}).select("q").scalar()
        ctrl = ctrl.where(F.col(distance) <= limit)
    return pca_fit(ctrl, features, k), ctrl


def pca_samples(df: DataFrame, item: str, sample: str, value: str, samples: list, k: int) -> DataFrame:
    """PCA of few samples over many items: eigenvectors of the samples' Gram matrix.

    Each item's row is centred over the samples; the Gram matrix (samples²) is one
    mergeable pass. Returns (sample, component, score, share).
    """
    wide = df.groupBy(item).agg(*[F.avg(F.when(F.col(sample) == s, F.col(value))).alias(f"s{i}") for i, s in enumerate(samples)]).dropna()
    mean = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(len(samples))]) / len(samples)
    gram = cross_products(wide.select(F.array(*[F.col(f"s{i}") - mean for i in range(len(samples))]).alias("v")), [], "v").where("i > 0").collect()
    m = np.zeros((len(samples), len(samples)))
    for r in gram:
        m[r.i - 1, r.j - 1] = m[r.j - 1, r.i - 1] = r.s
    lam, vec = np.linalg.eigh(m)
    order = np.argsort(lam)[::-1][:k]
    lam, vec = np.maximum(lam[order], 0), vec[:, order]
    vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(k)])
    rows = [(samples[i], c + 1, float(vec[i, c] * np.sqrt(lam[c])), float(lam[c] / max(np.trace(m), 1e-300))) for i in range(len(samples)) for c in range(k)]
    kind = df.schema[sample].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"`{sample}` {kind}, component int, score double, share double")


def loading_annotate(loadings: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    return loadings.join(dim, on, "left")


# effects -------------------------------------------------------------------

def effect_distance(df: DataFrame, line: str, drug: str, control: Column, features: list[str]) -> DataFrame:
    """Euclidean distance between a drug's mean and the line's control mean."""
    means = df.where(~control).groupBy(line, drug).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features])
    ctrl = df.where(control).groupBy(line).agg(*[F.avg(f).alias(f"_c_{f}") for f in features])
    d2 = reduce(lambda a, b: a + b, [(F.col(f) - F.col(f"_c_{f}")) * (F.col(f) - F.col(f"_c_{f}")) for f in features])
    return nsjoin(means, ctrl, [line]).select(line, drug, "n", F.sqrt(d2).alias("distance"))


def auc_rank(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """ROC-AUC by average ranks (Mann–Whitney)."""
    v = value_order(df, keys, score, {"pos": F.when(positive, 1).otherwise(0).cast("long")})
    mid = F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)
    s = v.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.max("total_n").alias("_n"), F.sum(mid * F.col("pos")).alias("_r"))
    u = F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / F.lit(2.0)
    return s.select(*keys, "n_pos", (F.col("_n") - F.col("n_pos")).alias("n_neg"), ratio(u, F.col("n_pos") * (F.col("_n") - F.col("n_pos"))).alias("auc"))


def classifier_parts(df: DataFrame, groups: list[str], drug: str | None, control: Column, ids: list[str], features: list[str], param_folds: int = PARAM_FOLDS, folds: int = MODEL_FOLDS, seed: str = "clf") -> Prepared:
    """The rows of all classifiers of a table, prepared once; rows with a value that is not finite take no part."""
    return prepare(df, groups, drug, control, ids, features, param_folds, folds, seed)


def drug_models(parts: Prepared, c_grid: list[float] | None = None, param_folds: int = PARAM_FOLDS, folds: int = MODEL_FOLDS, steps: int = 60, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """Treatments with their searched strength, and the fitted packs of their fold models."""
    names = searched(parts, c_grid or C_GRID, param_folds, steps, tolerance)
    return names, fitted(parts, start_packs(names, True, parts.width, [(None, f, 0) for f in range(folds)]), steps, tolerance)


def drug_vs_control_classifier(df: DataFrame, groups: list[str], drug: str, control: Column, ids: list[str], features: list[str], c_grid: list[float] | None = None,
                               param_folds: int = PARAM_FOLDS, folds: int = MODEL_FOLDS, steps: int = 60, seed: str = "clf") -> DataFrame:
    """Per treatment: C by cross-validated AUC on one half, then AUC and coefficients over folds of the other half.

    Returns keys, c, auc_mean, auc_std and the per-feature mean and sd of the coefficients. Folds without
    a held-out row of either label have no AUC and leave the mean.
    """
    parts = classifier_parts(df, groups, drug, control, ids, features, param_folds, folds, seed)
    names, packs = drug_models(parts, c_grid, param_folds, folds, steps)
    auc = areas(parts, packs, True).groupBy("g", "k").agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))
    coef = coefficients(packs, parts.width).groupBy("g", "k").agg(*[a for i, f in enumerate(features) for a in (
        F.avg(F.col("beta")[i + 1]).alias(f"mean_{f}"), F.stddev_pop(F.col("beta")[i + 1]).alias(f"std_{f}"))])
    return names.select("g", "k", *groups, drug, "c").join(coef, ["g", "k"]).join(auc, ["g", "k"], "left").drop("g", "k")


def drug_model_fits(df: DataFrame, groups: list[str], drug: str, control: Column, ids: list[str], features: list[str], c_grid: list[float] | None = None,
                    param_folds: int = PARAM_FOLDS, folds: int = MODEL_FOLDS, steps: int = 60, seed: str = "clf") -> DataFrame:
    """Per treatment and fold: training rows, cases among them, mean predicted probability and largest gradient, from the emitted coefficients.

    At the optimum the gradient is 0 and, since the intercept bears no penalty, the mean prediction is the share of cases.
    """
    parts = classifier_parts(df, groups, drug, control, ids, features, param_folds, folds, seed)
    names, packs = drug_models(parts, c_grid, param_folds, folds, steps)
    return names.select("g", "k", *groups, drug).join(optimality(parts, packs), ["g", "k"]).drop("g", "k")


def permuted_aucs(parts: Prepared, names: DataFrame, permutations: list[int], folds: int, steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """(g, k, perm, auc_mean, auc_std) over the folds of every permutation of the labels; 0 is the real labelling."""
    packs = with_limits(parts, start_packs(names, True, parts.width, [(None, f, p) for p in permutations for f in range(folds)]))
    auc = areas(parts, fitted(parts, packs, steps, tolerance))
    return auc.groupBy("g", "k", "perm").agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))


def classifier_permutation_p(df: DataFrame, groups: list[str], drug: str, control: Column, ids: list[str], features: list[str],
                             permutations: int = 1000, c_grid: list[float] | None = None, param_folds: int = PARAM_FOLDS, folds: int = MODEL_FOLDS, seed: str = "perm") -> DataFrame:
    """keys, c, auc, auc_std and p_value = (#{perm >= auc} + 1) / (B + 1), labels permuted inside each treatment's rows.

    C is searched on the real labels first. A permutation's cases are as many rows as the treatment has.
    """
    parts = classifier_parts(df, groups, drug, control, ids, features, param_folds, folds, seed)
    names = searched(parts, c_grid or C_GRID, param_folds, 60, 1e-7)
    res = cut_lineage(permuted_aucs(parts, names, list(range(permutations + 1)), folds))
    real = res.where("perm = 0").select("g", "k", F.col("auc_mean").alias("auc"), "auc_std")
    hits = res.where("perm > 0").join(real, ["g", "k"]).groupBy("g", "k").agg(((F.count_if(F.col("auc_mean") >= F.col("auc")) + 1) / (F.count("auc_mean") + 1)).alias("p_value"))
    return names.select("g", "k", *groups, drug, "c").join(real, ["g", "k"]).join(hits, ["g", "k"], "left").drop("g", "k")


def control_split_null(df: DataFrame, line: str, control: Column, ids: list[str], features: list[str], splits: int = 100, c: float | None = None, folds: int = MODEL_FOLDS,
                       c_grid: list[float] | None = None, param_folds: int = PARAM_FOLDS) -> DataFrame:
    """AUC of classifying random halves of the controls against each other: (line, split, auc_mean, auc_std).

    A split deals all controls of the line anew: which half of them plays the cases, which rows search C (unless it is
    given) and which are classified, and their folds.
    """
    parts = classifier_parts(df.where(control), [line], None, F.lit(True), ids, features, param_folds, folds, "null")
    names = cut_lineage(parts.names.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits)))))
    grid = [float(c)] if c is not None else c_grid or C_GRID
    if len(grid) == 1:
        names = names.withColumn("c", F.lit(grid[0]))
    else:
        auc = split_aucs(parts, names, False, [(x, f) for x in grid for f in range(param_folds)])
        mean = auc.where("auc is not null").groupBy("g", "perm", "c").agg(F.avg("auc").alias("a"))
        best = mean.groupBy("g", F.col("perm").cast("int").alias("split")).agg(F.max_by("c", F.struct("a", -F.col("c"))).alias("c"))
        names = cut_lineage(names.join(best, ["g", "split"], "left").withColumn("c", F.coalesce("c", F.lit(float(min(grid))))))
    out = split_aucs(parts, names, True, [(None, f) for f in range(folds)]).groupBy("g", "perm").agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))
    return parts.names.select("g", line).join(out, "g").select(line, F.col("perm").cast("int").alias("split"), "auc_mean", "auc_std")


def split_aucs(parts: Prepared, names: DataFrame, main: bool, settings: list[tuple[float | None, int]]) -> DataFrame:
    """Areas of all (c, fold) on one side of every split of names."""
    packs = with_limits(parts, split_packs(names, main, parts.width, settings))
    return areas(parts, fitted(parts, packs, 60, 1e-7))


# live / dead ---------------------------------------------------------------

def forest_fit(train: DataFrame, features: list[str], label: str, trees: int = 10, seed: int = 1) -> PipelineModel:
    vec = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="_x", labelCol=label, predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw", numTrees=trees, seed=seed)
    return PipelineModel(stages=[vec, rf.fit(vec.transform(cut_lineage(train.select(label, *features))))])


def live_dead_train(df: DataFrame, dead_control: Column, live_control: Column, ids: list[str], features: list[str], trees: int = 10, seed: str = "ld") -> tuple[PipelineModel, DataFrame]:
    """Random forest on balanced positive (dead) and negative (live) controls; 60 % train.

    Returns the model and the labelled table with its train/test split. live = 0, dead = 1.
    """
    lab = df.withColumn("dead", F.when(dead_control, 1.0).when(live_control, 0.0)).where("dead IS NOT NULL")
    lab = cut_lineage(train_test_split(balanced_sample(lab, [], "dead", ids, seed), ids, 0.6, f"{seed}split"))
    return forest_fit(lab.where("split = 'train'"), features, "dead", trees), lab


def live_dead_score(model: PipelineModel, df: DataFrame) -> DataFrame:
    p = vector_to_array("_prob")
    return model.transform(df).withColumn("prob_live", p[0]).withColumn("prob_dead", p[1]).withColumn("prediction", F.col("_pred").cast("int")).drop("_x", "_raw", "_prob", "_pred")


def roc_curve(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """(keys, threshold, fpr, tpr) at every distinct score, descending."""
    v = value_order(df, keys, score, {"pos": F.when(positive, 1).otherwise(0).cast("long")}, descending=True)
    tp = F.col("before_pos") + F.col("pos")
    fp = F.col("before_n") + F.col("n") - tp
    return v.select(*keys, F.col(score).alias("threshold"), ratio(fp, F.col("total_n") - F.col("total_pos")).alias("fpr"), ratio(tp, "total_pos").alias("tpr"))


def _hits(scored: DataFrame, keys: list[str], label: str) -> DataFrame:
    right = (F.col("_prob") > 0.5) == (F.col(label) == 1)
    return scored.groupBy(*keys).agg(F.avg(right.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def transfer_matrix(train: DataFrame, test: DataFrame, line: str, ids: list[str], features: list[str], label: str, trees: int = 10) -> DataFrame:
    """Accuracy of each line's forest on each line's hold-out: (line, model_line, accuracy, n).

    The forests of all lines grow together, and one pass scores every row with all of them.
    """
    kind = train.schema[line].dataType
    allowed = F.array(*[F.lit(i) for i in range(len(features))]).alias("allowed")
    choices = cut_lineage(train.where(F.col(line).isNotNull()).select(F.lit("").alias("g"), F.col(line).cast("string").alias("k")).distinct().select("g", "k", allowed))
    forests = grow_nodes(train, [], ids, features, F.col(label) == 1, choices, trees, own=F.col(line))
    scored = score_forests(test.select(line, *ids, *features, label), forests, [], ids, features, "_prob")
    return _hits(scored.withColumn("model_line", F.col("k").cast(kind)), [line, "model_line"], label)


def threshold_accuracy(df: DataFrame, keys: list[str], score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """Accuracy of score >= threshold for each threshold, and the first best one. One pass."""
    aggs = [F.avg((positive == (F.col(score) >= F.lit(float(c)))).cast("double")).alias(f"a{i}") for i, c in enumerate(thresholds)]
    s = df.groupBy(*keys).agg(*aggs)
    out = s.select(*keys, F.inline(F.array(*[F.struct(F.lit(float(c)).alias("threshold"), F.col(f"a{i}").alias("accuracy")) for i, c in enumerate(thresholds)])))
    return with_group_stats(out, keys, F.max_by("threshold", F.struct("accuracy", -F.col("threshold"))).alias("best_threshold"))


def feature_importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double").orderBy(F.col("importance").desc())


def channel_combo_sweep(lab: DataFrame, channels: dict[str, list[str]], combos: list[tuple], ids: list[str], label: str = "dead", trees: int = 10) -> DataFrame:
    """Hold-out accuracy of a forest per channel subset: (accuracy, n, channels). All subsets grow together on the same rows."""
    features = list(dict.fromkeys(f for c in channels.values() for f in c))
    rows = [("", "_".join(sorted(combo)), [features.index(f) for c in combo for f in channels[c]]) for combo in combos]
    choices = lab.sparkSession.createDataFrame(rows, "g string, k string, allowed array<int>")
    forests = grow_nodes(lab.where("split = 'train'"), [], ids, features, F.col(label) == 1, choices, trees)
    scored = score_forests(lab.where("split = 'test'").select(*ids, *features, label), forests, [], ids, features, "_prob")
    return _hits(scored.withColumn("channels", F.col("k")), ["channels"], label).select("accuracy", "n", "channels")


def feature_importance_rank(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """PCA-, LDA- and forest importance and the largest correlation with another feature.

    label: 0-based class. Means, scatter and correlations come from one pass of cross-products per class.
    """
    rows = df.select(F.col(label).cast("int").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    cells = cross_products(rows.select("_y", F.array(*features).alias("v")), ["_y"], "v").toPandas()
    d = len(features)
    mats = {}
    for y, sub in cells.groupby("_y"):
        m = np.zeros((d + 1, d + 1))
        m[sub.i, sub.j] = sub.s
        mats[y] = m + np.triu(m, 1).T
    total = sum(mats.values())
    n = total[0, 0]
    mean = total[0, 1:] / n
    cov = total[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, np.nan)
    lam, vec = np.linalg.eigh(cov)
    comp = np.abs(vec.T)
    pca = (comp / comp.sum(axis=1, keepdims=True) * (lam / lam.sum())[:, None]).sum(axis=0)
    within = sum(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0] for m in mats.values()) / max(n - len(mats), 1)
    means = np.array([m[0, 1:] / m[0, 0] for m in mats.values()])
    coef = np.abs((means - mean) @ np.linalg.pinv(within))
    lda = (coef / np.maximum(coef.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
    rf = forest_fit(rows.withColumnRenamed("_y", "label"), features, "label", trees=25).stages[-1].featureImportances.toArray()
    out = [(f, float(pca[i]), float(lda[i]), float(rf[i]), float(np.nanmax(corr[i])) if d > 1 else 0.0) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(out, "feature string, pca double, lda double, rf double, max_corr double")


# characteristic rows -------------------------------------------------------

def characteristic_rows(df: DataFrame, keys: list[str], ids: list[str], features: list[str], n: int = 1, share: float = 0.9) -> DataFrame:
    """The n rows nearest the median in each group's leading components.

    Features are z-scaled within the group, reduced to the components whose running
    variance share stays below ``share``, and compared by Mahalanobis distance to the median.
    Per group only a d×d matrix is solved; scores, medians and ranks are distributed.
    """
    gk = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    aggs = [a for f in features for a in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))]
    z = nsjoin(src.select(*gk, *ids, *features), src.groupBy(*gk).agg(*aggs), gk)
    z = z.select(*gk, *ids, F.array(*[F.coalesce(ratio(F.col(f) - F.col(f"_m_{f}"), f"_s_{f}"), F.lit(0.0)) for f in features]).alias("_z"))
    cells = cross_products(z.select(*gk, "_z"), gk, "_z")
    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    d = len(features)
    schema = ", ".join(f"`{k}` {types[k]}" for k in gk) + ", c int, w array<double>, lam double"

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((d + 1, d + 1))
        m[pdf.i, pdf.j] = pdf.s
        m = m + np.triu(m, 1).T
        cov = m[1:, 1:] / max(m[0, 0] - 1, 1)
        lam, vec = np.linalg.eigh(cov)
        lam, vec = lam[::-1], vec[:, ::-1]
        keep = np.flatnonzero((np.cumsum(lam) / max(lam.sum(), 1e-300) < share) & (lam > 1e-12))
        out = pd.DataFrame({"c": keep.astype("int32"), "w": [vec[:, k] for k in keep], "lam": lam[keep]})
        for k in reversed(gk):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    axis = cut_lineage(cells.groupBy(*gk).applyInPandas(axes, schema))
    dot = F.aggregate(F.zip_with("_z", "w", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    scores = cut_lineage(nsjoin(z, axis, gk).select(*gk, *ids, "c", "lam", dot.alias("_s")))
    med = group_median(scores, [*gk, "c"], "_s", "_med")
    dist = nsjoin(scores, med, [*gk, "c"]).groupBy(*gk, *ids).agg(F.sqrt(F.sum((F.col("_s") - F.col("_med")) * (F.col("_s") - F.col("_med")) / F.col("lam"))).alias("distance"))
    if n == 1:
        best = dist.groupBy(*gk).agg(F.min(F.struct("distance", *ids)).alias("_b")).select(*gk, *[F.col(f"_b.{i}").alias(i) for i in ids], F.col("_b.distance").alias("distance"))
    else:
        best = row_order(cut_lineage(dist), gk, "distance", ids, "_r").where(F.col("_r") <= n).drop("_r")
    return best if keys else best.drop("_all")


# clustering ----------------------------------------------------------------

def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x").transform(df)


def hierarchical_cut(df: DataFrame, item: str, features: list[str], k: int, control: str, seed: int = 1) -> DataFrame:
    """k groups of drugs by top-down splitting; a drug in the control's cluster is inactive."""
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster", minDivisibleClusterSize=1.0).fit(_vectors(df, features))
    out = cut_lineage(model.transform(_vectors(df, features)).select(item, "cluster"))
    own = out.where(F.col(item) == control).select("cluster").scalar()
    return out.withColumn("active", F.col("cluster") != own)


# factors and profiles ------------------------------------------------------

def _dot_with(vector: Column, weights: np.ndarray) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector.cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def factor_project(df: DataFrame, vector: str, weights: np.ndarray, name: str = "factor") -> DataFrame:
    """Scores X·pinv(W)ᵀ; weights: features × factors, a table of the schema's size."""
    proj = np.linalg.pinv(weights)
    for k in range(proj.shape[0]):
        df = df.withColumn(f"{name}{k + 1}", _dot_with(F.col(vector), proj[k]))
    return df


def factor_reconstruct(df: DataFrame, factors: list[str], weights: np.ndarray, name: str = "reconstructed") -> DataFrame:
    """Z·Wᵀ back to the features."""
    cells = [reduce(lambda a, b: a + b, [F.col(f) * F.lit(float(weights[i, k])) for k, f in enumerate(factors)]) for i in range(weights.shape[0])]
    return df.withColumn(name, F.array(*cells))


def multi_view_table(views: dict[str, DataFrame]) -> DataFrame:
    """Long (sample, feature, view, value) from one (sample, feature, value) table per view."""
    parts = [d.select("sample", "feature", F.lit(v).alias("view"), F.col("value").cast("double").alias("value")) for v, d in views.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def group_crosswalk(a: DataFrame, b: DataFrame, line: str, screen: str, batch: str) -> DataFrame:
    """overall group = image group (number of the screen) _ expression group (number of the batch)."""
    img = a.select(line, screen).distinct().withColumn("img_group", F.element_at(F.split(screen, "-"), -1).cast("long"))
    exp = number_in_group(b.select(line, batch).distinct().withColumn("_all", F.lit(0)), ["_all"], batch, "expr_group").drop("_all")
    return img.join(exp, line).withColumn("overall_group", F.concat_ws("_", F.col("img_group").cast("string"), F.col("expr_group").cast("string")))


def variance_table(df: DataFrame, factor: str, views: list[str]) -> DataFrame:
    """Long factor × view variances, the factor's mean over views and the view's total."""
    long = df.unpivot([factor], views, "view", "variance")
    out = with_group_stats(long, [factor], F.avg("variance").alias("factor_mean"))
    return with_group_stats(out, ["view"], F.sum("variance").alias("view_total"))


def profile_concat_impute(df: DataFrame, drug: str, line: str, component: str, value: str) -> DataFrame:
    """Complete (drug, line, component) grid; a missing line gets the drug's mean of the component."""
    mean = df.groupBy(drug, component).agg(F.avg(value).alias("_mean"))
    grid = key_grid(mean, df.select(line).distinct())
    return nsjoin(grid, df.select(drug, line, component, value), [drug, line, component], "left").select(
        drug, line, component, F.coalesce(F.col(value), F.col("_mean")).alias(value), F.col(value).isNull().alias("imputed"))


def profile_corr(df: DataFrame, drug: str, order: list[str], value: str) -> DataFrame:
    """Pairwise correlation of the drugs' concatenated profiles."""
    vec = df.groupBy(drug).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda s: s[value]).alias("_v"))
    return block_pairs(vec, [], drug, "_v", "corr").withColumnRenamed("value", "corr")


def target_median_rank(df: DataFrame, keys: list[str], target: str, drug: str, value: str, at_least: int = 5) -> DataFrame:
    """Median per target, largest first; targets with at least that many drugs."""
    many = df.select(target, drug).distinct().groupBy(target).agg(F.count(F.lit(1)).alias("n_drugs")).where(F.col("n_drugs") >= at_least)
    kept = df.join(many, target)
    med = group_median(kept, [*keys, target], value, "median")
    return nsjoin(med, many, [target]).orderBy(F.col("median").desc())


def phenoprint(df: DataFrame, labels: DataFrame, on: list[str], keys: list[str], features: list[str]) -> DataFrame:
    """Replicate medians of the key features per enriched label."""
    rows = df.join(labels, on).unpivot(keys, features, "feature", "value")
    return group_median(rows, [*keys, "feature"], "value", "median")


def image_embedding_pool(df: DataFrame, well: list[str], channel: str, vector: str, channels: list) -> DataFrame:
    """Mean embedding over fields per (well, channel), channels concatenated in order."""
    x = df.select(*well, channel, F.posexplode(vector).alias("_p", "_x"))
    cells = x.groupBy(*well, channel, "_p").agg(F.avg("_x").alias("_m"))
    place = F.coalesce(*[F.when(F.col(channel) == c, F.lit(i)) for i, c in enumerate(channels)])
    packed = cells.withColumn("_c", place).where("_c IS NOT NULL").groupBy(*well).agg(F.sort_array(F.collect_list(F.struct("_c", "_p", "_m"))).alias("_v"))
    return packed.select(*well, F.transform("_v", lambda s: s["_m"]).alias("embedding"))
