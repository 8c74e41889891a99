"""Dimension reduction, classifier, clustering and factor queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from platewise.functions.expr import off_tie, rnd
from platewise.operators import learn as L
from platewise.operators import mixtures as X
from platewise.operators import normalize as N
from platewise.plans.joins import PROFILE, profiles
from platewise.plans.normalise import EMB, embedding_long
from platewise.plans.ordering import UNIT
from platewise.plans.registry import FEATURES, LONG, OBJ, query
from platewise.plans.stats import r6
from platewise.session import cut_lineage

DIMS = [f"e{i}" for i in range(1, 65)]


def emb_wide(t):
    return t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMS)])


def _scores(df, ids, k):
    return df.select(*ids, *[rnd(F.col("pc")[i], 5).alias(f"pc{i + 1}") for i in range(k)])


@query("pca_fit_transform")
def pca_fit_transform(t):
    e = emb_wide(t)
    return _scores(L.pca_fit(e, DIMS, 5).transform(e), ["vec_id"], 5)


@query("pca_scaled")
def pca_scaled(t):
    o = N.global_scale(t.objects.select("uuid", "line", *FEATURES), FEATURES, ["line"])
    return _scores(L.pca_fit(o, FEATURES, 2, scale=False).transform(o), ["uuid"], 2)


@query("pca_control_only")
def pca_control_only(t):
    o = t.objects.select("uuid", "ctrl", *FEATURES).withColumn("d", F.abs(F.col("price") - 50000))
    fit, ctrl = L.pca_control_only(o, F.col("ctrl"), FEATURES, 2, "d")
    return _scores(fit.transform(ctrl), ["uuid"], 2)


@query("pca_samples")
def pca_samples(t):
    w = t.wells.groupBy("well", "conc").agg(F.avg("price").alias("price"))
    return r6(L.pca_samples(w, "well", "conc", "price", [round(i / 100, 2) for i in range(11)], 3), "score", digits=3).withColumn("share", rnd("share"))


@query("loading_annotate")
def loading_annotate(t):
    fit = L.pca_fit(emb_wide(t), DIMS, 3)
    dim = t.spark.createDataFrame([(d, "basic" if i % 2 else "shape") for i, d in enumerate(DIMS)], "feature string, class string")
    return r6(L.loading_annotate(fit.loadings(t.spark), dim, "feature"), "loading")


@query("effect_distance", f"""WITH {OBJ}, c AS (SELECT line, avg(quantity) AS a, avg(price) AS b, avg(tax) AS c FROM obj WHERE ctrl GROUP BY 1),
d AS (SELECT line, drug, count(*) AS n, avg(quantity) AS q, avg(price) AS p, avg(tax) AS x FROM obj WHERE NOT ctrl GROUP BY ALL)
SELECT line, drug, n, round(sqrt((q - a) ** 2 + (p - b) ** 2 + (x - c) ** 2), 4) AS distance FROM d JOIN c USING (line)""")
def effect_distance(t):
    return r6(L.effect_distance(t.objects, "line", "drug", F.col("ctrl"), FEATURES), "distance", digits=4)


def _scaled(t):
    return N.global_scale(t.objects.select("uuid", "line", "target", "rep", "ctrl", *FEATURES), FEATURES, ["line"])


@query("drug_vs_control_classifier")
def drug_vs_control_classifier(t):
    r = L.drug_vs_control_classifier(_scaled(t), ["line"], "target", F.col("ctrl"), ["uuid"], FEATURES)
    return r6(r, *[c for c in r.columns if c not in ("line", "target", "c")])


@query("drug_vs_control_by_rep")
def drug_vs_control_by_rep(t):
    r = L.drug_vs_control_classifier(_scaled(t), ["line", "rep"], "target", F.col("ctrl"), ["uuid"], FEATURES)
    return r6(r, *[c for c in r.columns if c not in ("line", "rep", "target", "c")])


@query("drug_classifier_optimum", f"""WITH {OBJ}, u AS (SELECT line, target, ctrl, floor({UNIT.format("uuid || '_clfm'")} * 10)::INTEGER AS own FROM obj WHERE {UNIT.format("uuid || '_clfhalf'")} >= 0.5),
f AS (SELECT unnest(range(10))::INTEGER AS fold), p AS (SELECT DISTINCT line, target FROM obj WHERE NOT ctrl),
a AS (SELECT line, target, fold, count(*) FILTER (own <> fold) AS n FROM u, f WHERE NOT ctrl GROUP BY ALL),
b AS (SELECT line, fold, count(*) FILTER (own <> fold) AS n FROM u, f WHERE ctrl GROUP BY ALL),
k AS (SELECT line, target, fold, coalesce(a.n, 0) AS n_case, coalesce(a.n, 0) + coalesce(b.n, 0) AS n_train FROM p CROSS JOIN f LEFT JOIN a USING (line, target, fold) LEFT JOIN b USING (line, fold))
SELECT line, target, fold, n_train, n_case, round(n_case / n_train + 0.00001234, 6) AS mean_p, 0.0::DOUBLE AS slope FROM k""")
def drug_classifier_optimum(t):
    r = L.drug_model_fits(_scaled(t), ["line"], "target", F.col("ctrl"), ["uuid"], FEATURES)
    return r.withColumn("mean_p", off_tie("mean_p", 6)).withColumn("slope", rnd("slope", 4))


@query("classifier_permutation_p")
def classifier_permutation_p(t):
    r = L.classifier_permutation_p(_scaled(t), ["line"], "target", F.col("ctrl"), ["uuid"], FEATURES, permutations=1000)
    return r6(r, "auc", "auc_std", "p_value")


@query("control_split_null")
def control_split_null(t):
    return r6(L.control_split_null(_scaled(t), "line", F.col("ctrl"), ["uuid"], FEATURES, splits=100), "auc_mean", "auc_std")


@query("auc_rank", """WITH s AS (SELECT lang, n_chars, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM labels JOIN documents USING (doc_id)),
g AS (SELECT lang, sum(quality)::BIGINT AS p, (count(*) - sum(quality))::BIGINT AS q, sum(r) FILTER (quality = 1) AS rs FROM s GROUP BY 1)
SELECT lang, p AS n_pos, q AS n_neg, round((rs - p * (p + 1) / 2) / CASE WHEN p * q > 0 THEN p * q END, 6) AS auc FROM g""")
def auc_rank(t):
    return r6(L.auc_rank(t.scored, ["lang"], "n_chars", F.col("quality") == 1), "auc")


@query("roc_curve", """WITH s AS (SELECT lang, n_chars, count(*) AS n, sum(quality) AS p FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
c AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY n_chars DESC) AS tp, sum(n - p) OVER (PARTITION BY lang ORDER BY n_chars DESC) AS fp, sum(p) OVER (PARTITION BY lang) AS pp, sum(n - p) OVER (PARTITION BY lang) AS nn FROM s)
SELECT lang, n_chars AS threshold, round(fp / CASE WHEN nn > 0 THEN nn END, 6) AS fpr, round(tp / CASE WHEN pp > 0 THEN pp END, 6) AS tpr FROM c""")
def roc_curve(t):
    return r6(L.roc_curve(t.scored, ["lang"], "n_chars", F.col("quality") == 1), "fpr", "tpr")


THRESHOLDS = [i / 10 for i in range(10)]


@query("threshold_accuracy", f"""WITH s AS (SELECT lang, quality = 1 AS y, least(n_chars / 2000, 1) AS p FROM labels JOIN documents USING (doc_id)),
a AS (SELECT lang, th AS threshold, avg((y = (p >= th))::INT) AS accuracy FROM s CROSS JOIN (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in THRESHOLDS)}]) AS th) GROUP BY ALL),
b AS (SELECT lang, threshold AS best FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY accuracy DESC, threshold) AS r FROM a) WHERE r = 1)
SELECT lang, threshold, round(accuracy, 6) AS accuracy, best AS best_threshold FROM a JOIN b USING (lang)""")
def threshold_accuracy(t):
    s = t.scored.withColumn("p", F.least(F.col("n_chars") / 2000, F.lit(1.0)))
    return r6(L.threshold_accuracy(s, ["lang"], "p", F.col("quality") == 1, THRESHOLDS), "accuracy")


def _regions(t):
    n = t.nation.select(F.col("n_nationkey").alias("line"), F.col("n_regionkey").alias("region"))
    o = t.objects.select("uuid", "plate", "well", "line", "conc", "ctrl", *FEATURES, (F.col("quantity") + F.col("tax") * 300).alias("signal")).join(n, "line")
    # the dead controls are those of high signal at the two top doses
    return cut_lineage(o.withColumn("dead_ctrl", ~F.col("ctrl") & (F.col("conc") >= 0.09) & (F.col("signal") > 40)))


def _live_dead(t, features=FEATURES):
    o = _regions(t)
    model, lab = L.live_dead_train(o, F.col("dead_ctrl"), F.col("ctrl"), ["uuid"], features)
    return o, model, lab


@query("live_dead_train")
def live_dead_train(t):
    _, model, lab = _live_dead(t)
    s = L.live_dead_score(model, lab)
    return s.groupBy("split", "dead").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg((F.col("prediction") == F.col("dead")).cast("double"))).alias("accuracy"))


@query("live_dead_score")
def live_dead_score(t):
    o, model, _ = _live_dead(t)
    return r6(L.live_dead_score(model, o).select("uuid", "prediction", "prob_live", "prob_dead"), "prob_live", "prob_dead")


@query("transfer_matrix")
def transfer_matrix(t):
    lab = L.live_dead_train(_regions(t), F.col("dead_ctrl"), F.col("ctrl"), ["uuid"], FEATURES)[1]
    r = L.transfer_matrix(lab.where("split = 'train'"), lab.where("split = 'test'"), "region", ["uuid"], FEATURES, "dead")
    return r6(r, "accuracy")


@query("feature_importances")
def feature_importances(t):
    _, model, _ = _live_dead(t)
    return r6(L.feature_importances(model, FEATURES, t.spark), "importance")


@query("channel_combo_sweep")
def channel_combo_sweep(t):
    _, _, lab = _live_dead(t)
    chans = {"a": ["quantity"], "b": ["price"], "c": ["tax"]}
    return r6(L.channel_combo_sweep(lab, chans, [("a",), ("b",), ("c",), ("a", "c"), ("a", "b", "c")], ["uuid"]), "accuracy")


@query("feature_importance_rank")
def feature_importance_rank(t):
    return r6(L.feature_importance_rank(emb_wide(t), DIMS, "label"), "pca", "lda", "rf", "max_corr")


@query("characteristic_rows")
def characteristic_rows(t):
    return r6(L.characteristic_rows(emb_wide(t), [], ["vec_id"], DIMS, n=10), "distance")


@query("characteristic_rows_batch")
def characteristic_rows_batch(t):
    return r6(L.characteristic_rows(t.objects, ["line", "drug"], ["uuid"], FEATURES, n=1), "distance")


@query("kmeans_gap")
def kmeans_gap(t):
    return r6(X.gap_statistic(emb_wide(t), DIMS), "log_w", "ref_log_w", "gap", "se")


PCS = [f"PC{i}" for i in range(1, 26)]


def _components(t):
    """The 25 leading components of the embeddings."""
    e = emb_wide(t)
    s = L.pca_fit(e, DIMS, 25, scale=False).transform(e)
    return cut_lineage(s.select("vec_id", *[F.col("pc")[i].alias(p) for i, p in enumerate(PCS)]))


@query("gmm_bic")
def gmm_bic(t):
    return r6(X.mixture_bic(_components(t), PCS, list(range(1, 16))), "log_lik", "bic", digits=4)


@query("gmm_predict")
def gmm_predict(t):
    from platewise.operators.sampling import sample_fraction

    e = _components(t)
    return X.mixture_predict(sample_fraction(e, ["vec_id"], 0.5), e, PCS, list(range(1, 16))).select("vec_id", "cluster", rnd("certainty").alias("certainty"))


@query("hierarchical_cut")
def hierarchical_cut(t):
    p = t.objects.withColumn("drug", F.when(F.col("ctrl"), "DMSO").otherwise(F.col("drug"))).groupBy("drug").agg(*[F.avg(f).alias(f) for f in FEATURES])
    return L.hierarchical_cut(N.global_scale(p, FEATURES), "drug", FEATURES, 4, "DMSO")


def _weights(t) -> np.ndarray:
    w = embedding_long(t).where("label IN (1, 2)").groupBy("label", "dim").agg(F.avg("value").alias("w")).toPandas()
    return w.pivot(index="dim", columns="label", values="w").sort_index().to_numpy(float)


PROJ = f"""{EMB}, w AS (SELECT dim, avg(value) FILTER (label = 1) AS a, avg(value) FILTER (label = 2) AS b FROM e GROUP BY 1),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM w), d AS (SELECT vec_id, sum(value * a) AS xa, sum(value * b) AS xb FROM e JOIN w USING (dim) GROUP BY 1),
z AS (SELECT vec_id, (bb * xa - ab * xb) / (aa * bb - ab * ab) AS f1, (aa * xb - ab * xa) / (aa * bb - ab * ab) AS f2 FROM d, g)"""


@query("factor_project", f"WITH {PROJ} SELECT vec_id, round(f1, 6) AS factor1, round(f2, 6) AS factor2 FROM z")
def factor_project(t):
    f = L.factor_project(t.embeddings, "embedding", _weights(t))
    return r6(f.select("vec_id", "factor1", "factor2"), "factor1", "factor2")


@query("factor_reconstruct", f"WITH {PROJ} SELECT vec_id, dim, round(f1 * a + f2 * b, 6) AS value FROM z CROSS JOIN w")
def factor_reconstruct(t):
    w = _weights(t)
    z = L.factor_reconstruct(L.factor_project(t.embeddings, "embedding", w), ["factor1", "factor2"], w)
    x = z.select("vec_id", F.posexplode("reconstructed").alias("p", "v"))
    return x.select("vec_id", (F.col("p") + 1).cast("long").alias("dim"), rnd("v").alias("value"))


@query("multi_view_table", f"""WITH {OBJ}
SELECT line || '_' || drug AS sample, 'size' AS feature, 'size_view' AS view, round(avg(ln(price)), 6) AS value FROM obj GROUP BY line, drug
UNION ALL SELECT line || '_' || drug, 'quantity', 'morphology_view', round(avg(quantity), 6) FROM obj GROUP BY line, drug
UNION ALL SELECT line || '_' || drug, 'tax', 'morphology_view', round(avg(tax), 6) FROM obj GROUP BY line, drug
UNION ALL SELECT line || '_' || drug, 'auc', 'drug_activity', round(avg(quantity) / 50, 6) FROM obj GROUP BY line, drug
UNION ALL SELECT DISTINCT line || '_' || drug, target, 'mutation', 1.0 FROM obj
UNION ALL SELECT line || '_' || drug, 'probe' || (part % 10), 'expression', round(avg(price) + 0.00001234, 4) FROM obj GROUP BY line, drug, part % 10""")
def multi_view_table(t):
    o = t.objects.withColumn("sample", F.concat_ws("_", "line", "drug"))
    one = lambda name, c: o.groupBy("sample").agg(rnd(c).alias("value")).withColumn("feature", F.lit(name))
    return L.multi_view_table({
        "size_view": one("size", F.avg(F.ln("price"))),
        "morphology_view": one("quantity", F.avg("quantity")).unionByName(one("tax", F.avg("tax"))),
        "drug_activity": one("auc", F.avg("quantity") / 50),
        "mutation": o.select("sample", F.col("target").alias("feature")).distinct().withColumn("value", F.lit(1.0)),
        "expression": o.groupBy("sample", F.concat(F.lit("probe"), F.col("part") % 10).alias("feature")).agg(off_tie(F.avg("price"), 4).alias("value"))})


@query("group_crosswalk", """WITH a AS (SELECT DISTINCT s_nationkey AS line, 'SCREEN-' || (s_suppkey % 12) AS screen FROM supplier), b AS (SELECT DISTINCT c_nationkey AS line, c_mktsegment AS batch FROM customer),
e AS (SELECT line, batch, dense_rank() OVER (ORDER BY batch) AS expr_group FROM b)
SELECT line, screen, split_part(screen, '-', 2)::BIGINT AS img_group, batch, expr_group, split_part(screen, '-', 2) || '_' || expr_group AS overall_group FROM a JOIN e USING (line)""")
def group_crosswalk(t):
    a = t.supplier.select(F.col("s_nationkey").alias("line"), F.concat(F.lit("SCREEN-"), F.col("s_suppkey") % 12).alias("screen"))
    b = t.customer.select(F.col("c_nationkey").alias("line"), F.col("c_mktsegment").alias("batch"))
    return L.group_crosswalk(a, b, "line", "screen", "batch")


@query("variance_table", f"""WITH {LONG}, v AS (SELECT line AS factor, feature AS view, var_samp(value) AS variance FROM long GROUP BY ALL)
SELECT factor, view, round(variance, 4) AS variance, round(avg(variance) OVER (PARTITION BY factor), 3) AS factor_mean, round(sum(variance) OVER (PARTITION BY view), 2) AS view_total FROM v""")
def variance_table(t):
    v = t.objects.groupBy(F.col("line").alias("factor")).agg(*[F.var_samp(f).alias(f) for f in FEATURES])
    r = L.variance_table(v, "factor", FEATURES)
    return r.select("factor", "view", rnd("variance", 4).alias("variance"), rnd("factor_mean", 3).alias("factor_mean"), rnd("view_total", 2).alias("view_total"))


SPARSE = f"""{OBJ}, p AS (SELECT line, drug || '_' || round(conc * 100)::INTEGER AS drug, target AS pc, avg(quantity) AS v FROM obj GROUP BY ALL),
m AS (SELECT drug, pc, avg(v) AS m FROM p GROUP BY ALL),
full_p AS (SELECT drug, line, pc, coalesce(v, m) AS v, v IS NULL AS imputed FROM (SELECT * FROM m CROSS JOIN (SELECT DISTINCT line FROM p)) LEFT JOIN p USING (drug, line, pc))"""


def _sparse(t):
    dosed = F.concat_ws("_", "drug", F.round(F.col("conc") * 100).cast("int").cast("string"))
    p = t.objects.groupBy("line", dosed.alias("drug"), F.col("target").alias("pc")).agg(F.avg("quantity").alias("v"))
    return L.profile_concat_impute(cut_lineage(p), "drug", "line", "pc", "v")


@query("profile_concat_impute", f"WITH {SPARSE} SELECT drug, line, pc, round(v, 6) AS v, imputed FROM full_p")
def profile_concat_impute(t):
    return r6(_sparse(t), "v")


@query("profile_corr", f"WITH {SPARSE} SELECT a.drug AS a, b.drug AS b, round(corr(a.v, b.v), 6) AS corr FROM full_p a JOIN full_p b ON a.line = b.line AND a.pc = b.pc AND a.drug < b.drug GROUP BY ALL")
def profile_corr(t):
    full = _sparse(t)
    return r6(L.profile_corr(full, "drug", ["line", "pc"], "v"), "corr")


@query("target_median_rank", """WITH w AS (SELECT l_linestatus AS factor, p_name AS target, l_partkey AS drug, avg(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
k AS (SELECT target, count(DISTINCT drug) AS n_drugs FROM w GROUP BY 1 HAVING count(DISTINCT drug) >= 30)
SELECT factor, target, n_drugs, round(median(v), 6) AS median FROM w JOIN k USING (target) GROUP BY ALL""")
def target_median_rank(t):
    w = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").groupBy(
        F.col("l_linestatus").alias("factor"), F.col("p_name").alias("target"), F.col("l_partkey").alias("drug")).agg(F.avg("l_quantity").alias("v"))
    r = L.target_median_rank(cut_lineage(w), ["factor"], "target", "drug", "v", 30)
    return r.select("factor", "target", "n_drugs", rnd("median").alias("median"))


@query("phenoprint", f"""WITH {LONG}, lb AS (SELECT p_brand AS drug, arg_max(p_type, (p_retailprice, p_partkey)) AS label FROM part GROUP BY ALL)
SELECT label, rep, feature, round(median(value), 6) AS median FROM long JOIN lb USING (drug) GROUP BY ALL""")
def phenoprint(t):
    lb = t.part.groupBy(F.col("p_brand").alias("drug")).agg(F.max_by("p_type", F.struct("p_retailprice", "p_partkey")).alias("label"))
    return r6(L.phenoprint(t.objects, lb, ["drug"], ["label", "rep"], FEATURES), "median")


@query("image_embedding_pool", """WITH e AS (SELECT vec_id // 20 AS well, label % 3 AS ch, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
m AS (SELECT well, ch, p, avg(v) AS m FROM e GROUP BY ALL), n AS (SELECT well, m, row_number() OVER (PARTITION BY well ORDER BY ch, p) AS pos FROM m)
SELECT well, pos, round(m, 6) AS v FROM n""")
def image_embedding_pool(t):
    e = t.embeddings.select(F.floor(F.col("vec_id") / 20).alias("well"), (F.col("label") % 3).alias("ch"), "embedding")
    x = L.image_embedding_pool(e, ["well"], "ch", "embedding", [0, 1, 2]).select("well", F.posexplode("embedding").alias("p", "v"))
    return x.select("well", (F.col("p") + 1).cast("long").alias("pos"), rnd("v").alias("v"))
