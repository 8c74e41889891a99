"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions.expr import rnd
from platewise.functions.special import chisq_pvalue, normal_pvalue
from platewise.operators import pairs as P
from platewise.operators import stats as T
from platewise.operators.order import bh_adjust
from platewise.plans.aggregates import AUC, aucs
from platewise.plans.joins import PROFILE, profiles
from platewise.plans.normalise import EMB, embedding_long
from platewise.plans.ordering import UNIT
from platewise.plans.registry import FEATURES, LONG, OBJ, query

DIMS = 16


def r6(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, rnd(c, digits))
    return df


@query("corr_pearson_grouped", f"WITH {OBJ} SELECT line, count(*) AS n, round(corr(quantity, price), 6) AS corr FROM obj GROUP BY 1")
def corr_pearson_grouped(t):
    return r6(T.corr_pearson_grouped(t.objects, ["line"], "quantity", "price"), "corr")


@query("corr_spearman", """
WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS a,
 rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS b FROM events)
SELECT event_type, count(*) AS n, round(corr(a, b), 6) AS corr FROM r GROUP BY 1""")
def corr_spearman(t):
    return r6(T.corr_spearman(t.events, ["event_type"], "value", "user_id"), "corr")


@query("replicate_feature_corr", f"""WITH {LONG}, w AS (SELECT line, feature, plate, well, avg(value) FILTER (rep = 'F') AS a, avg(value) FILTER (rep = 'O') AS b FROM long GROUP BY ALL)
SELECT line, feature, count(*) AS n, round(corr(a, b), 6) AS corr FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""")
def replicate_feature_corr(t):
    x = t.objects.unpivot(["line", "plate", "well", "rep"], FEATURES, "feature", "value")
    return r6(T.replicate_feature_corr(x, ["line", "feature"], ["plate", "well"], "rep", ("F", "O"), "value"), "corr")


CORR_SQL = f"{EMB}, cm AS (SELECT a.dim::INT AS i, b.dim::INT AS j, corr(a.value, b.value) AS corr FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY ALL)"


@query("corr_matrix", f"WITH {CORR_SQL} SELECT i, j, round(corr, 6) AS corr FROM cm")
def corr_matrix(t):
    return r6(P.corr_matrix(t.embeddings, [], "embedding"), "corr")


@query("greedy_decorrelate")
def greedy_decorrelate(t):
    names = [f"d{i + 1}" for i in range(64)]
    corr = P.corr_matrix(t.embeddings, [], "embedding").toPandas()
    chosen = T.greedy_decorrelate(corr, names, ["d1", "d2"], 0.25)
    return t.spark.createDataFrame([(i + 1, f, round(s, 6)) for i, (f, s) in enumerate(chosen)], "step int, feature string, max_corr double")


ANGLE = """acos(greatest(-1, least(1, (a.quantity * b.quantity + a.price * b.price + a.tax * b.tax)
 / (sqrt(a.quantity ** 2 + a.price ** 2 + a.tax ** 2) * sqrt(b.quantity ** 2 + b.price ** 2 + b.tax ** 2))))) * 180 / pi()"""
CENTRED = f"""{PROFILE}, cprof AS (SELECT line, drug, quantity - avg(quantity) OVER (PARTITION BY line) AS quantity, price - avg(price) OVER (PARTITION BY line) AS price, tax - avg(tax) OVER (PARTITION BY line) AS tax FROM prof)"""


def _vectors(t):
    from platewise.functions.expr import with_group_stats

    p = with_group_stats(profiles(t), ["line"], *[F.avg(f).alias(f"m_{f}") for f in FEATURES])
    return p.select("line", "drug", F.array(*[F.col(f) - F.col(f"m_{f}") for f in FEATURES]).alias("profile"))


@query("angle_matrix", f"WITH {CENTRED} SELECT line, a.drug AS a, b.drug AS b, round({ANGLE}, 4) AS angle FROM cprof a JOIN cprof b USING (line) WHERE a.drug < b.drug")
def angle_matrix(t):
    return r6(P.angle_matrix(_vectors(t), ["line"], "drug", "profile"), "angle", digits=4)


@query("join_self_pairs", "SELECT label, a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 for x in list_zip(a.embedding, b.embedding)])), 5) AS distance FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id < b.vec_id")
def join_self_pairs(t):
    return r6(P.distance_matrix(t.embeddings, ["label"], "vec_id", "embedding"), "distance", digits=5)


@query("angle_graph", f"""WITH {CENTRED}, e AS (SELECT line, a.drug AS source, b.drug AS target, {ANGLE} AS val FROM cprof a JOIN cprof b USING (line) WHERE a.drug < b.drug)
SELECT line, source, target, round(val, 4) AS val FROM e WHERE val <= 45""")
def angle_graph(t):
    return r6(P.angle_graph(_vectors(t), ["line"], "drug", "profile"), "val", digits=4)


@query("angle_graph_nodes", f"""WITH {CENTRED}, e AS (SELECT line, a.drug AS source, b.drug AS target FROM cprof a JOIN cprof b USING (line) WHERE a.drug < b.drug AND {ANGLE} <= 45)
SELECT line, node, count(*) AS degree FROM (SELECT line, source AS node FROM e UNION ALL SELECT line, target FROM e) GROUP BY ALL""")
def angle_graph_nodes(t):
    return P.graph_nodes(P.angle_graph(_vectors(t), ["line"], "drug", "profile"), ["line"])


@query("distance_matrix", f"WITH {PROFILE} SELECT line, a.drug AS a, b.drug AS b, round(sqrt((a.quantity - b.quantity) ** 2 + (a.price - b.price) ** 2 + (a.tax - b.tax) ** 2), 5) AS distance FROM prof a JOIN prof b USING (line) WHERE a.drug < b.drug")
def distance_matrix(t):
    v = profiles(t).select("line", "drug", F.array(*FEATURES).alias("profile"))
    return r6(P.distance_matrix(v, ["line"], "drug", "profile"), "distance", digits=5)


@query("corr_distance", f"WITH {CORR_SQL} SELECT i, j, round((1 - corr) / 2, 6) AS distance FROM cm WHERE i < j")
def corr_distance(t):
    c = P.corr_matrix(t.embeddings, [], "embedding").where("i < j")
    return c.select("i", "j", rnd(T.corr_distance("corr")).alias("distance"))


ENRICH = f"""{OBJ}, it AS (SELECT DISTINCT line, part AS item, conc AS cluster FROM obj),
tg AS (SELECT DISTINCT line, item, cluster, target AS label FROM it JOIN (SELECT DISTINCT part AS item, target FROM obj) USING (item)),
cs AS (SELECT line, cluster, count(*) AS cluster_size FROM it GROUP BY ALL), tot AS (SELECT line, count(DISTINCT item) AS n FROM it GROUP BY 1),
ls AS (SELECT line, label, count(*) AS label_size FROM tg GROUP BY ALL), hit AS (SELECT line, cluster, label, count(*) AS a FROM tg GROUP BY ALL),
x AS (SELECT line, cluster, label, cluster_size, label_size, n, coalesce(h.a, 0) AS a, cluster_size - coalesce(h.a, 0) AS b, label_size - coalesce(h.a, 0) AS c, n - cluster_size - label_size + coalesce(h.a, 0) AS d
 FROM cs JOIN ls USING (line) JOIN tot USING (line) LEFT JOIN hit h USING (line, cluster, label) WHERE cluster_size >= 3),
fp AS (SELECT *, list_sum([exp(lgamma(cluster_size + 1) + lgamma(n - cluster_size + 1) + lgamma(label_size + 1) + lgamma(n - label_size + 1) - lgamma(n + 1)
 - lgamma(k + 1) - lgamma(cluster_size - k + 1) - lgamma(label_size - k + 1) - lgamma(n - cluster_size - label_size + k + 1)) for k in range(a, least(cluster_size, label_size) + 1)]) AS p FROM x)"""


def _enriched(t):
    o = t.objects.select("line", F.col("part").alias("item"), F.col("conc").alias("cluster"), F.col("target").alias("label"))
    return T.cluster_label_enrichment(o, ["line"], "item", "cluster", "label", min_cluster=3)


@query("cluster_label_enrichment", f"""WITH {ENRICH}, bh AS (SELECT *, min(least(1, p * m / r)) OVER (PARTITION BY line ORDER BY p DESC) AS padj
 FROM (SELECT *, count(*) OVER (PARTITION BY line) AS m, count(*) OVER (PARTITION BY line ORDER BY p) AS r FROM fp))
SELECT line, cluster, label, a, round(CASE WHEN b = 0 OR c = 0 THEN 'Infinity'::DOUBLE ELSE a * d / (b * c)::DOUBLE END, 6) AS odds_ratio, round(least(p, 1), 7) AS p_value, round(least(padj, 1), 6) AS p_adj FROM bh""")
def cluster_label_enrichment(t):
    e = _enriched(t)
    return e.select("line", "cluster", "label", "a", rnd("odds_ratio").alias("odds_ratio"), rnd("p_value", 7).alias("p_value"), rnd("p_adj").alias("p_adj"))


LABELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("log_odds_matrix", f"""WITH {ENRICH}, o AS (SELECT line, label, max(CASE WHEN b = 0 OR c = 0 THEN 'Infinity'::DOUBLE ELSE a * d / (b * c)::DOUBLE END) AS o FROM x GROUP BY ALL),
v AS (SELECT line, label, CASE WHEN o = 'Infinity' THEN (SELECT max(o) FROM o WHERE o < 'Infinity') ELSE o END AS o FROM o)
SELECT line, {', '.join(f"round(coalesce(max(CASE WHEN o <> 0 THEN log2(o) ELSE 0 END) FILTER (label = '{k}'), 0), 6) AS {k}" for k in LABELS)} FROM v GROUP BY line""")
def log_odds_matrix(t):
    m = T.log_odds_matrix(_enriched(t), "line", "label", "odds_ratio")
    return r6(m.select("line", *LABELS), *LABELS)


CHI = f"""{OBJ}, c AS (SELECT drug, conc, count(*) AS n FROM obj GROUP BY ALL), r AS (SELECT drug, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT conc, sum(n) AS k FROM c GROUP BY 1),
g AS (SELECT drug, conc, coalesce(n, 0) AS n, r * k / (SELECT sum(n) FROM c)::DOUBLE AS e FROM (SELECT * FROM r CROSS JOIN k) LEFT JOIN c USING (drug, conc))"""


@query("contingency_chisq", f"WITH {CHI} SELECT drug, conc, n, round((n - e) / sqrt(e), 6) AS residual, round((SELECT sum((n - e) ** 2 / e) FROM g), 5) AS chisq FROM g")
def contingency_chisq(t):
    c = T.contingency_chisq(t.objects, "drug", "conc")
    return c.withColumn("residual", rnd("residual")).withColumn("chisq", rnd("chisq", 5))


@query("contingency_chisq_p", f"""WITH {CHI}, one AS (SELECT sum((n - e) ** 2 / e) AS chisq, (count(DISTINCT drug) - 1) * (count(DISTINCT conc) - 1) AS df FROM g)
SELECT round(chisq, 5) AS chisq, df, round(list_sum([exp(k * ln(chisq / 2) - chisq / 2 - lgamma(k + 1)) for k in range(df // 2)]), 8) AS p_value FROM one""")  # a finite sum: df is even
def contingency_chisq_p(t):
    c = T.contingency_chisq(t.objects, "drug", "conc")
    one = c.agg(F.first("chisq").alias("chisq"), ((F.count_distinct("drug") - 1) * (F.count_distinct("conc") - 1)).alias("df"))
    return one.select(rnd("chisq", 5).alias("chisq"), "df", rnd(chisq_pvalue("chisq", "df"), 8).alias("p_value"))


@query("contingency_mc_test")
def contingency_mc_test(t):
    return T.contingency_mc_test(t.objects.where("NOT ctrl"), "target", "conc")


@query("multinom_aic", f"""WITH {OBJ}, m AS (SELECT 'intercept' AS model, '' AS level, rep AS y FROM obj UNION ALL SELECT 'line', line::VARCHAR, rep FROM obj UNION ALL SELECT 'plate', plate::VARCHAR, rep FROM obj UNION ALL SELECT 'target', target, rep FROM obj),
c AS (SELECT model, level, y, count(*) AS n FROM m GROUP BY ALL), g AS (SELECT *, sum(n) OVER (PARTITION BY model, level) AS g FROM c),
l AS (SELECT model, sum(n * ln(n / g)) AS ll, ((SELECT count(DISTINCT y) FROM m) - 1) * count(DISTINCT level) AS k FROM g GROUP BY 1)
SELECT model, k AS df, round(ll, 4) AS log_lik, round(2 * k - 2 * ll, 4) AS aic FROM l""")
def multinom_aic(t):
    return r6(T.multinom_aic(t.objects, "rep", ["line", "plate", "target"]), "log_lik", "aic", digits=4)


MUT = f"{AUC}, la AS (SELECT drug, line, avg(auc) AS auc FROM auc GROUP BY ALL), mut AS (SELECT c_nationkey AS line, c_mktsegment AS genotype FROM customer GROUP BY ALL HAVING avg(c_acctbal) > 4600)"


def _line_auc(t):
    return aucs(t).groupBy("drug", "line").agg(F.avg("auc").alias("auc"))


def _mutations(t):
    return t.customer.groupBy(F.col("c_nationkey").alias("line"), F.col("c_mktsegment").alias("genotype")).agg(F.avg("c_acctbal").alias("m")).where("m > 4600").select("line", "genotype")


WELCH = f"""{MUT}, s AS (SELECT genotype, drug, count(*) FILTER (NOT pos) AS n0, count(*) FILTER (pos) AS n1, avg(auc) FILTER (NOT pos) AS mean0, avg(auc) FILTER (pos) AS mean1,
 var_samp(auc) FILTER (NOT pos) / count(*) FILTER (NOT pos) AS a, var_samp(auc) FILTER (pos) / count(*) FILTER (pos) AS b
 FROM (SELECT g.genotype, la.*, m.genotype IS NOT NULL AS pos FROM la CROSS JOIN (SELECT DISTINCT genotype FROM mut) g LEFT JOIN mut m ON m.line = la.line AND m.genotype = g.genotype) GROUP BY ALL)"""


def _status_rows(t):
    from platewise.operators.joins import complete_grid

    mut = _mutations(t).withColumn("pos", F.lit(1))
    lines = t.supplier.select(F.col("s_nationkey").alias("line")).distinct()
    grid = complete_grid(mut.unionByName(lines.select("line", F.lit(None).cast("string").alias("genotype"), F.lit(0).alias("pos"))), ["line"], ["genotype"], "pos", 0)
    return _line_auc(t).join(grid.where("genotype IS NOT NULL"), "line")


@query("ttest_welch", f"""WITH {WELCH} SELECT genotype, drug, n0, n1, round(mean0, 6) AS mean0, round(mean1, 6) AS mean1, round((mean0 - mean1) / sqrt(a + b), 5) AS t,
round((a + b) ** 2 / (a * a / (n0 - 1) + b * b / (n1 - 1)), 4) AS df FROM s WHERE n0 > 1 AND n1 > 1""")
def ttest_welch(t):
    w = T.ttest_welch(_status_rows(t), ["genotype", "drug"], F.col("pos") == 1, "auc", with_p=False)
    return w.select("genotype", "drug", "n0", "n1", rnd("mean0").alias("mean0"), rnd("mean1").alias("mean1"), rnd("t", 5).alias("t"), rnd("df", 4).alias("df"))


def beta_series(x: str, a: str, b: str) -> str:
    """Incomplete beta ratio I_x(a, b) by its series of positive terms, for x up to a half."""
    return (f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}))"
            f" * list_sum([exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1 + k) + lgamma({a} + 1) + k * ln({x})) for k in range(200)])")


T_P = f"CASE WHEN t = 0 THEN 1 WHEN t * t < df THEN 1 - {beta_series('(t * t / (df + t * t))', '0.5', '(df / 2)')} ELSE {beta_series('(df / (df + t * t))', '(df / 2)', '0.5')} END"


@query("ttest_welch_pvalues", f"""WITH {WELCH}, w AS (SELECT genotype, drug, (mean0 - mean1) / sqrt(a + b) AS t, (a + b) ** 2 / (a * a / (n0 - 1) + b * b / (n1 - 1)) AS df FROM s WHERE n0 > 1 AND n1 > 1)
SELECT genotype, drug, round(t, 5) AS t, round(df, 4) AS df, round({T_P}, 8) AS p_value FROM w""")
def ttest_welch_pvalues(t):
    w = T.ttest_welch(_status_rows(t), ["genotype", "drug"], F.col("pos") == 1, "auc")
    return w.select("genotype", "drug", rnd("t", 5).alias("t"), rnd("df", 4).alias("df"), rnd("p_value", 8).alias("p_value"))


PERMS = 9999


# the hash of (unit, permutation), step by step modulo 2**64
WRAP = "((({a})::UHUGEINT * {b}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
HASHED = f"""h0 AS (SELECT line, perm, (({WRAP.format(a="('0x' || substr(md5(line || '_perm'), 1, 13))::BIGINT", b=0x9E3779B97F4A7C15)} + {WRAP.format(a="perm", b=0xC2B2AE3D27D4EB4F)}) % 18446744073709551616::UHUGEINT)::UBIGINT AS h
 FROM (SELECT DISTINCT line FROM la) CROSS JOIN (SELECT unnest(range(1, {PERMS + 1})) AS perm)),
h1 AS (SELECT line, perm, {WRAP.format(a="xor(h, h >> 32)", b=0xD6E8FEB86659FD93)}::UBIGINT AS h FROM h0), h2 AS (SELECT line, perm, {WRAP.format(a="xor(h, h >> 32)", b=0xD6E8FEB86659FD93)}::UBIGINT AS h FROM h1),
hs AS MATERIALIZED (SELECT line, perm, xor(h, h >> 32) >> 1 AS h FROM h2)"""


@query("permutation_test", f"""WITH {MUT}, {HASHED}, n AS (SELECT drug, count(*) AS n, sum(auc) AS t, var_samp(auc) AS variance FROM la GROUP BY 1),
ob AS (SELECT drug, genotype, count(*) AS n1, sum(auc) AS s1 FROM la JOIN mut USING (line) GROUP BY ALL),
o AS (SELECT * FROM ob JOIN n USING (drug) WHERE n1 < n),
sh AS (SELECT drug, perm, auc, row_number() OVER (PARTITION BY drug, perm ORDER BY h) AS k FROM la JOIN hs USING (line)),
pr AS (SELECT drug, perm, k AS n1, sum(auc) OVER (PARTITION BY drug, perm ORDER BY k) AS p FROM sh),
d AS (SELECT drug, genotype, variance, s1 / n1 - (t - s1) / (n - n1) AS obs, p / n1 - (t - p) / (n - n1) AS sim FROM pr JOIN o USING (drug, n1)),
pv AS (SELECT drug, genotype, any_value(obs) AS estimate, any_value(variance) AS variance, (count_if(abs(sim) >= abs(obs) - 1e-9) + 1) / (count(*) + 1) AS p FROM d GROUP BY ALL),
raw AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM pv)
SELECT drug, genotype, round(estimate, 6) AS estimate, round(variance, 6) AS variance, round(p, 6) AS p_value, round(least(1, min(raw) OVER (ORDER BY p DESC)), 6) AS p_adj FROM raw""")
def permutation_test(t):
    p = T.permutation_test(_line_auc(t), "drug", "line", "auc", _mutations(t), "genotype", PERMS)
    return r6(p, "estimate", "variance", "p_value", "p_adj")


WILCOXON = f"""{OBJ}, r AS (SELECT line, ctrl, price, rank() OVER (PARTITION BY line ORDER BY price) + (count(*) OVER (PARTITION BY line, price) - 1) / 2 AS rk FROM obj),
tie AS (SELECT line, sum(n ** 3 - n) AS ties FROM (SELECT line, price, count(*) AS n FROM obj GROUP BY ALL) GROUP BY 1),
s AS (SELECT line, count_if(ctrl)::BIGINT AS n1, count_if(NOT ctrl)::BIGINT AS n0, sum(rk) FILTER (ctrl) AS rs FROM r GROUP BY 1),
w AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS w, sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sigma FROM s JOIN tie USING (line))"""


@query("wilcoxon_rank_sum", f"""WITH {WILCOXON}
SELECT line, n1, n0, w, round((w - n1 * n0 / 2 - sign(w - n1 * n0 / 2) * 0.5) / sigma, 6) AS z FROM w""")
def wilcoxon_rank_sum(t):
    return r6(T.wilcoxon_rank_sum(t.objects, ["line"], F.col("ctrl"), "price"), "z")


# erf as its series of positive terms; beyond 6 it is 1 to all digits
ERF = "2 / sqrt(pi()) * exp(-x * x) * list_sum([exp(k * ln(2) + (2 * k + 1) * ln(x) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))) for k in range(160)])"


@query("wilcoxon_pvalues", f"""WITH {WILCOXON}, z AS (SELECT line, n1, n0, w, (w - n1 * n0 / 2 - sign(w - n1 * n0 / 2) * 0.5) / sigma AS z FROM w),
p AS (SELECT *, CASE WHEN x = 0 THEN 1 ELSE greatest(0, 1 - {ERF}) END AS p FROM (SELECT *, least(abs(z) / sqrt(2), 6) AS x FROM z)),
rr AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM p)
SELECT line, n1, n0, w, round(z, 6) AS z, round(p, 6) AS p_value, round(least(1, min(raw) OVER (ORDER BY p DESC)), 6) AS p_adj FROM rr""")
def wilcoxon_pvalues(t):
    w = T.wilcoxon_rank_sum(t.objects, ["line"], F.col("ctrl"), "price").withColumn("p_value", normal_pvalue("z"))
    from platewise.session import cut_lineage

    return r6(bh_adjust(cut_lineage(w), [], "p_value", "p_adj"), "z", "p_value", "p_adj")


@query("bh_adjust", """WITH p AS (SELECT event_id, event_type, least(1, value / 500) AS p FROM events),
r AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / count(*) OVER (PARTITION BY event_type ORDER BY p) AS raw FROM p)
SELECT event_id, round(p, 6) AS p, round(least(1, min(raw) OVER (PARTITION BY event_type ORDER BY p DESC)), 6) AS padj FROM r""")
def bh(t):
    p = t.events.select("event_id", "event_type", F.least(F.lit(1.0), F.col("value") / 500).alias("p"))
    return r6(bh_adjust(p, ["event_type"], "p", "padj").select("event_id", "p", "padj"), "p", "padj")


@query("ols_factor", f"""WITH {LONG}, l AS (SELECT long.*, part.p_type AS target FROM long JOIN part ON p_partkey = split_part(uuid, '_', 3)::BIGINT),
g AS (SELECT feature, target, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l GROUP BY ALL),
f AS (SELECT feature, sum(n * v) / (sum(n) - count(*)) AS s2, sum(n) - count(*) AS df, max(m) FILTER (target = 'ECONOMY') AS m0, max(n) FILTER (target = 'ECONOMY') AS n0 FROM g GROUP BY 1),
o AS (SELECT feature, CASE WHEN target = 'ECONOMY' THEN '(Intercept)' ELSE 'target' || target END AS term, CASE WHEN target = 'ECONOMY' THEN m ELSE m - m0 END AS est,
 sqrt(s2 * CASE WHEN target = 'ECONOMY' THEN 1 / n0 ELSE 1 / n + 1 / n0 END) AS se, df FROM g JOIN f USING (feature))
SELECT feature, term, round(est, 4) AS estimate, round(se, 4) AS std_error, round(est / se, 5) AS statistic, df::BIGINT AS df FROM o""")
def ols_factor(t):
    x = t.objects.unpivot(["target"], FEATURES, "feature", "value")
    return r6(r6(T.ols_factor(x, ["feature"], "value", "target", "ECONOMY"), "estimate", "std_error", digits=4), "statistic", digits=5)


@query("ols_two_factor")
def ols_two_factor(t):
    x = t.objects.unpivot(["target", "line"], FEATURES, "feature", "value")
    kinds = [r[0] for r in t.part.select("p_type").distinct().orderBy("p_type").collect()]
    m = T.ols_terms(x, ["feature"], "value", {"target": kinds, "line": list(range(25))})
    return r6(r6(m, "estimate", "std_error", digits=4), "statistic", digits=5)


LM = f"""{EMB}, d AS (SELECT vec_id, dim, value, label::DOUBLE AS x1, (vec_id % 7)::DOUBLE AS x2 FROM e),
m AS (SELECT *, value - avg(value) OVER (PARTITION BY dim) AS y, x1 - avg(x1) OVER (PARTITION BY dim) AS a, x2 - avg(x2) OVER (PARTITION BY dim) AS b FROM d),
s AS (SELECT dim, count(*) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS wy, sum(y * y) AS yy FROM m GROUP BY 1),
c AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * wy) / (aa * bb - ab * ab) AS b1, (aa * wy - ab * ay) / (aa * bb - ab * ab) AS b2 FROM s),
lm AS (SELECT dim, b1, b2, (yy - b1 * ay - b2 * wy) / (n - 3) AS s2, bb / det AS u1, aa / det AS u2, n - 3 AS df FROM c)"""


def _lm(t):
    e = embedding_long(t)
    design = t.embeddings.select("vec_id", F.lit(1.0).alias("one"), F.col("label").alias("x1"), (F.col("vec_id") % 7).alias("x2"))
    return T.linear_model_rows(e, design, "dim", "vec_id", "value", ["one", "x1", "x2"])


@query("linear_model_rows", f"""WITH {LM} SELECT dim, 'x1' AS term, df, round(b1, 6) AS estimate, round(sqrt(s2 * u1), 6) AS std_error, round(b1 / sqrt(s2 * u1), 4) AS statistic FROM lm
UNION ALL SELECT dim, 'x2', df, round(b2, 6), round(sqrt(s2 * u2), 6), round(b2 / sqrt(s2 * u2), 4) FROM lm""")
def linear_model_rows(t):
    m = _lm(t).where("term <> 'one'").select("dim", "term", "df", "estimate", "std_error", "statistic")
    return r6(r6(m, "estimate", "std_error"), "statistic", digits=4)


@query("contrast_test", f"""WITH {EMB}, g AS (SELECT dim, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM e GROUP BY ALL),
f AS (SELECT dim, sum(n * v) / (sum(n) - count(*)) AS s2, sum(n) - count(*) AS df FROM g GROUP BY 1),
c AS (SELECT * FROM (VALUES ('one_vs_two', 1, 1.0), ('one_vs_two', 2, -1.0), ('three_vs_rest', 3, 1.0), ('three_vs_rest', 4, -0.5), ('three_vs_rest', 5, -0.5)) v(contrast, label, w)),
q AS (SELECT dim, contrast, sum(w * m) AS est, sum(w * w / n) AS u FROM g JOIN c USING (label) GROUP BY ALL)
SELECT dim, contrast, round(est, 6) AS estimate, round(u, 6) AS unscaled, df::BIGINT AS df, round(s2, 6) AS sigma2, round(sqrt(s2 * u), 6) AS std_error, round(est / sqrt(s2 * u), 4) AS statistic FROM q JOIN f USING (dim)""")
def contrast_test(t):
    c = T.contrast_test(embedding_long(t), "dim", "label", "value", {"one_vs_two": {1: 1, 2: -1}, "three_vs_rest": {3: 1, 4: -0.5, 5: -0.5}})
    return r6(r6(c, "estimate", "unscaled", "sigma2", "std_error"), "statistic", digits=4)


@query("moderated_t")
def moderated_t(t):
    m = T.moderated_t(_lm(t).where("term <> 'one'"), "dim", ["term"])
    return r6(m.select("dim", "term", "t", "df_total", "p_value", "p_adj", "d0", "s0_2"), "t", "df_total", "p_value", "p_adj", "d0", "s0_2")


@query("lasso_per_drug")
def lasso_per_drug(t):
    e = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i + 1}") for i in range(DIMS)], F.col("embedding")[DIMS].cast("double").alias("y"))
    m = T.lasso_per_key(e, ["label"], ["vec_id"], [f"x{i + 1}" for i in range(DIMS)], "y", folds=5, lambdas=30)
    return r6(m.where("coef > 0 AND term <> '(Intercept)'"), "coef", "lam")


@query("corr_edges", f"""WITH {CORR_SQL}, s AS (SELECT i, j, corr FROM cm WHERE i <> j AND corr > 0.1)
SELECT i::VARCHAR AS source, j::VARCHAR AS target, round(corr, 6) AS val, 'gene_cor' AS edge_type FROM s UNION ALL SELECT j::VARCHAR, i::VARCHAR, round(corr, 6), 'gene_cor' FROM s
UNION ALL SELECT p_brand, p_type, round(avg(p_size), 6), 'drug_assoc' FROM part GROUP BY p_brand, p_type""")
def corr_edges(t):
    drugs = t.part.groupBy(F.col("p_brand").alias("source"), F.col("p_type").alias("target")).agg(F.avg("p_size").alias("val"))
    return r6(T.corr_edges(P.corr_matrix(t.embeddings, [], "embedding"), 0.1, drugs), "val")


GSEA = """rk AS (SELECT l_partkey AS gene, avg(l_extendedprice) - 52000 AS score FROM lineitem GROUP BY 1), st AS (SELECT DISTINCT p_partkey AS gene, p_brand AS gs FROM part),
pos AS (SELECT gene, score, row_number() OVER (ORDER BY score DESC, md5(gene || '_')) AS pos, count(*) OVER () AS n FROM rk)"""


def es_sql(hits: str, keys: str) -> str:
    """Enrichment score by SQL from (keys, gs, pos, n, w)."""
    return f"""r AS (SELECT {keys}, pos, n, w, sum(w) OVER (PARTITION BY {keys} ORDER BY pos) AS aw, sum(w) OVER (PARTITION BY {keys}) AS tw, row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY {keys}) AS m FROM {hits}),
cv AS (SELECT {keys}, pos, m, aw / tw - (pos - 1 - k) / (n - m) AS up, (aw - w) / tw - (pos - 1 - k) / (n - m) AS down FROM r),
es AS (SELECT {keys}, max(m) AS size, CASE WHEN max(up) >= -min(down) THEN max(up) ELSE min(down) END AS es, CASE WHEN max(up) >= -min(down) THEN arg_max(pos, up) ELSE arg_min(pos, down) END AS edge_rank FROM cv GROUP BY ALL)"""


def _ranked(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("gene")).agg((F.avg("l_extendedprice") - 52000).alias("score"))


def _sets(t):
    return t.part.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("gs"))


@query("gsea_running_sum", f"WITH {GSEA}, h AS (SELECT gs, pos, n, abs(score) AS w FROM pos JOIN st USING (gene)), {es_sql('h', 'gs')} SELECT gs, size, round(es, 6) AS es, edge_rank FROM es")
def gsea_running_sum(t):
    return r6(T.gsea_running_sum(_ranked(t), _sets(t), [], "gene", "score", "gs"), "es")


GPERM = 100_000


@query("gsea_permutation")
def gsea_permutation(t):
    return r6(T.gsea_permutation(_ranked(t), _sets(t), "gene", "score", "gs", GPERM), "es", "nes", "p_value", "p_adj")


@query("gene_set_matrix", """SELECT p_name AS gene, """ + ", ".join(f"max((p_type = '{k}')::INT) AS {k}" for k in ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")) + " FROM part GROUP BY 1")
def gene_set_matrix(t):
    return T.gene_set_matrix(t.part.select(F.col("p_name").alias("gene"), F.col("p_type").alias("s")), "s", "gene", ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"])


LOAD = """ld AS (SELECT l_linestatus AS factor, l_partkey AS gene, avg(l_extendedprice) / 52000 - 1 AS w FROM lineitem GROUP BY ALL)"""


def _loadings(t):
    return t.lineitem.groupBy(F.col("l_linestatus").alias("factor"), F.col("l_partkey").alias("gene")).agg((F.avg("l_extendedprice") / 52000 - 1).alias("w"))


@query("factor_set_enrichment", f"""WITH {LOAD}, x AS (SELECT factor, gene, 'all' AS sign, abs(w) AS x FROM ld UNION ALL SELECT factor, gene, 'negative', greatest(-w, 0) FROM ld UNION ALL SELECT factor, gene, 'positive', greatest(w, 0) FROM ld),
t AS (SELECT factor, sign, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL), i AS (SELECT factor, sign, p_brand AS gs, count(*) AS n1, sum(x) AS s1, sum(x * x) AS q1 FROM x JOIN part ON gene = p_partkey GROUP BY ALL),
m AS (SELECT *, n - n1 AS n0, s1 / n1 AS m1, (s - s1) / (n - n1) AS m0 FROM i JOIN t USING (factor, sign))
SELECT factor, sign, gs, n1 AS size, round(m1 - m0, 6) AS difference, round((m1 - m0) / sqrt((q1 - n1 * m1 * m1 + (q - q1) - n0 * m0 * m0) / (n - 2) * (1 / n1 + 1 / n0)), 5) AS t, n - 2 AS df FROM m""")
def factor_set_enrichment(t):
    return r6(r6(T.factor_set_enrichment(_loadings(t), _sets(t), "factor", "gene", "w", "gs"), "difference"), "t", digits=5)


@query("factor_set_permutation")
def factor_set_permutation(t):
    return r6(T.factor_set_permutation(_loadings(t), _sets(t), "factor", "gene", "w", "gs", GPERM), "mean_weight", "p_value", "p_adj")


@query("leading_edge_compare", f"""WITH {LOAD} SELECT p_brand AS gs, count(*) AS n, round(corr(a.w, b.w), 6) AS corr FROM ld a JOIN ld b USING (gene) JOIN part ON gene = p_partkey WHERE a.factor = 'F' AND b.factor = 'O' GROUP BY 1""")
def leading_edge_compare(t):
    ld = _loadings(t)
    return r6(T.leading_edge_compare(ld.where("factor = 'F'"), ld.where("factor = 'O'"), _sets(t), "gene", "w", ["gs"]), "corr")


@query("lnorm_fit", f"WITH {OBJ} SELECT line, count(*) AS n, round(avg(ln(price)), 6) AS meanlog, round(stddev_pop(ln(price)), 6) AS sdlog FROM obj GROUP BY 1")
def lnorm_fit(t):
    return r6(T.lnorm_fit(t.objects, ["line"], "price"), "meanlog", "sdlog")


@query("weibull_fit")
def weibull_fit(t):
    return r6(T.weibull_fit(t.objects, ["line"], "quantity"), "shape", "scale")


POISSON = T.poisson_edges()


@query("bootstrap_moments", f"""WITH x AS (SELECT rep, p_retailprice - (SELECT avg(p_retailprice) FROM part) AS d, {UNIT.format("p_partkey || '_' || rep || '_boot'")} AS u FROM part CROSS JOIN (SELECT unnest(range(1, 1001)) AS rep)),
w AS (SELECT rep, d, CASE {' '.join(f'WHEN u < {e} THEN {k}' for k, e in enumerate(POISSON))} ELSE {len(POISSON)} END AS w FROM x),
s AS (SELECT rep, sum(w) AS n, sum(w * d) / sum(w) AS a, sum(w * d ** 2) / sum(w) AS b, sum(w * d ** 3) / sum(w) AS c, sum(w * d ** 4) / sum(w) AS e FROM w GROUP BY 1)
SELECT rep::INT AS replicate, n::BIGINT AS n, round((c - 3 * a * b + 2 * a ** 3) / (b - a * a) ** 1.5, 5) AS skewness, round((e - 4 * a * c + 6 * a * a * b - 3 * a ** 4) / (b - a * a) ** 2, 5) AS kurtosis FROM s""")
def bootstrap_moments(t):
    return r6(T.bootstrap_moments(t.part, ["p_partkey"], "p_retailprice", 1000), "skewness", "kurtosis", digits=5)


@query("ecdf", f"WITH {OBJ} SELECT line, price, count(*) AS n, round(sum(count(*)) OVER (PARTITION BY line ORDER BY price) / sum(count(*)) OVER (PARTITION BY line), 6) AS ecdf FROM obj GROUP BY line, price")
def ecdf(t):
    return r6(T.ecdf(t.objects, ["line"], "price"), "ecdf")


DAUC = f"""{OBJ}, d AS (SELECT line, drug, conc, ln(conc) AS x, avg(quantity) / 50 AS v FROM obj WHERE conc > 0 GROUP BY ALL),
a AS (SELECT *, (x - lag(x) OVER (PARTITION BY line, drug ORDER BY x)) * (v + lag(v) OVER (PARTITION BY line, drug ORDER BY x)) / 2 AS a FROM d)"""


@query("dose_auc", f"WITH {DAUC} SELECT line, drug, count(*) AS doses, round(sum(a) / (max(x) - min(x)), 6) AS auc FROM a GROUP BY ALL HAVING count(*) > 1")
def dose_auc(t):
    return r6(T.dose_auc(t.objects.withColumn("v", F.col("quantity") / 50), ["line", "drug"], "conc", "v"), "auc")


@query("dose_auc_fitted")
def dose_auc_fitted(t):
    return r6(T.dose_auc_fitted(t.objects.withColumn("v", F.col("quantity") / 50), ["line", "drug"], "conc", "v"), "ec50", "hill", "auc")


@query("assay_discordance", f"""WITH {OBJ}, a AS (SELECT line, drug, avg(price) FILTER (rep = 'F') / 1000 AS a, avg(price) FILTER (rep = 'O') / 1000 AS b FROM obj GROUP BY ALL),
l AS (SELECT quantile_cont(a, .5) - quantile_cont(a, .75) + quantile_cont(a, .25) AS la, quantile_cont(b, .5) - quantile_cont(b, .75) + quantile_cont(b, .25) AS lb FROM a),
d AS (SELECT quantile_cont(a, .5) + quantile_cont(a, .75) - quantile_cont(a, .25) AS da, quantile_cont(b, .5) + quantile_cont(b, .75) - quantile_cont(b, .25) AS db FROM a WHERE drug IN ('Brand#1', 'Brand#2'))
SELECT line, drug, CASE WHEN a < da AND b > lb THEN 'dead_a_live_b' ELSE 'live_a_dead_b' END AS kind FROM a, l, d WHERE (a < da AND b > lb) OR (a > la AND b < db)""")
def assay_discordance(t):
    mean = lambda r: F.avg(F.when(F.col("rep") == r, F.col("price"))) / 1000
    a = t.objects.groupBy("line", "drug").agg(mean("F").alias("a"), mean("O").alias("b"))
    return T.assay_discordance(a, F.col("drug").isin("Brand#1", "Brand#2"), "a", "b").select("line", "drug", "kind")


@query("drug_mutation_matrix", f"""WITH {MUT}, g AS (SELECT drug, genotype, count(*) AS n, avg(auc) - (SELECT avg(auc) FROM la) AS d FROM la JOIN mut USING (line) GROUP BY ALL)
SELECT genotype, {', '.join(f'round(max(CASE WHEN d < 0 THEN log10(1.0 / (n + 1)) ELSE -log10(1.0 / (n + 1)) END) FILTER (drug = {chr(39)}Brand#{i}{chr(39)}), 6) AS "Brand#{i}"' for i in range(1, 26))} FROM g GROUP BY 1""")
def drug_mutation_matrix(t):
    la = _line_auc(t)
    mean = la.agg(F.avg("auc")).scalar()
    g = la.join(_mutations(t), "line").groupBy("drug", "genotype").agg(F.count(F.lit(1)).alias("n"), F.avg("auc").alias("m")).withColumn("d", F.col("m") - mean).withColumn("p", F.lit(1.0) / (F.col("n") + 1))
    m = T.drug_mutation_matrix(g, "drug", "genotype", "d", "p", [f"Brand#{i}" for i in range(1, 26)])
    return r6(m, *[c for c in m.columns if c != "genotype"])


@query("mutation_count_filter", f"WITH {MUT} SELECT genotype, count(DISTINCT line) AS lines FROM mut GROUP BY 1 HAVING count(DISTINCT line) > 2")
def mutation_count_filter(t):
    return T.mutation_count_filter(_mutations(t), "genotype", "line")


POLY = f"""{OBJ}, pt AS (SELECT uuid, line, quantity AS x, tax * 500 AS y FROM obj), v AS (SELECT line, conc, avg(quantity) AS x, avg(tax * 500) AS y, row_number() OVER (PARTITION BY line ORDER BY conc) AS i FROM obj GROUP BY line, conc),
s AS (SELECT a.line, a.i, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len FROM v a JOIN v b ON a.line = b.line AND b.i = a.i + 1),
c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM s),
q AS (SELECT uuid, line, i, done, len, x, y, ax, ay, dx, dy, least(1, greatest(0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) AS t FROM pt JOIN c USING (line)),
b AS (SELECT uuid, line, min(sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)) AS dist FROM q GROUP BY ALL)
SELECT uuid, round(dist, 5) AS dist, dist <= median(dist) OVER (PARTITION BY line) AS on_path FROM b"""


@query("project_to_polyline", f"WITH {POLY}")
def project_to_polyline(t):
    pts = t.objects.select("line", "uuid", F.col("quantity").alias("x"), (F.col("tax") * 500).alias("y"))
    path = t.objects.groupBy("line", "conc").agg(F.avg("quantity").alias("x"), F.avg(F.col("tax") * 500).alias("y"))
    p = T.project_to_polyline(pts, path, ["line"], ["uuid"], "x", "y", "conc")
    return p.select("uuid", rnd("dist", 5).alias("dist"), "on_path")
