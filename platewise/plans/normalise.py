"""Normalisation and batch-correction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions.expr import rnd, signed_sqrt
from platewise.operators import normalize as N
from platewise.plans.registry import FEATURES, LONG, OBJ, query

PLATE = f"""{LONG}, med AS (SELECT line, plate, feature, median(value) AS m FROM long WHERE ctrl GROUP BY ALL),
mad AS (SELECT line, plate, feature, any_value(m) AS m, median(abs(value - m)) AS d FROM long JOIN med USING (line, plate, feature) WHERE ctrl GROUP BY ALL),
cen AS (SELECT line, feature, median(m) AS cm, median(d) AS cd FROM mad GROUP BY ALL),
fix AS (SELECT uuid, conc, long.rep, ctrl, feature, round((value - m) * CASE WHEN d <> 0 THEN cd / d END + cm, 4) AS value
        FROM long LEFT JOIN mad USING (line, plate, feature) LEFT JOIN cen USING (line, feature))"""


def wide_sql(table: str, digits: int | None = None) -> str:
    return "SELECT uuid, " + ", ".join(f"max(value) FILTER (feature = '{f}') AS {f}" for f in FEATURES) + f" FROM {table} GROUP BY uuid, conc, rep, ctrl"


def _rounded(df, digits=4):
    return df.select("uuid", *[rnd(f, digits).alias(f) for f in FEATURES])


@query("plate_effect_correct", f"WITH {PLATE} {wide_sql('fix')}")
def plate_effect_correct(t):
    o = t.objects.select("uuid", "line", "plate", "ctrl", *FEATURES)
    return _rounded(N.plate_effect_correct(o, "line", "plate", F.col("ctrl"), FEATURES))


@query("plate_effect_correct_vector", f"WITH {PLATE} {wide_sql('fix')}")
def plate_effect_correct_vector(t):
    o = t.objects.select("uuid", "line", "plate", "ctrl", F.array(*FEATURES).alias("features"))
    out = N.plate_effect_correct_vector(o, "line", "plate", F.col("ctrl"))
    return out.select("uuid", *[rnd(F.col("features")[i], 4).alias(f) for i, f in enumerate(FEATURES)])


@query("batch_effect_correct", f"""WITH {LONG}, b AS (SELECT feature, CASE WHEN line = 2 THEN 1 ELSE 2 END AS batch, value FROM long WHERE line IN (2, 3)),
m AS (SELECT feature, batch, median(value) AS med FROM b GROUP BY ALL),
d AS (SELECT feature, batch, any_value(med) AS med, median(abs(value - med)) AS mad FROM b JOIN m USING (feature, batch) GROUP BY ALL),
s AS (SELECT feature, max(med) FILTER (batch = 1) - max(med) FILTER (batch = 2) AS shift, max(mad) FILTER (batch = 1) / max(mad) FILTER (batch = 2) AS stretch FROM d GROUP BY 1),
own AS (SELECT line, feature, median(value) AS own FROM long WHERE line % 2 = 1 GROUP BY ALL),
fix AS (SELECT uuid, conc, long.rep, ctrl, feature, round(CASE WHEN line % 2 = 1 THEN (value - own) * stretch + own + shift ELSE value END, 4) AS value FROM long JOIN s USING (feature) LEFT JOIN own USING (line, feature))
{wide_sql('fix')}""")
def batch_effect_correct(t):
    ln = F.col("line")
    return _rounded(N.batch_effect_correct(t.objects.select("uuid", "line", *FEATURES), "line", ln == 2, ln == 3, ln % 2 == 1, FEATURES))


@query("boxcox_transform")
def boxcox_transform(t):
    out = N.boxcox_transform(t.objects.select("uuid", "plate", "ctrl", *FEATURES), "plate", F.col("ctrl"), ["uuid"], FEATURES)
    return out.select("uuid", "feature", rnd("value", 4).alias("value"), rnd("lam", 4).alias("lam"))


@query("dmso_center_zscore", f"""WITH {LONG}, s AS (SELECT line, feature, avg(value) FILTER (ctrl) AS c, avg(value) AS m, stddev_samp(value) AS sd FROM long GROUP BY ALL),
fix AS (SELECT uuid, conc, long.rep, ctrl, feature, round((value - c - (m - c)) / sd, 5) AS value FROM long JOIN s USING (line, feature)) {wide_sql('fix')}""")
def dmso_center_zscore(t):
    return _rounded(N.dmso_center_zscore(t.objects.select("uuid", "line", "ctrl", *FEATURES), "line", F.col("ctrl"), FEATURES), 5)


@query("dmso_center_control_sd", f"""WITH {LONG}, s AS (SELECT line, feature, avg(value) FILTER (ctrl) AS c, stddev_samp(value) FILTER (ctrl) AS sd FROM long GROUP BY ALL),
fix AS (SELECT uuid, conc, long.rep, ctrl, feature, round((value - c) / sd, 5) AS value FROM long JOIN s USING (line, feature)) {wide_sql('fix')}""")
def dmso_center_control_sd(t):
    return _rounded(N.dmso_center_zscore(t.objects.select("uuid", "line", "ctrl", *FEATURES), "line", F.col("ctrl"), FEATURES, by_control=True), 5)


@query("global_scale", f"""WITH {LONG}, s AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS sd FROM long GROUP BY ALL),
fix AS (SELECT uuid, conc, long.rep, ctrl, feature, round((value - m) / sd, 5) AS value FROM long JOIN s USING (feature)) {wide_sql('fix')}""")
def global_scale(t):
    return _rounded(N.global_scale(t.objects.select("uuid", *FEATURES), FEATURES), 5)


def trim_sql(source: str, keys: str, value: str, trim: float) -> str:
    return f"""o AS (SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS i, floor({trim} * count(*) OVER (PARTITION BY {keys})) AS cut, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
ts AS (SELECT {keys}, avg(x) AS tm, stddev_pop(x) AS tsd FROM o WHERE i >= cut AND i < n - cut GROUP BY ALL)"""


@query("trimmed_robust_z", f"""WITH {OBJ}, {trim_sql('obj', 'line', 'price', 0.1)}
SELECT uuid, round((price - tm) / tsd, 5) AS z FROM obj JOIN ts USING (line)""")
def trimmed_robust_z(t):
    return N.trimmed_robust_z(t.objects.select("uuid", "line", "price"), ["line"], "price", "z").select("uuid", rnd("z", 5).alias("z"))


@query("dmso_trimmed_norm", f"""WITH {LONG}, c AS (SELECT * FROM long WHERE ctrl), {trim_sql('c', 'line, feature', 'value', 0.1)},
fix AS (SELECT uuid, conc, long.rep, ctrl, feature, round((value - tm) / tsd, 5) AS value FROM long JOIN ts USING (line, feature)) {wide_sql('fix')}""")
def dmso_trimmed_norm(t):
    return _rounded(N.dmso_trimmed_norm(t.objects.select("uuid", "line", "ctrl", *FEATURES), "line", F.col("ctrl"), FEATURES), 5)


@query("replicate_robust_z", f"""WITH {LONG}, m AS (SELECT line, rep, feature, median(value) AS med FROM long GROUP BY ALL),
d AS (SELECT line, rep, feature, any_value(med) AS med, 1.4826 * median(abs(value - med)) AS mad FROM long JOIN m USING (line, rep, feature) GROUP BY ALL)
SELECT uuid, feature, round((value - med) / mad, 5) AS z FROM long JOIN d USING (line, rep, feature)""")
def replicate_robust_z(t):
    z = N.replicate_robust_z(t.objects.select("uuid", "line", "rep", *FEATURES), ["line", "rep"], ["uuid"], FEATURES)
    return z.select("uuid", "feature", rnd("z", 5).alias("z"))


@query("dmso_median_subtract", f"""WITH {LONG}, m AS (SELECT line, rep, feature, median(value) AS med FROM long WHERE ctrl GROUP BY ALL),
fix AS (SELECT uuid, conc, long.rep, ctrl, feature, round(value - med, 4) AS value FROM long JOIN m USING (line, rep, feature)) {wide_sql('fix')}""")
def dmso_median_subtract(t):
    return _rounded(N.dmso_median_subtract(t.objects.select("uuid", "line", "rep", "ctrl", *FEATURES), ["line", "rep"], F.col("ctrl"), FEATURES))


@query("well_surface_correct")
def well_surface_correct(t):
    w = t.wells.select("plate", (F.floor(F.col("well") / 24) + 1).cast("int").alias("row"), (F.col("well") % 24 + 1).cast("int").alias("col"), "ctrl", "price")
    out = N.well_surface_correct(w, "plate", "row", "col", "price", F.col("ctrl"))
    return out.select("plate", "row", "col", rnd("norm_fac", 4).alias("norm_fac"), rnd("price_norm", 4).alias("price_norm"))


@query("clip_negative", "SELECT s_suppkey, greatest(0.0, s_acctbal - 5000)::DOUBLE AS v FROM supplier")
def clip_negative(t):
    return N.clip_negative(t.supplier.select("s_suppkey", (F.col("s_acctbal") - 5000).alias("v")), "v")


@query("control_ratio", """WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS med FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT l_suppkey AS plate, l_partkey AS part, round(l_extendedprice / med, 6) AS viability FROM lineitem JOIN m USING (l_suppkey)""")
def control_ratio(t):
    v = N.control_ratio(t.wells.select("plate", "part", "ctrl", "price"), ["plate"], "price", F.col("ctrl"))
    return v.select("plate", "part", rnd("viability").alias("viability"))


EMB = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS dim FROM embeddings)"


def embedding_long(t):
    e = t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("p", "v"))
    return e.select("vec_id", "label", (F.col("p") + 1).cast("long").alias("dim"), F.col("v").cast("double").alias("value"))


@query("quantile_normalize", f"""WITH {EMB}, r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY value, md5(vec_id || '_')) AS k FROM e),
m AS (SELECT k, avg(value) AS mean FROM r GROUP BY 1) SELECT vec_id, dim, round(mean, 6) AS normalized FROM r JOIN m USING (k)""")
def quantile_normalize(t):
    q = N.quantile_normalize(embedding_long(t), "dim", "vec_id", "value")
    return q.select("vec_id", "dim", rnd("normalized").alias("normalized"))


@query("log_transform", "SELECT p_partkey, round(ln(p_retailprice), 6) AS expr FROM part")
def log_transform(t):
    return t.part.select("p_partkey", rnd(F.ln("p_retailprice")).alias("expr"))


VIEWS = f"""{LONG}, v AS (SELECT uuid, feature, CASE WHEN rep = 'F' THEN 'morphology_view' ELSE 'size_view' END AS view, value FROM long)"""


@query("feature_scale_by_view", f"""WITH {VIEWS}, s AS (SELECT feature, view, avg(value) AS m, stddev_samp(value) AS sd FROM v GROUP BY ALL)
SELECT uuid, feature, view, round((value - CASE WHEN view = 'size_view' THEN 0 ELSE m END) / sd, 5) AS scaled FROM v JOIN s USING (feature, view)""")
def feature_scale_by_view(t):
    v = t.objects.select("uuid", F.when(F.col("rep") == "F", "morphology_view").otherwise("size_view").alias("view"), *FEATURES).unpivot(["uuid", "view"], FEATURES, "feature", "value")
    s = N.feature_scale_by_view(v, ["feature", "view"], "value", "view", ["size_view"], "scaled")
    return s.select("uuid", "feature", "view", rnd("scaled", 5).alias("scaled"))


@query("matrix_center_scale", f"""WITH {EMB}, s AS (SELECT dim, avg(value) AS m, stddev_samp(value) AS sd FROM e GROUP BY 1)
SELECT vec_id, dim, round((value - m) / sd, 6) AS scaled FROM e JOIN s USING (dim)""")
def matrix_center_scale(t):
    s = N.matrix_center_scale(embedding_long(t), ["dim"], "value", "scaled")
    return s.select("vec_id", "dim", rnd("scaled").alias("scaled"))


@query("center_by_group_median", f"""WITH {OBJ}, a AS (SELECT line, drug, avg(price) AS auc FROM obj GROUP BY ALL), m AS (SELECT drug, median(auc) AS med FROM a GROUP BY 1)
SELECT line, drug, round(auc - med, 4) AS centered FROM a JOIN m USING (drug)""")
def center_by_group_median(t):
    a = t.objects.groupBy("line", "drug").agg(F.avg("price").alias("auc"))
    return N.center_by_group_median(a, ["drug"], "auc", "centered").select("line", "drug", rnd("centered", 4).alias("centered"))


@query("zscore_columns", f"""WITH {OBJ}, a AS (SELECT line, drug, avg(price) AS v FROM obj GROUP BY ALL), s AS (SELECT drug, avg(v) AS m, stddev_samp(v) AS sd FROM a GROUP BY 1)
SELECT line, drug, round((v - m) / sd, 5) AS z FROM a JOIN s USING (drug)""")
def zscore_columns(t):
    a = t.objects.groupBy("line", "drug").agg(F.avg("price").alias("v"))
    return N.zscore_columns(a, ["drug"], "v").select("line", "drug", rnd("z", 5).alias("z"))


@query("signed_sqrt", "SELECT event_id, round(CASE WHEN value < 50 THEN -sqrt(50 - value) ELSE sqrt(value - 50) END, 6) AS s FROM events")
def signed_sqrt_q(t):
    return t.events.select("event_id", rnd(signed_sqrt(F.col("value") - 50)).alias("s"))
