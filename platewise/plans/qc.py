"""Object quality filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions.expr import rnd
from platewise.operators import qc as Q
from platewise.plans.registry import FEATURES, OBJ, query

@query("size_outlier_filter", f"""WITH {OBJ}, q AS (SELECT line, quantile_cont(price, .95) AS top FROM obj GROUP BY 1)
SELECT uuid, line, price FROM obj JOIN q USING (line) WHERE price >= 300 AND price < top""")
def size_outlier_filter(t):
    return Q.size_outlier_filter(t.objects.select("uuid", "line", "price"), ["line"], "price")


@query("eccentricity_filter", f"WITH {OBJ} SELECT uuid FROM obj WHERE quantity / 50 < 0.95")
def eccentricity_filter(t):
    return Q.eccentricity_filter(t.objects.select("uuid", (F.col("quantity") / 50).alias("ecc")), "ecc").select("uuid")


SHAPE_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_quantity * 10 < least(l_partkey % 2048, 2048 - l_partkey % 2048, l_orderkey % 2048, 2048 - l_orderkey % 2048)"""


@query("boundary_filter", SHAPE_SQL)
def boundary_filter(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 10).alias("radius"),
                          (F.col("l_partkey") % 2048).alias("cx"), (F.col("l_orderkey") % 2048).alias("cy"))
    return Q.boundary_filter(x, "radius", "cx", "cy").drop("radius", "cx", "cy")


ITEM = """item AS (SELECT l_suppkey AS plate, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS uuid,
  l_extendedprice AS price, l_tax AS tax, l_quantity AS quantity FROM lineitem)"""
BLUR = f"""{ITEM}, s AS (SELECT *, greatest(quantity, tax * 500) AS score FROM item),
c AS (SELECT plate, quantile_cont(score, .5) AS good, quantile_cont(score, .3) AS bad FROM s GROUP BY 1),
lab AS MATERIALIZED (SELECT plate, uuid, 'good' AS label FROM s JOIN c USING (plate) WHERE score >= good
        UNION ALL SELECT plate, uuid, 'blurry' FROM s JOIN c USING (plate) WHERE score <= bad),
ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plate, label ORDER BY md5(uuid || '_blur')) AS i, count(*) OVER (PARTITION BY plate, label) AS size FROM lab),
least_size AS (SELECT plate, CASE WHEN count(*) = 2 THEN min(n) ELSE 0 END AS draws FROM (SELECT plate, label, count(*) AS n FROM lab GROUP BY ALL) GROUP BY 1),
draw AS MATERIALIZED (SELECT plate, label, ord.i AS draw, floor(('0x' || substr(md5(plate || '_' || label || '_' || i || '_blur'), 1, 13))::BIGINT / 4503599627370496.0 * size)::BIGINT + 1 AS i
         FROM ord JOIN least_size USING (plate) WHERE ord.i <= draws)"""


def _items(t):
    return t.lineitem.select(
        F.col("l_suppkey").alias("plate"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uuid"),
        F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("quantity"),
        (F.col("l_tax") * 500).alias("tax500"))


@query("blur_label", f"WITH {BLUR} SELECT plate, label, draw, uuid FROM draw JOIN ord USING (plate, label, i)")
def blur_label(t):
    return Q.blur_label(_items(t), ["plate"], ["quantity", "tax500"], ["uuid"]).select("plate", "label", "draw", "uuid")


@query("blur_feature_select", f"""WITH {BLUR}, smp AS (SELECT item.* FROM draw JOIN ord USING (plate, label, i) JOIN item USING (plate, uuid)),
r AS (SELECT 'price' AS feature, stddev_pop(price) AS sd, greatest(abs(corr(price, quantity)), abs(corr(price, tax))) AS mc FROM smp
UNION ALL SELECT 'quantity', stddev_pop(quantity), greatest(abs(corr(quantity, quantity)), abs(corr(quantity, tax))) FROM smp
UNION ALL SELECT 'tax', stddev_pop(tax), greatest(abs(corr(tax, quantity)), abs(corr(tax, tax))) FROM smp)
SELECT feature, round(sd, 4) AS sd, round(mc, 6) AS max_corr, sd <> 0 AND mc < 0.9 AS keep FROM r""")
def blur_feature_select(t):
    smp = Q.blur_label(_items(t), ["plate"], ["quantity", "tax500"], ["uuid"])
    return Q.blur_feature_select(smp, FEATURES, ["quantity", "tax"]).withColumn("sd", rnd("sd", 4)).withColumn("max_corr", rnd("max_corr"))


MORE = [*FEATURES, "unit", "load", "levy"]


def _more(df):
    """Further features of an object: price per piece, and two that follow the labelling features loosely."""
    return df.withColumn("unit", F.col("price") / F.col("quantity")).withColumn("load", F.col("price") * (F.col("tax") + 0.01)).withColumn("levy", F.col("quantity") * (F.col("tax") + 0.02))


@query("blur_classifier_filter")
def blur_classifier_filter(t):
    kept = Q.blur_classifier_filter(_more(_items(t)), ["plate"], MORE, ["quantity", "tax500"], ["uuid"], trees=100)
    return kept.select("plate", "uuid")


@query("blur_choices", f"""WITH {BLUR}, smp AS (SELECT plate, price, quantity, tax, price / quantity AS unit, price * (tax + 0.01) AS load, quantity * (tax + 0.02) AS levy FROM draw JOIN ord USING (plate, label, i) JOIN item USING (plate, uuid)),
r AS ({" UNION ALL ".join(f"SELECT plate, '{f}' AS feature, stddev_pop({f}) AS sd, greatest(abs(corr({f}, quantity)), abs(corr({f}, tax))) AS mc FROM smp GROUP BY plate" for f in MORE)})
SELECT plate, feature FROM r WHERE sd > 0 AND NOT coalesce(mc >= 0.9, false)""")
def blur_choices(t):
    smp = Q.blur_label(_more(_items(t)), ["plate"], ["quantity", "tax500"], ["uuid"])
    c = Q.blur_choices(smp, ["plate"], MORE, ["quantity", "tax500"])
    names = F.array(*[F.lit(f) for f in MORE])
    return c.select(F.get_json_object("g", "$.plate").cast("long").alias("plate"), F.explode("allowed").alias("i")).select("plate", names[F.col("i")].alias("feature"))


PRE = f"""{OBJ}, q AS (SELECT line, quantile_cont(price, .95) AS top FROM obj GROUP BY 1),
k AS (SELECT obj.* FROM obj JOIN q USING (line) WHERE price >= 300 AND price < top
  AND quantity * 10 < least(part % 2048, 2048 - part % 2048, well * 5, 2048 - well * 5)),
med AS (SELECT line, plate, {", ".join(f"median({f}) AS m_{f}" for f in FEATURES)} FROM k WHERE ctrl GROUP BY ALL),
mad AS (SELECT k.line, k.plate, {", ".join(f"any_value(m_{f}) AS m_{f}, median(abs({f} - m_{f})) AS d_{f}" for f in FEATURES)} FROM k JOIN med USING (line, plate) WHERE ctrl GROUP BY ALL),
c AS (SELECT line, {", ".join(f"median(m_{f}) AS cm_{f}, median(d_{f}) AS cd_{f}" for f in FEATURES)} FROM mad GROUP BY 1)"""


def _raw(t):
    return t.objects.withColumn("radius", F.col("quantity") * 10).withColumn("cx", F.col("part") % 2048).withColumn("cy", F.col("well") * 5).withColumn("tax500", F.col("tax") * 500)


@query("preprocess_line")
def preprocess_line(t):
    """Size, boundary and blur filters, then plate correction of all features."""
    out = Q.preprocess_line(_more(_raw(t)), "line", "plate", F.col("ctrl"), ["uuid"], MORE, "price", "radius", "cx", "cy", ["quantity", "tax500"])
    return out.select("uuid", *[rnd(f, 4).alias(f) for f in MORE])


@query("preprocess_line_sharp", f"""WITH {PRE}
SELECT uuid, {", ".join(f"round(({f} - m_{f}) * CASE WHEN d_{f} <> 0 THEN cd_{f} / d_{f} END + cm_{f}, 4) AS {f}" for f in FEATURES)} FROM k LEFT JOIN mad USING (line, plate) LEFT JOIN c USING (line)""")
def preprocess_line_sharp(t):
    """The same steps without the blur filter, which SQL can follow."""
    out = Q.preprocess_line(_raw(t), "line", "plate", F.col("ctrl"), ["uuid"], FEATURES, "price", "radius", "cx", "cy", None)
    return out.select("uuid", *[rnd(f, 4).alias(f) for f in FEATURES])


@query("size_histogram", f"""WITH {OBJ}, b AS (SELECT line, (floor(sqrt(price) / 5) * 5)::BIGINT AS bin, count(*) AS n FROM obj GROUP BY ALL)
SELECT line, bin, n, round(n / sum(n) OVER (PARTITION BY line), 6) AS fraction,
 round(sum(n) OVER (PARTITION BY line ORDER BY bin) / sum(n) OVER (PARTITION BY line), 6) AS cumulative FROM b""")
def size_histogram(t):
    h = Q.size_histogram(t.objects.select("line", "price"), ["line"], "price", 5)
    return h.withColumn("fraction", rnd("fraction")).withColumn("cumulative", rnd("cumulative"))


@query("top_size_quantile", f"""WITH {OBJ}, q AS (SELECT line, quantile_cont(price, .9) AS hi, quantile_cont(price, .1) AS lo FROM obj GROUP BY 1)
SELECT uuid, 'large' AS side FROM obj JOIN q USING (line) WHERE price >= hi UNION ALL SELECT uuid, 'small' FROM obj JOIN q USING (line) WHERE price <= lo""")
def top_size_quantile(t):
    o = t.objects.select("uuid", "line", "price")
    hi = Q.top_size_quantile(o, ["line"], "price", 0.9).select("uuid", F.lit("large").alias("side"))
    return hi.unionByName(Q.top_size_quantile(o, ["line"], "price", 0.1, largest=False).select("uuid", F.lit("small").alias("side")))


@query("feature_schema_check", f"""WITH {OBJ}, u AS (SELECT plate, md5(string_agg(rep, ',' ORDER BY rep)) AS signature FROM (SELECT DISTINCT plate, rep FROM obj) GROUP BY 1)
SELECT signature, count(*) AS units, (SELECT count(DISTINCT signature) = 1 FROM u) AS consistent FROM u GROUP BY 1""")
def feature_schema_check(t):
    return Q.feature_schema_check(t.wells, ["plate"], "rep")


@query("finite_common_features", f"""WITH {OBJ}, x AS (SELECT line, max((NOT isfinite(quantity))::INT) AS quantity, max((tax = 0)::INT) AS inv_tax, max((part % 1000 = 0)::INT) AS nan_price FROM obj GROUP BY 1)
SELECT 'quantity' AS feature, sum(quantity)::BIGINT AS bad_lines, sum(quantity) = 0 AS common FROM x
UNION ALL SELECT 'inv_tax', sum(inv_tax)::BIGINT, sum(inv_tax) = 0 FROM x UNION ALL SELECT 'nan_price', sum(nan_price)::BIGINT, sum(nan_price) = 0 FROM x""")
def finite_common_features(t):
    x = t.objects.select("line", "quantity", F.when(F.col("tax") == 0, float("inf")).otherwise(F.try_divide(F.lit(1.0), F.col("tax"))).alias("inv_tax"),
                         F.when(F.col("part") % 1000 == 0, float("nan")).otherwise(F.col("price")).alias("nan_price"))
    return Q.finite_common_features(x, "line", ["quantity", "inv_tax", "nan_price"])
