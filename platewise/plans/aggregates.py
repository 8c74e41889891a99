"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions.expr import off_tie, rnd
from platewise.operators import aggregate as A
from platewise.plans.registry import FEATURES, OBJ, query

AUC = f"""{OBJ}, auc AS (SELECT line, drug, conc, avg(price) / 100000 AS auc, count(*) AS n FROM obj GROUP BY ALL)"""


def aucs(t):
    return t.objects.groupBy("line", "drug", "conc").agg((F.avg("price") / 100000).alias("auc"), F.count(F.lit(1)).alias("n"))


@query("well_median_mad", """
WITH m AS (SELECT l_suppkey AS plate, l_partkey % 384 AS well, median(l_extendedprice) AS p, median(l_tax) AS t FROM lineitem GROUP BY ALL)
SELECT plate, well, count(*) AS n_objects, min(l_partkey) AS part, round(any_value(p), 4) AS median_price, round(median(abs(l_extendedprice - p)), 4) AS mad_price,
round(any_value(t), 6) AS median_tax, round(median(abs(l_tax - t)), 6) AS mad_tax
FROM lineitem JOIN m ON plate = l_suppkey AND well = l_partkey % 384 GROUP BY plate, well""")
def well_median_mad(t):
    w = A.well_median_mad(t.wells, ["plate", "well"], ["price", "tax"], ["part"])
    return w.select("plate", "well", "n_objects", "part", *[rnd(f"{k}_{f}", d).alias(f"{k}_{f}") for f, d in (("price", 4), ("tax", 6)) for k in ("median", "mad")])


@query("well_mean_summaries", f"""WITH {OBJ} SELECT line, plate, rep, well, drug, conc, count(*) AS n_objects, round(avg(price) + 0.00001234, 4) AS mean_size, round(median(price), 4) AS median_size,
round(avg(quantity), 6) AS mean_quantity, round(avg(tax), 6) AS mean_tax FROM obj GROUP BY line, plate, rep, well, drug, conc""")
def well_mean_summaries(t):
    w = A.well_mean_summaries(t.objects, ["line", "plate", "rep", "well", "drug", "conc"], "price", ["quantity", "tax"])
    return w.select("line", "plate", "rep", "well", "drug", "conc", "n_objects", off_tie("mean_size", 4).alias("mean_size"), rnd("median_size", 4).alias("median_size"),
                    rnd("mean_quantity").alias("mean_quantity"), rnd("mean_tax").alias("mean_tax"))


@query("treatment_mean_profile", f"""WITH {OBJ} SELECT line, drug, conc, rep, count(*) AS n, round(avg(quantity), 6) AS quantity, round(avg(price) + 0.00001234, 4) AS price, round(avg(tax), 6) AS tax
FROM obj GROUP BY line, drug, conc, rep""")
def treatment_mean_profile(t):
    p = A.treatment_mean_profile(t.objects, ["line", "drug", "conc", "rep"], FEATURES)
    return p.select("line", "drug", "conc", "rep", "n", rnd("quantity").alias("quantity"), off_tie("price", 4).alias("price"), rnd("tax").alias("tax"))


@query("live_dead_well_summary", """
WITH x AS (SELECT l_suppkey AS plate, l_partkey % 384 AS well, l_partkey AS drug, l_quantity / 50 AS dead, 1 - l_quantity / 50 AS live FROM lineitem)
SELECT plate, well, min(drug) AS drug, count(*) AS num_objects, round(avg((dead > .5)::INT), 6) AS percent_dead, round(1 - avg((dead > .5)::INT), 6) AS percent_live,
round(avg(live) FILTER (dead <= .5), 6) AS mean_certainty_live, round(avg(dead) FILTER (dead > .5), 6) AS mean_certainty_dead FROM x GROUP BY plate, well""")
def live_dead_well_summary(t):
    x = t.wells.select("plate", "well", F.col("part").alias("drug"), (F.col("quantity") / 50).alias("dead"), (1 - F.col("quantity") / 50).alias("live"))
    s = A.live_dead_well_summary(x, ["plate", "well"], F.col("dead") > 0.5, "live", "dead", ["drug"])
    return s.select("plate", "well", "drug", "num_objects", *[rnd(c).alias(c) for c in ("percent_dead", "percent_live", "mean_certainty_live", "mean_certainty_dead")])


@query("median_se_band", """
WITH m AS (SELECT l_suppkey AS plate, l_returnflag AS type, median(l_extendedprice) AS med, count(*) AS n FROM lineitem GROUP BY ALL),
d AS (SELECT plate, type, any_value(med) AS med, 1.4826 * median(abs(l_extendedprice - med)) / sqrt(any_value(n)) AS se FROM lineitem JOIN m ON plate = l_suppkey AND type = l_returnflag GROUP BY plate, type)
SELECT plate, type, round(med, 4) AS med_val, round(se, 4) AS se, round(med - 2 * se, 4) AS ymin, round(med + 2 * se, 4) AS ymax FROM d""")
def median_se_band(t):
    x = t.lineitem.select(F.col("l_suppkey").alias("plate"), F.col("l_returnflag").alias("type"), F.col("l_extendedprice").alias("price"))
    b = A.median_se_band(x, ["plate", "type"], "price")
    return b.select("plate", "type", *[rnd(c, 4).alias(c) for c in ("med_val", "se", "ymin", "ymax")])


@query("dose_band", f"""WITH {OBJ} SELECT line, drug, conc, min(price) AS min_live, max(price) AS max_live, round((min(price) + max(price)) / 2, 4) AS mean FROM obj GROUP BY line, drug, conc""")
def dose_band(t):
    return A.dose_band(t.objects, ["line", "drug", "conc"], "price").withColumn("mean", rnd("mean", 4))


@query("group_quantile", f"WITH {OBJ} SELECT line, round(quantile_cont(ln(price), .9), 6) AS q90 FROM obj GROUP BY 1")
def group_quantile(t):
    q = A.group_quantile(t.objects.select("line", F.ln("price").alias("ln_size")), ["line"], "ln_size", 0.9, "q90")
    return q.select("line", rnd("q90").alias("q90"))


@query("whisker_bounds", """WITH q AS (SELECT l_suppkey AS plate, quantile_cont(l_extendedprice, .25) AS a, quantile_cont(l_extendedprice, .75) AS b FROM lineitem GROUP BY 1)
SELECT plate, round(a - 1.5 * (b - a) + 0.00001234, 4) AS lower, round(b + 1.5 * (b - a) + 0.00001234, 4) AS upper FROM q""")
def whisker_bounds(t):
    return A.whisker_bounds(t.wells, ["plate"], "price").select("plate", off_tie("lower", 4).alias("lower"), off_tie("upper", 4).alias("upper"))


@query("histogram_bins", """SELECT event_type, CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE floor(value / 5)::BIGINT + 1 END AS bin, count(*) AS n FROM events GROUP BY ALL""")
def histogram_bins(t):
    return A.histogram_bins(t.events, ["event_type"], "value", 0, 100, 20)


@query("plate_time_mean", """
WITH d AS (SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS time FROM orders)
SELECT o_custkey, time, round(avg(l_extendedprice) + 0.00001234, 4) AS mean_price FROM lineitem JOIN d ON l_orderkey = o_orderkey GROUP BY ALL""")
def plate_time_mean(t):
    from platewise.operators.sampling import time_index

    times = time_index(t.orders.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")), ["o_custkey"], "date")
    x = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("price"))
    return A.plate_time_mean(x, times, ["o_orderkey"], ["o_custkey", "time"], "price").withColumn("mean_price", off_tie("mean_price", 4))


@query("counts_distinct", f"WITH {OBJ} SELECT line, count(DISTINCT (drug, conc)) AS n FROM obj GROUP BY 1")
def counts_distinct(t):
    return A.counts_distinct(t.objects, ["line"], ["drug", "conc"])


@query("share_of_total", f"""WITH {OBJ}, c AS (SELECT line, drug, count(*) AS n FROM obj GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY line) AS share FROM c)
SELECT line, drug, n, round(share, 6) AS share, round(min(share) OVER (PARTITION BY line), 6) AS min_share, round(max(share) OVER (PARTITION BY line), 6) AS max_share FROM s""")
def share_of_total(t):
    s = A.share_of_total(t.objects.select("line", "drug"), ["line"], "drug")
    return s.select("line", "drug", "n", *[rnd(c).alias(c) for c in ("share", "min_share", "max_share")])


@query("active_count", f"WITH {AUC} SELECT line, count_if(auc >= 0.55)::BIGINT AS n_active FROM auc GROUP BY 1")
def active_count(t):
    return A.active_count(aucs(t), "line", "auc", 0.55)


@query("active_table", f"""WITH {AUC} SELECT drug, {', '.join(f'coalesce(max((auc >= 0.55)::INT) FILTER (line = {i}), 0) AS "{i}"' for i in range(25))}
FROM auc GROUP BY drug""")
def active_table(t):
    return A.active_table(aucs(t), "drug", "line", "auc", 0.55, list(range(25)))


@query("active_conc_count", f"""WITH {AUC}, p AS (SELECT line, drug, count_if(auc >= 0.55)::BIGINT AS n_active FROM auc GROUP BY ALL) SELECT n_active, count(*) AS frequency FROM p GROUP BY 1""")
def active_conc_count(t):
    return A.active_conc_count(aucs(t), ["drug", "line"], "auc", 0.55)


@query("lethality_degree", f"WITH {AUC} SELECT drug, least(count_if(auc <= 0.5), (SELECT count(DISTINCT line) FROM auc))::BIGINT AS lethality FROM auc GROUP BY 1")
def lethality_degree(t):
    return A.lethality_degree(aucs(t), "drug", "line", "auc", 0.5)


@query("dynamic_range", f"""WITH {AUC}, p AS (SELECT drug, line, avg(auc) AS a FROM auc GROUP BY ALL)
SELECT drug, round(max(a) - min(a), 6) AS dynamic_range FROM p GROUP BY 1 HAVING max(a) - min(a) > 0.21""")
def dynamic_range(t):
    return A.dynamic_range(aucs(t), "drug", "line", "auc").withColumn("dynamic_range", rnd("dynamic_range"))


@query("cv_top_fraction", """
WITH c AS (SELECT l_partkey AS probe, stddev_samp(l_extendedprice) / avg(l_extendedprice) AS cv FROM lineitem GROUP BY 1), k AS (SELECT * FROM c WHERE cv IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY cv DESC, md5(probe || '_')) AS r, count(*) OVER () AS n FROM k) SELECT probe, round(cv, 6) AS cv FROM r WHERE r <= floor(n * 0.1)""")
def cv_top_fraction(t):
    c = A.cv_top_fraction(t.lineitem.select(F.col("l_partkey").alias("probe"), "l_extendedprice"), "probe", "l_extendedprice")
    return c.select("probe", rnd("cv").alias("cv"))


@query("var_top_n", "SELECT l_partkey AS probe, round(stddev_samp(l_extendedprice), 3) AS sd FROM lineitem GROUP BY 1 ORDER BY stddev_samp(l_extendedprice) DESC, 1 LIMIT 100")
def var_top_n(t):
    v = A.var_top_n(t.lineitem.select(F.col("l_partkey").alias("probe"), "l_extendedprice"), "probe", "l_extendedprice", 100)
    return v.select("probe", rnd("sd", 3).alias("sd"))


@query("pivot_mean", f"""WITH {OBJ} SELECT line, drug, {', '.join(f"round(coalesce(avg(price) FILTER (target = '{p}'), 0) + 0.00001234, 3) AS {p}" for p in ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"))}
FROM obj GROUP BY line, drug""")
def pivot_mean(t):
    kinds = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"]
    p = A.pivot_mean(t.objects, ["line", "drug"], "target", "price", 0.0, kinds)
    return p.select("line", "drug", *[off_tie(k, 3).alias(k) for k in kinds])


@query("unpivot", f"""WITH {OBJ} SELECT uuid, 'quantity' AS feature, quantity AS value FROM obj UNION ALL SELECT uuid, 'price', price FROM obj UNION ALL SELECT uuid, 'tax', tax FROM obj""")
def unpivot(t):
    return A.unpivot(t.objects, ["uuid"], FEATURES)


@query("collapse_strings", f"WITH {OBJ} SELECT line, drug, string_agg(target, ';' ORDER BY target) AS targets FROM (SELECT DISTINCT line, drug, target FROM obj) GROUP BY ALL")
def collapse_strings(t):
    return A.collapse_strings(t.objects, ["line", "drug"], "target", "targets")


@query("contingency_margins", f"""WITH {OBJ} SELECT CASE WHEN grouping(line) = 1 THEN 'TOTAL' ELSE line::VARCHAR END AS line, CASE WHEN grouping(target) = 1 THEN 'TOTAL' ELSE target END AS target, count(*) AS n
FROM obj GROUP BY CUBE (line, target)""")
def contingency_margins(t):
    return A.contingency_margins(t.objects, "line", "target")


@query("pixel_histogram", "SELECT l_suppkey AS plate, l_linestatus AS rep, l_quantity AS quantity, count(*) AS n FROM lineitem GROUP BY ALL")
def pixel_histogram(t):
    return A.pixel_histogram(t.wells, ["plate", "rep"], "quantity")


@query("histogram_quantiles", """
WITH c AS (SELECT l_suppkey AS plate, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY plate ORDER BY q) AS u, sum(n) OVER (PARTITION BY plate) AS t FROM c)
SELECT plate, min(q) AS min, max(q) AS max, round(sum(q * n) / sum(n), 6) AS mean, """ + ", ".join(
    f"min(q) FILTER (u >= t * {p}) AS {k}" for k, p in A.HISTOGRAM_PROBS.items()) + " FROM r GROUP BY plate")
def histogram_quantiles(t):
    h = A.pixel_histogram(t.wells, ["plate"], "quantity")
    return A.histogram_quantiles(h, ["plate"], "quantity", "n").withColumn("mean", rnd("mean"))


@query("coverage_matrix", """
WITH c AS (SELECT l_partkey AS interval, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1)
SELECT interval, "F", "O", round(("F" + "O") / 2, 6) AS mean, round((SELECT avg(("F" + "O") / 2) FROM c), 6) AS expected FROM c""")
def coverage_matrix(t):
    x = t.lineitem.groupBy(F.col("l_partkey").alias("interval"), "l_linestatus").agg(F.count(F.lit(1)).alias("reads"))
    c = A.coverage_matrix(x, "interval", "l_linestatus", "reads", ["F", "O"])
    return c.withColumn("mean", rnd("mean")).withColumn("expected", rnd("expected"))
