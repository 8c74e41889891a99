"""Completeness queries, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import completeness as C
from platewise.plans.registry import query
from platewise.plans.sources import WELL_SQL, well_name
from platewise.streaming import completeness as S

GRID = "grid AS (SELECT chr(65 + (i // 24)::INT) || lpad((i % 24 + 1)::VARCHAR, 2, '0') AS name FROM (SELECT unnest(range(384)) AS i))"


@query("well_grid", f"""WITH {GRID}, w AS (SELECT DISTINCT l_partkey % 384 AS well FROM lineitem), n AS (SELECT {WELL_SQL} AS name, count(*) AS n FROM (SELECT l_partkey % 384 AS well FROM lineitem) GROUP BY 1)
SELECT name, name[1] AS row, name[2:] AS col, coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (name)""")
def well_grid(t):
    n = t.wells.groupBy(well_name().alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return C.well_grid(t.spark, 384).join(n, "name", "left").fillna(0, ["n"])


@query("missing_units", f"""WITH {GRID}, w AS (SELECT DISTINCT l_suppkey AS plate, l_partkey % 384 AS well FROM lineitem), o AS (SELECT plate, {WELL_SQL} AS name FROM w)
SELECT plate, name FROM (SELECT DISTINCT plate FROM o) CROSS JOIN grid WHERE (plate, name) NOT IN (SELECT (plate, name) FROM o)""")
def missing_units(t):
    seen = t.wells.select("plate", well_name().alias("name")).distinct()
    return C.missing_units(t.wells.select("plate"), C.well_grid(t.spark, 384).select("name"), seen, ["plate", "name"])


@query("reconcile_tables", """SELECT o_custkey, count(*) AS rows, bool_and(o_orderkey % 500 <> 0 AND o_orderkey % 700 <> 0) AS equal FROM orders GROUP BY 1""")
def reconcile_tables(t):
    a = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    b = a.where("o_orderkey % 700 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 500 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return C.reconcile_tables(a, b, ["o_orderkey", "o_custkey"], ["o_custkey"], ["o_totalprice", "o_orderstatus"])


@query("bad_unit_report", """WITH s AS (SELECT l_suppkey AS plate, l_partkey % 384 AS well, count_if(l_quantity = 50 AND l_tax = 0)::BIGINT AS failures, count_if(l_discount = 0)::BIGINT AS zeros FROM lineitem GROUP BY ALL)
SELECT * FROM s WHERE failures > 0 OR zeros >= 2""")
def bad_unit_report(t):
    return C.bad_unit_report(t.wells, ["plate", "well"], ~((F.col("quantity") == 50) & (F.col("tax") == 0)), F.col("conc") == 0, zeros=2)


@query("normalise_names", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'A - 0' || p_size || '(z ' ELSE 'A - ' || p_size || '(z ' END || lpad((p_partkey % 20)::VARCHAR, 2, '0') || ')' AS name FROM part")
def normalise_names(t):
    raw = F.concat(F.lit("A - "), F.col("p_size"), F.lit("(z "), F.col("p_partkey") % 20, F.lit(")"))
    return t.part.select("p_partkey", C.normalise_names(raw).alias("name"))


N_WELLS = 96


def _arrivals(t):
    schema = t.lineitem.schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").option("maxFilesPerTrigger", 1000).parquet(t.folder)
    return raw.select(F.col("l_suppkey").alias("plate"), (F.col("l_partkey") % N_WELLS).alias("well"), F.col("l_shipdate").cast("timestamp").alias("ts"))


COMPLETE = f"SELECT l_suppkey AS plate, count(DISTINCT l_partkey % {N_WELLS}) AS n_wells, 'complete' AS status FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey % {N_WELLS}) = {N_WELLS}"


@query("plate_completeness_stream", COMPLETE)
def plate_completeness_stream(t):
    out = S.run_to_table(S.plate_completeness(_arrivals(t), N_WELLS, patience="4000 days"), t.spark, "complete")
    return out.where("status = 'complete'")
