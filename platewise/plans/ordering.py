"""Ranking, ordering, sampling and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions.expr import rnd
from platewise.operators import aggregate as A
from platewise.operators import sampling as S
from platewise.plans.registry import OBJ, query


@query("replicate_number", "SELECT s_suppkey, s_nationkey AS line, s_name, 'rep' || row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS replicate FROM supplier")
def replicate_number(t):
    return S.replicate_number(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("line"), "s_name"), "line", "s_name")


@query("time_index", "SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS time FROM orders")
def time_index(t):
    o = t.orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return S.time_index(o, ["o_custkey"], "date").drop("date")


@query("first_per_group", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) WHERE r = 1""")
def first_per_group(t):
    return S.first_per_group(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], [F.col("value"), F.col("event_id")])


@query("top_n_ties", "SELECT p_brand, p_partkey, p_size FROM part JOIN (SELECT p_brand, max(p_size) AS m FROM part GROUP BY 1) USING (p_brand) WHERE p_size = m")
def top_n_ties(t):
    return S.top_n_ties(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size")


@query("cum_variance", """WITH v AS (SELECT dim, var_samp(value) AS v FROM (SELECT unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1)
SELECT dim, round(v / sum(v) OVER (), 6) AS share, round(sum(v) OVER (ORDER BY dim) / sum(v) OVER (), 6) AS cumulative FROM v""")
def cum_variance(t):
    from platewise.plans.normalise import embedding_long

    v = embedding_long(t).groupBy("dim").agg(F.var_samp("value").alias("v"))
    c = A.running_share(v, "dim", "v")
    return c.select("dim", rnd("share").alias("share"), rnd("cumulative").alias("cumulative"))


@query("top_k_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k_order(t):
    return S.top_k_order(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100)


@query("rank_transform", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rank FROM events")
def rank_transform(t):
    return S.rank_transform(t.events, ["event_type"], "value").select("event_id", "rank")


UNIT = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"


@query("sample_fraction", f"SELECT event_id FROM events WHERE {UNIT.format(chr(39) + chr(39) + ' || event_id || ' + chr(39) + '_s1' + chr(39))} < 0.05")
def sample_fraction(t):
    return S.sample_fraction(t.events, ["event_id"], 0.05, "s1").select("event_id")


@query("sample_stratified", "SELECT event_id, event_type FROM events WHERE " + UNIT.format("event_id || '_s2'") + " < CASE event_type WHEN 'error' THEN 0.5 WHEN 'click' THEN 0.1 ELSE 0 END")
def sample_stratified(t):
    return S.sample_stratified(t.events, "event_type", ["event_id"], {"error": 0.5, "click": 0.1}, "s2").select("event_id", "event_type")


@query("sample_per_group", """
WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id || '_s3')) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
d AS (SELECT user_id, draw, floor(""" + UNIT.format("user_id || '_' || draw || '_s3'") + """ * n)::BIGINT + 1 AS i FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), (SELECT unnest(range(1, 21)) AS draw))
SELECT user_id, draw::INT AS draw, event_id FROM d JOIN o USING (user_id, i)""")
def sample_per_group(t):
    return S.sample_per_group(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"], 20, "s3").select("user_id", "draw", "event_id")


@query("balanced_sample", f"""WITH {OBJ}, o AS (SELECT uuid, line, ctrl, row_number() OVER (PARTITION BY line, ctrl ORDER BY md5(uuid || '_bal')) AS i FROM obj),
m AS (SELECT line, min(n) AS least FROM (SELECT line, ctrl, count(*) AS n FROM obj GROUP BY ALL) GROUP BY 1) SELECT uuid, line, ctrl FROM o JOIN m USING (line) WHERE i <= least""")
def balanced_sample(t):
    return S.balanced_sample(t.objects.select("uuid", "line", "ctrl"), ["line"], "ctrl", ["uuid"], "bal")


@query("train_test_split", "SELECT event_id, CASE WHEN " + UNIT.format("event_id || '_split'") + " < 0.6 THEN 'train' ELSE 'test' END AS split FROM events")
def train_test_split(t):
    return S.train_test_split(t.events.select("event_id"), ["event_id"])


@query("union_all", "SELECT p_partkey AS id, p_name AS name, NULL::DOUBLE AS balance FROM part UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def union_all(t):
    return S.union_all([
        t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))])


@query("distinct", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def distinct(t):
    return t.lineitem.select("l_suppkey", "l_partkey").distinct()


@query("intersect", f"WITH {OBJ} SELECT well FROM obj GROUP BY 1 HAVING count(DISTINCT plate) = (SELECT count(DISTINCT plate) FROM obj) UNION ALL SELECT -1 - s_nationkey FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer)")
def intersect(t):
    wells = S.in_every_group(t.wells, "plate", "well")
    both = t.supplier.select("s_nationkey").intersect(t.customer.select("c_nationkey"))
    return wells.unionByName(both.select((-1 - F.col("s_nationkey")).cast("long").alias("well")))


@query("difference", "SELECT o_custkey AS plate FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def difference(t):
    plates = t.orders.select(F.col("o_custkey").alias("plate"))
    return plates.subtract(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("grid_bin_sample", """
WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
c AS (SELECT *, round(x, 1) + 0.0 AS cell_x, round(y, 1) + 0.0 AS cell_y FROM p)
SELECT cell_x, cell_y, vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY vec_id) AS r FROM c) WHERE r = 1""")
def grid_bin_sample(t):
    p = t.embeddings.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return S.grid_bin_sample(p, "x", "y", 1, [F.col("vec_id")]).select("cell_x", "cell_y", "vec_id", "label")


@query("centroid_path", f"WITH {OBJ} SELECT line, drug, conc, round(avg(quantity), 6) AS quantity, round(avg(tax), 6) AS tax FROM obj GROUP BY ALL")
def centroid_path(t):
    p = S.centroid_path(t.objects, ["line", "drug"], "conc", "quantity", "tax")
    return p.withColumn("quantity", rnd("quantity")).withColumn("tax", rnd("tax"))
