"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions.expr import off_tie, rnd
from platewise.operators import joins as J
from platewise.plans.registry import OBJ, query
from platewise.plans.keys import BARCODE_SQL, _barcodes


@query("join_inner", "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_inner(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return J.join_inner(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), o, ["l_orderkey"])


@query("join_left", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def join_left(t):
    return J.join_left(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("join_semi", "SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) >= 25)")
def join_semi(t):
    many = t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).where("n >= 25")
    return J.join_semi(t.part.select("p_partkey", "p_name"), many, ["p_name"])


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_anti(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.join_anti(t.customer.select("c_custkey", "c_name"), done, ["c_custkey"])


@query("join_cross_combos", "SELECT drug, mutation FROM (SELECT DISTINCT p_brand AS drug FROM part), (SELECT DISTINCT c_mktsegment AS mutation FROM customer)")
def join_cross_combos(t):
    return J.join_cross_combos(t.part.select(F.col("p_brand").alias("drug")), t.customer.select(F.col("c_mktsegment").alias("mutation")))


PROFILE = f"""{OBJ}, prof AS (SELECT line, drug, avg(quantity) AS quantity, avg(price) / 1000 AS price, avg(tax) * 100 AS tax FROM obj GROUP BY ALL)"""


def profiles(t):
    return t.objects.groupBy("line", "drug").agg(F.avg("quantity").alias("quantity"), (F.avg("price") / 1000).alias("price"), (F.avg("tax") * 100).alias("tax"))


@query("join_barcode_fuzzy", f"""WITH {BARCODE_SQL}, re AS (SELECT s_suppkey AS re_suppkey, barcode[1:8] || 'X' || barcode[10:] AS re_barcode FROM bc WHERE s_suppkey % 3 = 0)
SELECT s_suppkey, barcode, re_suppkey, re_barcode FROM bc JOIN re ON barcode[1:8] || barcode[10:] = re_barcode[1:8] || re_barcode[10:]""")
def join_barcode_fuzzy(t):
    bc = _barcodes(t)
    b = F.col("barcode")
    re = bc.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("re_suppkey"), F.concat(F.substring(b, 1, 8), F.lit("X"), F.substr(b, F.lit(10))).alias("re_barcode"))
    return J.join_barcode_fuzzy(bc, re, "barcode", "re_barcode")


INTERVALS = "iv AS (SELECT p_partkey AS id, p_size % 22 AS chrom, p_partkey * 37 % 50000 AS start, p_partkey * 37 % 50000 + p_size * 20 AS stop FROM part)"


def _intervals(t):
    a = F.col("p_partkey") * 37 % 50000
    return t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 22).alias("chrom"), a.alias("start"), (a + F.col("p_size") * 20).alias("stop"))


@query("join_interval_points", f"""WITH {INTERVALS}, pt AS (SELECT o_orderkey, (o_custkey % 22)::INT AS chrom, o_orderkey * 13 % 50000 AS pos FROM orders)
SELECT o_orderkey, chrom, pos, id FROM pt JOIN iv USING (chrom) WHERE pos > start AND pos < stop""")
def join_interval_points(t):
    pts = t.orders.select("o_orderkey", (F.col("o_custkey") % 22).cast("int").alias("chrom"), (F.col("o_orderkey") * 13 % 50000).alias("pos"))
    return J.join_interval_points(pts, _intervals(t), "chrom", "pos", "start", "stop").select("o_orderkey", "chrom", "pos", "id")


@query("join_interval_count", f"""WITH {INTERVALS}, rd AS (SELECT (o_custkey % 22)::INT AS chrom, o_orderkey * 13 % 50000 AS a, o_orderkey * 13 % 50000 + 100 AS b FROM orders)
SELECT id, chrom, start, stop, (SELECT count(*) FROM rd WHERE rd.chrom = iv.chrom AND rd.a < iv.stop AND rd.b > iv.start) AS count FROM iv""")
def join_interval_count(t):
    a = F.col("o_orderkey") * 13 % 50000
    reads = t.orders.select((F.col("o_custkey") % 22).cast("int").alias("chrom"), a.alias("a"), (a + 100).alias("b"))
    return J.join_interval_count(_intervals(t), reads, ["id"], "chrom", "start", "stop", "a", "b")


@query("join_multi_fold", """SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r
FROM lineitem GROUP BY 1 HAVING a > 0 AND n > 0 AND r > 0""")
def join_multi_fold(t):
    each = [t.lineitem.where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.count(F.lit(1)).alias(f.lower())) for f in "ANR"]
    return J.join_multi_fold(each, ["l_partkey"])


@query("join_positional", "SELECT l_suppkey AS plate, count(*) AS n, max(l_extendedprice) AS price FROM lineitem GROUP BY 1")
def join_positional(t):
    a = t.wells.groupBy("plate").agg(F.count(F.lit(1)).alias("n"))
    return J.join_keyed_bind(a, t.wells.groupBy("plate").agg(F.max("price").alias("price")), ["plate"])


@query("complete_grid", f"""WITH {OBJ}, c AS (SELECT well % 24 AS col, conc, count(*) AS n FROM obj GROUP BY ALL)
SELECT col, conc, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT col FROM c) CROSS JOIN (SELECT DISTINCT conc FROM c)) LEFT JOIN c USING (col, conc)""")
def complete_grid(t):
    c = t.wells.groupBy((F.col("well") % 24).alias("col"), "conc").agg(F.count(F.lit(1)).alias("n"))
    return J.complete_grid(c, ["col"], ["conc"], "n")


@query("two_assay_merge", f"""WITH {OBJ}, a AS (SELECT plate, well, line, drug, avg(price) AS price FROM obj WHERE rep = 'F' GROUP BY ALL), b AS (SELECT plate, well, avg(quantity) AS quantity FROM obj WHERE rep = 'O' GROUP BY ALL)
SELECT line, drug, count(*) AS wells, round(avg(price) + 0.00001234, 4) AS price, round(avg(quantity), 6) AS quantity FROM a JOIN b USING (plate, well) GROUP BY ALL""")
def two_assay_merge(t):
    m = J.two_assay_merge(t.objects.where("rep = 'F'"), t.objects.where("rep = 'O'"), ["plate", "well"], ["line", "drug"], "price", "quantity")
    return m.withColumn("price", off_tie("price", 4)).withColumn("quantity", rnd("quantity"))
