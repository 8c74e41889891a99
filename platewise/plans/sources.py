"""Sources and sinks: tables are written in the source's format, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions.expr import rnd
from platewise.plans.registry import FEATURES, OBJ, query
from platewise.session import fresh_path
from platewise.sources import feature_store as store
from platewise.sources import readers, sinks

def well_name():
    return F.concat(F.char(F.lit(65) + F.floor(F.col("well") / 24)), F.lpad((F.col("well") % 24 + 1).cast("string"), 2, "0"))


WELL_SQL = "chr(65 + (well // 24)::INT) || lpad((well % 24 + 1)::VARCHAR, 2, '0')"


@query("scan_plate_reader", """
WITH w AS (SELECT l_suppkey AS plate, l_partkey % 384 AS well, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT '170718_JB_M2_P' || plate AS screen, """ + WELL_SQL + """ AS well, n AS pcount FROM w""")
def scan_plate_reader(t):
    path = fresh_path(t.spark, "reads")
    counts = t.wells.groupBy("plate", "well").agg(F.count(F.lit(1)).alias("pcount"))
    counts.select(F.concat(F.lit("170718_JB_M2_P"), "plate"), well_name(), "pcount").write.option("sep", "\t").csv(path)
    return readers.scan_plate_reader(t.spark, path)


@query("scan_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_csv(t):
    path = fresh_path(t.spark, "csv")
    sinks.sink_csv(t.supplier, path)
    return readers.scan_csv(t.spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("scan_csv2", "SELECT 'S' || s_suppkey AS sample, s_acctbal AS value, s_nationkey::DOUBLE AS nation FROM supplier")
def scan_csv2(t):
    path = fresh_path(t.spark, "csv2")
    comma = t.supplier.select(
        F.concat(F.lit("﻿S"), "s_suppkey").alias("sample"),
        F.regexp_replace(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), r"\.", ",").alias("value"),
        F.col("s_nationkey").cast("string").alias("nation"),
    )
    sinks.sink_csv(comma, path, sep=";")
    return readers.scan_csv2(t.spark, path, ["sample", "value", "nation"], ["value", "nation"])


@query("scan_gene_sets", """
SELECT DISTINCT p_type AS gs_name, upper(replace(p_name, ' ', '_')) AS symbol FROM part""")
def scan_gene_sets(t):
    path = fresh_path(t.spark, "sets")
    sets = t.part.select("p_type", F.upper(F.regexp_replace("p_name", " ", "_")).alias("symbol")).distinct()
    head = t.part.select("p_type").distinct().select("p_type", F.explode(F.array(F.col("p_type"), F.lit("> a set of parts"))).alias("symbol"))
    rows = head.unionByName(sets).withColumn("file", F.col("p_type"))
    rows.select("file", "symbol").write.partitionBy("file").text(path)
    # the set's file name is its directory here: file=<set>/part-*.txt
    return readers.scan_gene_sets(t.spark, path, r"file=([^/]+)/")


@query("scan_many_files", """
SELECT s_nationkey::VARCHAR AS line, s_suppkey AS plate, s_acctbal AS value FROM supplier""")
def scan_many_files(t):
    path = fresh_path(t.spark, "many")
    t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("plate"), F.col("s_acctbal").alias("value")).write.partitionBy("k").option("header", True).csv(path)
    return readers.scan_many_files(t.spark, f"{path}/*", "plate long, value double", "line", r"k=(\d+)/")


@query("scan_vcf_lines", """
SELECT s_nationkey::VARCHAR AS sample, 'chr' || (s_suppkey % 22 + 1) AS chrom, s_suppkey AS pos FROM supplier""")
def scan_vcf_lines(t):
    path = fresh_path(t.spark, "vcf")
    body = t.supplier.select(
        F.col("s_nationkey").alias("k"),
        F.concat_ws("\t", F.concat(F.lit("chr"), F.col("s_suppkey") % 22 + 1), F.col("s_suppkey").cast("string"), F.lit("."), F.lit("A"), F.lit("T")).alias("value"),
    )
    head = t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("#CHROM\tPOS\tID\tREF\tALT").alias("value")).distinct()
    head.unionByName(body).write.partitionBy("k").text(path)
    lines = readers.scan_vcf_lines(t.spark, path, sample_pattern=r"k=([^/]+)/")
    return lines.select("sample", F.col("fields")[0].alias("chrom"), F.col("fields")[1].cast("long").alias("pos"))


@query("scan_columns_pushdown", """
SELECT l_suppkey AS plate, l_partkey AS part, l_tax AS tax FROM lineitem WHERE l_returnflag = 'N' AND l_discount >= 0.05""")
def scan_columns_pushdown(t):
    """Reads four columns; both conditions reach the Parquet scan."""
    return t.lineitem.where((F.col("l_returnflag") == "N") & (F.col("l_discount") >= 0.05)).select(
        F.col("l_suppkey").alias("plate"), F.col("l_partkey").alias("part"), F.col("l_tax").alias("tax"))


_STORES: dict[tuple[str, str], str] = {}


def _stored(t) -> str:
    """The objects as a feature store, written once per application and data folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORES:
        path = fresh_path(t.spark, "features")
        store.write_features(t.objects, path, ["uuid", "line", "plate", "well", "drug", "conc", "rep"], FEATURES)
        _STORES[key] = path
    return _STORES[key]


@query("combine_wells", """
SELECT l_suppkey AS plate, count(*) AS n_objects, count(DISTINCT l_partkey % 384) AS n_wells, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""")
def combine_wells(t):
    path = fresh_path(t.spark, "wells")
    rows = t.wells.select("plate", "well", F.array("quantity", "tax").alias("features"), F.array(F.lit("quantity"), F.lit("tax")).alias("names"))
    rows.write.parquet(path)
    plates = store.combine_wells(t.spark, path)
    cells = plates.groupBy("plate", "well").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("features")[0]).alias("q"))
    return cells.groupBy("plate").agg(F.sum("n").alias("n_objects"), F.count(F.lit(1)).alias("n_wells"), rnd(F.sum("q"), 2).alias("quantity"))


@query("load_wells", f"WITH {OBJ} SELECT uuid, well, quantity FROM obj WHERE plate = 7 AND well IN (1, 5, 9, 100, 200)")
def load_wells(t):
    return store.load_wells(t.spark, _stored(t), 7, [1, 5, 9, 100, 200]).select("uuid", "well", F.col("features")[0].alias("quantity"))


@query("load_line", f"WITH {OBJ} SELECT uuid, plate, tax FROM obj WHERE line = 3")
def load_line(t):
    return store.load_line(t.spark, _stored(t), 3).select("uuid", F.col("plate").cast("long").alias("plate"), F.col("features")[2].alias("tax"))


@query("load_plates", f"WITH {OBJ} SELECT uuid, plate, price FROM obj WHERE plate IN (1, 2, 5)")
def load_plates(t):
    return store.load_plates(t.spark, _stored(t), [1, 2, 5]).select("uuid", F.col("plate").cast("long").alias("plate"), F.col("features")[1].alias("price"))


@query("load_metadata", f"WITH {OBJ} SELECT uuid, line, plate, well, drug, conc, rep FROM obj WHERE line = 3")
def load_metadata(t):
    return store.load_metadata(t.spark, _stored(t), 3).withColumn("plate", F.col("plate").cast("long"))


@query("load_single_feature", f"WITH {OBJ} SELECT uuid, plate, price FROM obj")
def load_single_feature(t):
    return store.load_single_feature(t.spark, _stored(t), "price").select("uuid", F.col("plate").cast("long").alias("plate"), "price")


@query("sink_by_plate", "SELECT l_suppkey AS plate, count(*) AS n, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY 1")
def sink_by_plate(t):
    path = fresh_path(t.spark, "plates")
    sinks.sink_by_plate(t.wells.select("plate", "well", "tax"), path)
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("plate").cast("long").alias("plate")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("tax"), 4).alias("tax"))


@query("sink_drug_subset", f"WITH {OBJ} SELECT uuid, plate, price FROM obj WHERE drug = 'Brand#7'")
def sink_drug_subset(t):
    path = fresh_path(t.spark, "drug")
    sinks.sink_subset(t.objects.select("uuid", "plate", "drug", "price"), F.col("drug") == "Brand#7", path)
    return t.spark.read.parquet(path).select("uuid", "plate", "price")


@query("sink_csv", "SELECT p_brand AS drug, count(*) AS n, max(p_retailprice) AS price FROM part GROUP BY 1")
def sink_csv(t):
    path = fresh_path(t.spark, "report")
    sinks.sink_csv(t.part.groupBy(F.col("p_brand").alias("drug")).agg(F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("price")), path)
    return readers.scan_csv(t.spark, path, "drug string, n long, price double")
