from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from platewise.operators import completeness as C
from platewise.operators import keys as K
from platewise.sources import feature_store as store
from platewise.sources import readers, sinks
from platewise.streaming import completeness as S


def test_plate_reader_and_csv2(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("170718_JB_M2_D021T01P008L08\tA01\t2334\n170718_JB_M2_D021T01P008L08\tP24\t17\n")
    rows = readers.scan_plate_reader(spark, str(tmp_path / "a.TXT")).orderBy("well").collect()
    assert [(r.well, r.pcount) for r in rows] == [("A01", 2334), ("P24", 17)]
    (tmp_path / "b.csv").write_text("﻿Line;OddsRatio\nD007T01;60,5\nD007T01;Inf\n﻿D1;x\n", encoding="utf-8")
    got = readers.scan_csv2(spark, str(tmp_path / "b.csv"), ["Line", "OddsRatio"], ["OddsRatio"]).collect()
    assert [r.OddsRatio for r in got] == [60.5, float("inf"), None] and got[2].Line == "D1"


def test_gene_sets(spark, tmp_path):
    (tmp_path / "SET_A.txt").write_text("SET_A\n> made up\nTP53\nKRAS\n\n")
    got = readers.scan_gene_sets(spark, str(tmp_path / "*.txt")).collect()
    assert sorted((r.gs_name, r.symbol) for r in got) == [("SET_A", "KRAS"), ("SET_A", "TP53")]


def test_vcf_lines(spark, tmp_path):
    (tmp_path / "P004T_mutect2.vcf").write_text("##x\n#CHROM\tPOS\nchr1\t5\t.\tA\tT\n")
    r = readers.scan_vcf_lines(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0]["sample"] == "P004T" and r[0].fields[1] == "5"


def test_store_never_overwrites_and_checks_names(spark, tmp_path):
    df = spark.createDataFrame([("L1", 1, "A01", 1.0, 2.0), ("L1", 2, "A02", 3.0, 4.0)], "line string, plate int, well string, x double, y double")
    p = str(tmp_path / "store")
    store.write_features(df, p, ["line", "plate", "well"], ["x", "y"])
    with pytest.raises(Exception, match="exists"):
        store.write_features(df, p, ["line", "plate", "well"], ["x", "y"])
    assert store.load_single_feature(spark, p, "y").orderBy("plate").first().y == 2.0
    with pytest.raises(ValueError, match="unknown"):
        store.load_single_feature(spark, p, "z")
    plan = store.load_plates(spark, p, [2]).select("well")._jdf.queryExecution().executedPlan().toString()
    assert "(plate#" in plan.split("PartitionFilters")[1].split("]")[0] and "features" not in plan.split("ReadSchema")[1]


def test_combine_wells_rejects_other_names(spark, tmp_path):
    ok = spark.createDataFrame([(1, "A01", [1.0], ["x"]), (1, "A02", [2.0], ["x"])], "plate int, well string, features array<double>, names array<string>")
    ok.write.parquet(str(tmp_path / "ok"))
    assert store.combine_wells(spark, str(tmp_path / "ok")).count() == 2
    ok.withColumn("names", F.when(F.col("well") == "A01", F.array(F.lit("q"))).otherwise(F.col("names"))).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="different features"):
        store.combine_wells(spark, str(tmp_path / "bad")).collect()


def test_hot_plate_is_written_by_many_tasks(spark):
    df = spark.range(1000).withColumn("plate", F.when(F.col("id") < 900, 1).otherwise(F.col("id")))
    spread = store.spread_by(df, ["plate"], rows_per_file=100)
    assert spread.count() == 1000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = store.spread_by(df, ["plate"], rows_per_file=100).where("plate = 1").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1


def test_many_plates_share_files_whose_number_follows_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PLATE_FOLDERS", 50)
    df = spark.range(3000).select((F.col("id") % 2).cast("int").alias("line"), (F.col("id") % 600).alias("plate"), F.col("id").alias("uuid"), F.rand(1).alias("x"))
    p = tmp_path / "many"
    store.write_features(df, str(p), ["line", "plate", "uuid"], ["x"])
    assert len(list(p.glob("data/**/*.parquet"))) <= 8  # one for each plate before
    assert store.load_features(spark, str(p)).columns == ["uuid", "features", "line", "plate"]
    assert store.load_features(spark, str(p)).count() == 3000
    assert sorted(r.uuid for r in store.load_plates(spark, str(p), [7]).collect()) == [7, 607, 1207, 1807, 2407]
    sinks.sink_by_plate(df.drop("line"), str(tmp_path / "sink"))
    assert len(list((tmp_path / "sink").glob("**/*.parquet"))) <= 8
    back = spark.read.parquet(str(tmp_path / "sink"))
    assert back.count() == 3000 and back.select("plate").distinct().count() == 600


def test_species_error(spark):
    with pytest.raises(Exception, match="unknown species"):
        spark.createDataFrame([("X1",)], "p string").select(K.species_of("p")).collect()


def test_null_concentration_label(spark):
    df = spark.createDataFrame([("A", 0.2), ("A", None), ("DMSO", 0.2)], "drug string, conc double")
    assert [r.l for r in df.select(K.drug_conc_label("drug", "conc").alias("l")).collect()] == ["A__0.2", "A", "DMSO"]


def test_well_grid_formats(spark):
    assert C.well_grid(spark, 96).count() == 96
    names = [r.name for r in C.well_grid(spark, 1536).collect()]
    assert len(set(names)) == 1536 and names[0] == "AA01" and names[-1] == "BF48"
    with pytest.raises(ValueError):
        C.well_grid(spark, 100)


def test_stream_emits_once_and_reports_late_plates(spark, tmp_path):
    src, t0 = str(tmp_path / "in"), datetime(2024, 1, 1)
    schema = "plate long, well long, ts timestamp"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    put([(1, w, t0) for w in range(3)] + [(2, 0, t0)])
    put([(1, 3, t0 + timedelta(minutes=1)), (1, 3, t0 + timedelta(minutes=1))])
    put([(1, w, t0 + timedelta(minutes=2)) for w in range(4)])  # sent again: stays silent
    put([(3, 0, t0 + timedelta(days=3))])
    put([(3, 1, t0 + timedelta(days=6))])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = S.run_to_table(S.plate_completeness(stream, 4), spark, "t").collect()
    got = sorted((r.plate, r.n_wells, r.status) for r in out)
    assert got.count((1, 4, "complete")) == 1
    assert (2, 1, "late") in got and not [g for g in got if g[0] == 1 and g[2] != "complete"]


def test_sink_csv_single_file(spark, tmp_path):
    sinks.sink_csv(spark.range(10), str(tmp_path / "o"), single_file=True)
    assert len(list((tmp_path / "o").glob("part-*.csv"))) == 1
