"""The registry, plan shapes, and a sample of queries against DuckDB (all of them: tests/check.py)."""

import os

import pytest

import __spark_entry__ as entry
from check import DATA, compare, duck

SF = f"{DATA}/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

SAMPLE = [
    "control_ratio", "plate_effect_correct", "trimmed_robust_z", "blur_label", "well_median_mad", "lethality_degree", "complete_grid",
    "join_interval_count", "sample_per_group", "rank_transform", "corr_spearman", "cluster_label_enrichment", "permutation_test",
    "gsea_running_sum", "blur_choices", "preprocess_line_sharp", "drug_classifier_optimum", "bootstrap_moments", "dose_auc", "roc_curve", "factor_project", "vep_explode", "reconcile_tables", "plate_completeness_stream",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 220


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, duck(SF).execute(entry.oracle_sql()[name]).df()).startswith("ok")


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["uuid", "quantity", "price", "tax"] and df.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_scan_is_pruned_and_filtered(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(entry.queries()["scan_columns_pushdown"](spark, SF))
    assert "EqualTo(l_returnflag,N)" in p and "GreaterThanOrEqual(l_discount,0.05)" in p
    assert "l_extendedprice" not in p


@needs_data
@pytest.mark.parametrize("name", ["share_of_total", "join_cross_combos", "complete_grid", "missing_units", "angle_graph", "corr_matrix", "global_scale"])
def test_no_nested_loops(spark, name):
    df = entry.queries()[name](spark, SF)
    p = plan(df)
    assert "CartesianProduct" not in p and "NestedLoop" not in p


@needs_data
def test_group_aggregate_replaces_the_window(spark):
    assert "Window" not in plan(entry.queries()["share_of_total"](spark, SF))


@needs_data
def test_well_summaries_are_per_well_and_concentration(spark):
    keys = ["line", "plate", "rep", "well", "drug", "conc"]
    got = entry.queries()["well_mean_summaries"](spark, SF).toPandas()
    rows = duck(SF).execute("SELECT count(DISTINCT (l_suppkey, l_partkey % 384, l_linestatus, l_discount, p_brand)) FROM lineitem JOIN part ON l_partkey = p_partkey").fetchone()[0]
    assert set(keys) <= set(got.columns) and len(got) == rows and not got.duplicated(keys).any()
    assert compare(got, duck(SF).execute(entry.oracle_sql()["well_mean_summaries"]).df()).startswith("ok")
