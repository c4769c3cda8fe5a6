"""The plans have the shape meant for large inputs."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetwear.catalog import QUERIES
from fleetwear.operators.dedup import dedup
from fleetwear.plans.features import usage_daily
from fleetwear.catalog.roles import Tables, usage

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


def test_dedup_keeps_one_row_per_key_before_the_shuffle(tables):
    text = plan(dedup(tables.lineitem, ["l_orderkey"], [F.col("l_shipdate").desc()]))
    assert "WindowGroupLimit" in text
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


@pytest.mark.parametrize(("key", "shuffles"), [("asof_usage", 2), ("asof_features", 4), ("weekly_features", 4)])
def test_features_shuffle_once_per_rollup_and_once_by_device(spark, key, shuffles):
    text = plan(entry.queries()[key](spark, FOLDER))
    assert exchanges(text) == shuffles
    assert "Join" not in text and "CartesianProduct" not in text


def test_asof_filter_reaches_the_scan(spark):
    text = plan(entry.queries()["asof_usage"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", text)
    assert "l_orderkey" not in re.search(r"ReadSchema: .*", text).group(0)


def test_rollup_aggregates_before_the_shuffle(tables):
    text = plan(usage_daily(usage(tables)))
    assert text.index("Exchange") < text.index("partial_sum")


def test_newest_values_are_hashed(spark, tables):
    for df in (usage_daily(usage(tables)), QUERIES["latest_value"](spark, FOLDER)):
        assert "SortAggregate" not in plan(df)
    for key in ("status_daily", "asof_features", "weekly_features", "features_backfill"):
        assert "SortAggregate" not in plan(QUERIES[key](spark, FOLDER))


@pytest.mark.parametrize("key", sorted(set(QUERIES) - {
    "lr_scores", "lr_gradient", "gbt_scores", "model_facts", "top_importance", "risk_surface", "model_comparison", "cv_auc", "cv_auc_gbt",
    "scan_envelope", "scan_paged", "scan_jsonl_malformed", "scan_partitions", "scan_date_window",
    "sink_dynamic_overwrite", "sink_rebuild", "sink_merge", "sink_merge_moved", "load_report", "lines_dropped", "loads_missed",
    "features_refresh", "gbt_replay", "gbt_trees", "gbt_importance", "risk_replay", "comparison_check", "cv_rows", "cv_fold_areas",
}))
def test_no_cross_join_and_no_python(spark, key):
    text = plan(entry.queries()[key](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("write", ["envelopes", "paged"])
def test_records_are_gathered_into_documents_after_they_are_dealt_out(spark, monkeypatch, write):
    """A map task holds no documents, and records are shuffled once."""
    from fleetwear.catalog import storage

    seen = []
    monkeypatch.setattr(storage, "_write_documents", lambda docs, path: seen.append(docs))
    records = spark.range(2500).select(F.col("id").cast("string"))
    storage.write_envelopes(records, "x") if write == "envelopes" else storage.write_paged(records, "x", "items")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "ObjectHashAggregate" not in plan[plan.index("Exchange"):]
    found = seen[0].select(F.explode("data").alias("x"))
    found = found.select("x.id") if write == "envelopes" else found.select(F.explode("x.items").alias("r")).select("r.id")
    assert sorted(int(r[0]) for r in found.collect()) == list(range(2500))


def test_a_boosting_query_stages_its_matrix_once(spark, monkeypatch):
    from fleetwear.catalog import modelling

    staged, build = [], modelling._matrix
    monkeypatch.setattr(modelling, "_models", {})
    monkeypatch.setattr(modelling, "_matrix", lambda t: staged.append(t) or build(t))
    monkeypatch.setattr(modelling, "_fit_gbt", lambda train: None)
    monkeypatch.setattr(modelling.models, "risk_surface", lambda fitted, rows, keys: rows)
    QUERIES["risk_surface"](spark, FOLDER)
    assert len(staged) == 1


@pytest.mark.parametrize("key", ["class_balance", "positive_rate"])
def test_label_queries_read_and_window_only_what_a_label_needs(spark, key):
    text = plan(entry.queries()[key](spark, FOLDER))
    assert "events.parquet" not in text and "l_discount" not in text
    # A mission day changes three windows' ends: the week itself, 1 and 91 days on.
    assert not re.search(r"31 AS shift|8 AS shift", text)


def test_columns_asked_for_are_those_of_the_whole_table(spark, tables):
    from fleetwear.catalog.features import FIRST, LAST, all_inputs
    from fleetwear.plans.features import KEYS, LABEL, weekly_features

    every = weekly_features(all_inputs(tables), FIRST, LAST)
    for chosen in ([LABEL], ["avg_completion_7d", "brush_residual_last"], ["days_since_last_failure", "battery_health_last", "area_90d"]):
        some = weekly_features(all_inputs(tables), FIRST, LAST, columns=[*KEYS, *chosen])
        assert some.columns == [*KEYS, *chosen]
        assert sorted(map(repr, some.collect())) == sorted(map(repr, every.select(*some.columns).collect()))


def test_split_and_folds_build_the_labels_once(spark, monkeypatch):
    from fleetwear.catalog import modelling

    staged = []
    monkeypatch.setattr(modelling, "stage", lambda df, name: staged.append(df.columns) or df.limit(50).cache())
    QUERIES["temporal_split"](spark, FOLDER)
    QUERIES["stratified_folds"](spark, FOLDER)
    assert staged == [["serial_number", "feature_date", "has_failure_next_30d"]] * 2
