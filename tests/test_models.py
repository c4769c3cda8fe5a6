"""Classifiers on separable data: better than chance, repeatable."""

import math

import pytest
from pyspark.sql import functions as F

from fleetwear.operators import models, prepare
from fleetwear.operators.evaluate import roc_auc

COLS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def matrix(spark):
    df = spark.range(2000).select(
        F.col("id"), F.rand(1).alias("x1"), F.rand(2).alias("x2"),
        F.when(F.rand(3) > 0.1, F.rand(4)).alias("x3"),
    )
    signal = F.col("x1") * 2 + F.col("x2") + F.rand(5) * 0.5
    return df.withColumn("label", (signal > 2.0).cast("int")).cache()


@pytest.fixture(scope="module")
def split(matrix):
    return matrix.where("id < 1500"), matrix.where("id >= 1500")


def auc(model, test):
    return roc_auc(models.score(model, test), "score", "label").first()[0]


def test_logistic_regression(split):
    train, test = split
    model = models.fit_lr(train, COLS, "label")
    assert auc(model, test) > 0.9
    scored = models.score(model, test)
    assert scored.where("predicted <> cast(score > 0.5 as int)").isEmpty()


def test_boosting_and_importance(split):
    train, test = split
    model = models.fit_gbt(train, COLS, "label", rounds=10)
    assert auc(model, test) > 0.9
    ranked = models.importance(model)
    assert ranked[0][0] == "x1" and sum(w for _, w in ranked) == pytest.approx(1.0)
    surface = models.risk_surface(model, test, ["id"])
    assert surface.columns == ["id", "feature_1", "value_1", "feature_2", "value_2", "score"]
    again = models.fit_gbt(train, COLS, "label", rounds=10)
    assert auc(model, test) == auc(again, test)


def test_class_weights_balance(matrix):
    weighted = models.with_class_weight(matrix, "label")
    sums = {r.label: r.w for r in weighted.groupBy("label").agg(F.sum("class_weight").alias("w")).collect()}
    assert sums[0] == pytest.approx(sums[1])
    assert sums[0] + sums[1] == pytest.approx(2000)


def test_cross_validation(matrix):
    folded = prepare.stratified_folds(matrix, "label", ["id"], k=3).cache()
    mean, sd = models.cross_validate(lambda rows: models.fit_lr(rows, COLS, "label"), folded, "label", k=3)
    assert 0.9 < mean <= 1 and 0 <= sd < 0.1


def test_comparison(split):
    train, test = split
    fitted = {"lr": models.fit_lr(train, COLS, "label"), "gbt": models.fit_gbt(train, COLS, "label", 3)}
    rows = models.compare(fitted, test, "label").collect()
    assert {r.model for r in rows} == {"lr", "gbt"} and all(r.roc_auc > 0.8 for r in rows)


def test_gradient_vanishes_only_at_the_optimum(split):
    train, _ = split
    model = models.fit_lr(train, COLS, "label")
    assert all(abs(r.gradient) < 1e-6 for r in models.gradient(model, train, "label").collect())
    other = models.gradient(model, train.where("x1 < 0.8"), "label").collect()
    assert any(abs(r.gradient) > 1e-3 for r in other)


def test_scores_out_of_fold_come_from_models_that_have_not_seen_the_rows(matrix):
    folded = prepare.stratified_folds(matrix, "label", ["id"], k=3).cache()
    fits = []

    def fit(rows):
        fits.append({r["id"] for r in rows.select("id").collect()})
        return models.fit_lr(rows, COLS, "label")

    scored = models.out_of_fold(fit, folded, "label", ["id"], k=3).collect()
    assert sorted(r["id"] for r in scored) == list(range(2000))
    every = set(range(2000))
    held = {i: {r["id"] for r in scored if r["fold"] == i} for i in range(3)}
    assert sorted(map(sorted, fits)) == sorted(sorted(every - h) for h in held.values())


def test_fold_areas_equal_those_one_by_one(spark, matrix):
    rows = matrix.select("id", "label", F.round("x1", 1).alias("score"), (F.col("id") % 4).cast("int").alias("fold"))
    found = {r["fold"]: r["roc_auc"] for r in models.fold_areas(rows, "label").collect()}
    for i in range(4):
        assert found[i] == pytest.approx(roc_auc(rows.where(F.col("fold") == i), "score", "label").first()[0])
    one_class = rows.where("fold > 0 or label = 1")
    assert {r["fold"]: r["roc_auc"] for r in models.fold_areas(one_class, "label").collect()}[0] is None


def test_replay_follows_the_node_table(split):
    train, test = split
    fitted = models.fit_gbt(train, COLS, "label", rounds=7)
    nodes = models.node_table(fitted)
    scored = models.score(fitted, test).cache()

    def off(table):
        return models.replay(table, scored).agg(F.max(F.abs(F.col("score") - F.col("replayed")))).first()[0]

    assert off(nodes) < 1e-12
    # One leaf of one tree changed a little, or one threshold, is seen.
    leaf = nodes.where("tree = 3 and column_name is null").agg(F.min("node")).first()[0]
    changed = nodes.withColumn("prediction", F.when((F.col("tree") == 3) & (F.col("node") == leaf), F.col("prediction") + 0.01).otherwise(F.col("prediction")))
    assert off(changed) > 1e-6
    moved = nodes.withColumn("threshold", F.when((F.col("tree") == 0) & (F.col("node") == 0), F.col("threshold") * 0.8).otherwise(F.col("threshold")))
    assert off(moved) > 1e-6
    told = dict(models.importance(fitted))
    found = {r["column_name"]: r["importance"] for r in models.importance_of(nodes).collect()}
    assert all(found.get(c, 0.0) == pytest.approx(told[c], abs=1e-12) for c in COLS)
    assert {c for c, v in told.items() if v} == set(found)


def test_replay_of_odd_rows_and_trees(spark):
    """Nulls and NaN go right, whole numbers are compared as such, a tree may be a single leaf."""
    node = "tree int, weight double, node int, column_name string, threshold double, left_node int, right_node int, prediction double"
    table = spark.createDataFrame(
        [(0, 1.0, 0, "a", 2.0, 1, 2, 0.0), (0, 1.0, 1, None, None, None, None, -0.5), (0, 1.0, 2, "b", 0.5, 3, 4, 0.0),
         (0, 1.0, 3, None, None, None, None, 0.25), (0, 1.0, 4, None, None, None, None, 0.75), (1, 0.1, 0, None, None, None, None, 2.0)],
        node,
    )
    rows = spark.createDataFrame([(0, 2, 0.0), (1, 3, 0.5), (2, 3, 0.6), (3, None, 0.1), (4, 9, None), (5, 9, float("nan"))], "id int, a int, b double")
    replayed = models.replay(table, rows)
    assert "aggregate(" not in replayed._jdf.queryExecution().optimizedPlan().toString()  # interpreted row by row
    got = {r["id"]: r["replayed"] for r in replayed.collect()}
    leaf = [-0.5, 0.25, 0.75, 0.25, 0.75, 0.75]
    assert got == {i: pytest.approx(1 / (1 + math.exp(-2 * (v + 0.2)))) for i, v in enumerate(leaf)}
    alone = models.replay(table.where("tree = 1"), rows).collect()
    assert [r["replayed"] for r in alone] == [pytest.approx(1 / (1 + math.exp(-0.4)))] * 6


def test_rows_of_a_fit_are_held_on_disk_only(matrix):
    held = models._held(matrix, 2000)
    try:
        assert held.storageLevel.useDisk and not held.storageLevel.useMemory
    finally:
        held.unpersist()


def test_fits_of_many_rows_run_one_after_the_other(matrix, monkeypatch):
    folded = prepare.stratified_folds(matrix, "label", ["id"], k=3).cache()
    running, most = [], []

    def fit(rows):
        running.append(1)
        most.append(len(running))
        found = models.fit_lr(rows, COLS, "label")
        running.pop()
        return found

    monkeypatch.setattr(models, "ROWS_AT_ONCE", 3000)
    assert models.out_of_fold(fit, folded, "label", k=3).count() == 2000
    assert max(most) == 1
