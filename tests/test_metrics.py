"""Ranking, quantiles and metrics against brute force."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwear.operators import correlation, distribution, evaluate, prepare
from fleetwear.operators.ordered import quantiles, running_totals, value_counts


def frame(spark, scores, labels):
    return spark.createDataFrame(list(zip(scores, labels, strict=True)), "score double, label int")


def scalar(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def sample():
    rnd = random.Random(3)
    scores = [round(rnd.random() ** 3, 3) for _ in range(3000)] + [0.5] * 1500
    labels = [int(rnd.random() < s) for s in scores]
    return scores, labels


def test_known_values(spark):
    df = frame(spark, [0.1, 0.4, 0.4, 0.8], [0, 0, 1, 1])
    assert scalar(evaluate.roc_auc(df, "score", "label")) == 0.875
    assert scalar(evaluate.average_precision(df, "score", "label")) == pytest.approx(5 / 6)


def test_auc_against_all_pairs(spark, sample):
    s, y = np.array(sample[0]), np.array(sample[1])
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    df = frame(spark, *sample)
    auc = scalar(evaluate.roc_auc(df, "score", "label"))
    assert auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    turned = scalar(evaluate.roc_auc(df.withColumn("score", -F.col("score")), "score", "label"))
    assert auc == pytest.approx(1 - turned, abs=1e-12)


def test_one_class_gives_null(spark):
    assert scalar(evaluate.roc_auc(frame(spark, [0.1, 0.2], [1, 1]), "score", "label")) is None


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [2, 16, 256])
def test_running_totals(spark, sample, descending, buckets):
    counts = value_counts(frame(spark, *sample), F.col("score"), n=F.lit(1), pos=F.col("label"))
    rows = running_totals(counts, ["n", "pos"], descending=descending, buckets=buckets).collect()
    rows.sort(key=lambda r: -r.value if descending else r.value)
    n = pos = 0
    for r in rows:
        n, pos = n + r.n, pos + r.pos
        assert (r.cum_n, r.cum_pos) == (n, pos)
    assert {r.all_n for r in rows} == {len(sample[0])}


def test_quantiles_by_group(spark):
    rnd = random.Random(5)
    rows = [(g, rnd.choice([rnd.random() * 100, 42.0])) for g in "abc" for _ in range(200 if g == "a" else 7)]
    df = spark.createDataFrame([*rows, ("d", None), (None, 3.0)], "g string, v double")
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = quantiles(value_counts(df, F.col("v"), ["g"]), points, ["a", "b", "c", "d", "e"], ["g"])
    got = {r.g: list(r)[1:] for r in found.collect()}
    for g in "abc":
        expected = np.percentile([v for k, v in rows if k == g], [p * 100 for p in points])
        assert got[g] == pytest.approx(list(expected), abs=1e-9)
    assert "d" not in got and got[None] == [3.0] * 5


def test_sweep_against_naive(spark, sample):
    s, y = np.array([*sample[0], *evaluate.threshold_grid()]), np.array([*sample[1], *([1, 0] * 25)])
    rows = evaluate.threshold_sweep(frame(spark, s.tolist(), y.tolist()), "score", "label").collect()
    grid = np.linspace(0.1, 0.9, 50)
    rows.sort(key=lambda r: r.threshold)
    assert [r.threshold for r in rows] == pytest.approx(list(grid), abs=1e-15)
    for r in rows:
        flagged = s >= r.threshold
        tp, fp = int((flagged & (y == 1)).sum()), int((flagged & (y == 0)).sum())
        fn = int((~flagged & (y == 1)).sum())
        assert (r.tp, r.fp, r.fn) == (tp, fp, fn)
        assert r.net_saving == 239 * tp - 60 * fp - 239 * fn


def test_sweep_outside_the_grid(spark):
    rows = evaluate.threshold_sweep(frame(spark, [-5.0, 1e12], [1, 0]), "score", "label").collect()
    assert {(r.tp, r.fp, r.fn, r.tn) for r in rows} == {(0, 1, 1, 0)}


def test_report_without_predictions(spark):
    rows = {r["class"]: r for r in evaluate.classification_report(frame(spark, [0.1, 0.2], [1, 0]), "score", "label").collect()}
    assert rows["1"].precision == 0.0 and rows["1"].recall == 0.0 and rows["accuracy"].f1 == 0.5


def test_histogram_against_numpy(spark, sample):
    df = frame(spark, *sample)
    rows = distribution.histogram(df, F.col("score"), 30).orderBy("bin").collect()
    n, edges = np.histogram(sample[0], bins=30)
    assert sum(r.n for r in rows) == len(sample[0])
    # numpy moves values on an edge by one bin where rounding differs.
    assert np.abs(np.cumsum([r.n for r in rows]) - np.cumsum(n)).max() <= 40
    assert [r.bin_lo for r in rows] == pytest.approx(list(edges[:-1]))


def test_histogram_of_one_value(spark):
    rows = distribution.histogram(frame(spark, [2.0, 2.0], [0, 0]), F.col("score"), 4).collect()
    assert sum(r.n for r in rows) == 2 and min(r.bin_lo for r in rows) == 1.5


def test_correlation(spark, sample):
    df = frame(spark, *sample).withColumn("constant", F.lit(1.0))
    r = scalar(correlation.corr_pair(df, "score", "label"))
    assert r == pytest.approx(np.corrcoef(*sample)[0, 1], abs=1e-12)
    assert scalar(correlation.corr_pair(df, "score", "constant")) is None


def test_box_summary_has_whiskers_inside_the_reach(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "g string, v int")
    row = distribution.box_summary(df, F.col("v"), "g").first()
    assert (row.q1, row.median, row.q3, row.whisker_lo, row.whisker_hi) == (3, 5, 7, 1, 8)


def test_folds_are_balanced(spark):
    df = spark.range(1003).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    folded = prepare.stratified_folds(df, "label", ["id"])
    sizes = folded.groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r.label == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert folded.select("id").distinct().count() == 1003
    again = prepare.stratified_folds(df.repartition(3), "label", ["id"])
    assert folded.exceptAll(again).isEmpty()


def test_split_keeps_the_last_dates(spark):
    df = spark.sql("select date'2026-01-05' + 7 * cast(id % 6 as int) as feature_date, id from range(60)")
    train, test = prepare.temporal_split(df)
    assert train.select("feature_date").distinct().count() == 2
    assert test.select("feature_date").distinct().count() == 4
    assert train.count() + test.count() == 60


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    fills = prepare.fit_medians(df, ["a", "b"])
    assert fills == {"a": 2.0, "b": 0.0}
    filled = prepare.impute(df, fills)
    scaling = prepare.fit_scaling(filled, ["a", "b"])
    assert scaling["b"] == (0.0, 1.0)
    assert [r.a for r in prepare.standardize(filled, scaling).orderBy("a").collect()] == pytest.approx(
        [-1.224744871, 0.0, 1.224744871]
    )


def test_postprocess(spark):
    df = spark.createDataFrame(
        [(None, 5, None, "AGING"), (1, None, 2, None)],
        "brush_residual_last int, filter_residual_last int, squeegee_residual_last int, battery_health_last string",
    )
    rows = {tuple(r) for r in prepare.postprocess(df).collect()}
    assert rows == {(100.0, 5.0, 100.0, 1), (1.0, 100.0, 2.0, 0)}


def test_box_keeps_null_groups_and_joins_by_piece(spark):
    from fleetwear.operators import distribution

    rows = [(g, v) for g, values in ((None, [1, 2, 3, 100]), ("a", [5] * 9 + [500]), ("b", [7])) for v in values]
    df = spark.createDataFrame(rows, "g string, v int")
    box = distribution.box_summary(df, F.col("v"), "g")
    found = {r["g"]: r for r in box.collect()}
    assert set(found) == {None, "a", "b"}
    assert (found[None]["n"], found[None]["median"], found[None]["whisker_hi"]) == (4, 2.5, 27.25)
    assert (found["a"]["whisker_lo"], found["a"]["whisker_hi"]) == (5.0, 5.0) and found["b"]["q3"] == 7.0
    plan = box._jdf.queryExecution().executedPlan().toString()
    for keys in re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[([^\]]*)\]", plan):
        assert "_piece" in keys


def test_three_way_split(spark):
    from fleetwear.operators import prepare

    days = [dt.date(2026, 1, d) for d in (1, 2, 3, 4, 5, 5, 6)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "feature_date date")
    found = {}
    for r in prepare.three_way_split(df, valid=2, test=1).collect():
        found.setdefault(r["part"], set()).add(r["feature_date"])
    assert found == {"test": {days[6]}, "valid": {days[4], days[3]}, "train": {days[0], days[1], days[2], None}}
    short = prepare.three_way_split(df.where("feature_date >= '2026-01-06'"), valid=2, test=3)
    assert [r["part"] for r in short.collect()] == ["test"]
    assert prepare.three_way_split(df.limit(0)).count() == 0


def test_labels_past_the_frontier_are_not_complete(spark):
    from fleetwear.operators import prepare

    df = spark.createDataFrame([(dt.date(2026, 1, 1),), (dt.date(2026, 1, 2),), (None,)], "feature_date date")
    source = spark.createDataFrame([(dt.datetime(2026, 1, 31, 23),), (dt.datetime(2025, 1, 1),)], "completed_at timestamp_ntz")
    found = prepare.with_label_complete(df, prepare.frontier(source, "completed_at")).collect()
    assert [r["label_complete"] for r in found] == [True, False, False]
    empty = prepare.frontier(source.limit(0), "completed_at")
    assert not any(r["label_complete"] for r in prepare.with_label_complete(df, empty).collect())


def test_threshold_is_chosen_without_the_test_rows(spark):
    from fleetwear.operators import evaluate

    rng = random.Random(4)
    rows = [(i, rng.random(), int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, score double, label int")
    valid, test = df.where("id < 200"), df.where("id >= 200")
    one = evaluate.held_out_threshold(valid, test, "score", "label").first()
    best = evaluate.best_threshold(evaluate.threshold_sweep(valid, "score", "label")).first()
    assert (one["threshold"], one["valid_saving"]) == (best["threshold"], best["net_saving"])
    flagged = [(s >= one["threshold"], y) for i, s, y in rows if i >= 200]
    assert (one["tp"], one["fp"]) == (flagged.count((True, 1)), flagged.count((True, 0)))
    assert one["net_saving"] == one["tp"] * 239 - one["fp"] * 60 - one["fn"] * 239
    other = evaluate.held_out_threshold(valid, test.withColumn("label", 1 - F.col("label")), "score", "label").first()
    assert other["threshold"] == one["threshold"]


def test_newest_text_by_code_and_without(spark, monkeypatch):
    from fleetwear.functions import columns
    from fleetwear.functions.columns import latest_part, newest_text

    rng = random.Random(5)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(rng.randrange(20), t0 + dt.timedelta(hours=rng.randrange(6)), rng.choice([None, "", "a", "B", "é", "日本", "aa"])) for _ in range(600)]
    rows += [(99, None, "x"), (98, t0, None)]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz, v string")
    for keep in (True, False):
        want = df.groupBy("k").agg(F.max(latest_part(F.col("at"), F.col("v"), keep))["value"].alias("v"))
        want = sorted(map(tuple, want.collect()))
        coded = df.groupBy("k").agg(newest_text(df, F.col("at"), "v", keep).alias("v"))
        assert sorted(map(tuple, coded.collect())) == want
        assert "SortAggregate" not in coded._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(columns.codes, "__defaults__", (3,))
    plain = df.groupBy("k").agg(newest_text(df, F.col("at"), "v", True).alias("v"))
    assert columns.codes(df, "v") is None
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, df.groupBy("k").agg(F.max(latest_part(F.col("at"), F.col("v"), True))["value"].alias("v")).collect()))


def test_medians_count_values_by_the_place_of_a_column(spark):
    from fleetwear.operators.distribution import medians

    df = spark.createDataFrame([(1.0, 4, None), (3.0, None, None), (8.0, 7, None)], "a double, `b c` int, d double")
    found = medians(df.withColumnRenamed("b c", "b"), ["b", "a", "d"])
    assert {r["column_name"]: r["median"] for r in found.collect()} == {"a": 3.0, "b": 5.5}
    assert "hashpartitioning(column_name" not in found._jdf.queryExecution().executedPlan().toString()
