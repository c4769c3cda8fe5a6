"""Trees grown from histograms against trees grown row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwear.operators import boosting, models
from fleetwear.operators.distribution import cut_points

COLS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(0, 3000, 1, 5).select(
        F.col("id"), F.rand(1).alias("x1"), F.floor(F.rand(2) * 4).cast("double").alias("x2"), F.rand(3).alias("x3"),
    )
    return df.withColumn("label", (F.col("x1") + F.col("x2") / 3 + F.rand(4) * 0.5 > 1.2).cast("int")).cache()


def plain(x, y, cuts, rounds, depth, step, leaf):
    margin, trees = np.zeros(len(y)), []
    for t in range(rounds):
        want = y if t == 0 else 4 * y / (1 + np.exp(2 * y * margin))
        nodes = []

        def split(at, level):
            here = want[at]
            best = (1e-9, None, None)
            for c in range(x.shape[1]):
                for cut in cuts[c]:
                    left = x[at, c] <= cut
                    n = left.sum()
                    if level < depth and min(n, len(at) - n) >= leaf:
                        gain = here.var() - (n * here[left].var() + (len(at) - n) * here[~left].var()) / len(at)
                        if gain > best[0] + 1e-12:
                            best = (gain, c, cut)
            nodes.append((best[1], best[2], len(at)))
            if best[1] is None:
                margin[at] += (step if t else 1) * here.mean()
            else:
                left = x[at, best[1]] <= best[2]
                split(at[left], level + 1)
                split(at[~left], level + 1)

        split(np.arange(len(y)), 0)
        trees.append(nodes)
    return trees, 1 / (1 + np.exp(-2 * margin))


def test_trees_are_those_grown_row_by_row(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 500)
    monkeypatch.setattr(boosting, "MERGE", 2)
    told = boosting.Settings(5, 3, 0.3, 20, 1.0, 1)
    _, cuts = cut_points(rows, COLS, 8)
    model = boosting.as_model(boosting.grow(rows, COLS, "label", cuts, 3000, told), COLS, "label", cuts, told, spark)
    fitted = models.Fitted(model, tuple(COLS), dict.fromkeys(COLS, 0.0))
    local = rows.orderBy("id").collect()
    x, y = np.array([[r[c] for c in COLS] for r in local]), np.array([2.0 * r["label"] - 1 for r in local])
    trees, scores = plain(x, y, [cuts[c] for c in COLS], 5, 3, 0.3, 20)
    found = models.node_table(fitted).orderBy("tree", "node").collect()
    for t, nodes in enumerate(trees):
        got = [(None if r["column_name"] is None else COLS.index(r["column_name"]), r["threshold"], r["n"]) for r in found if r["tree"] == t]
        assert got == nodes
    told_scores = [r["score"] for r in models.score(fitted, rows).orderBy("id").collect()]
    assert told_scores == pytest.approx(scores.tolist(), abs=1e-12)


def test_cut_points(spark):
    df = spark.range(1000).select(
        F.col("id").cast("double").alias("many"), (F.col("id") % 3).alias("few"), F.lit(7).alias("one"), F.lit(None).cast("double").alias("none")
    )
    middle, cuts = cut_points(df, ["many", "few", "one", "none"], 4)
    assert middle == {"many": 499.5, "few": 1.0, "one": 7.0}
    assert cuts == {"many": [249.75, 499.5, 749.25], "few": [0.5, 1.5], "one": [], "none": []}


def test_a_column_that_cannot_be_split_and_no_rows(rows):
    told = boosting.Settings(2, 3, 0.1, 5, 0.8, 1)
    same = rows.withColumns({c: F.lit(1.0) for c in COLS})
    trees = boosting.grow(same, COLS, "label", {c: [] for c in COLS}, 3000, told)
    assert [int(t.column.max()) for t in trees] == [-1, -1] and all(0 < t.n[0] < 3000 for t in trees)
    with pytest.raises(ValueError, match="no rows"):
        boosting.grow(rows.limit(0), COLS, "label", {c: [] for c in COLS}, 0, told)


def test_one_task_and_many_grow_the_same_trees(rows, monkeypatch):
    _, cuts = cut_points(rows, COLS, 8)
    told = boosting.Settings(4, 3, 0.3, 20, 0.7, 1)
    jobs = rows.sparkSession.sparkContext.statusTracker()
    rows.sparkSession.sparkContext.setJobGroup("alone", "")
    alone = boosting.grow(rows, COLS, "label", cuts, 3000, told)
    # One job for the trees, not one a level; the shuffle is a stage of it.
    assert len(jobs.getJobIdsForGroup("alone")) <= 2
    monkeypatch.setattr(boosting, "BLOCK", 500)
    monkeypatch.setattr(boosting, "MERGE", 3)
    monkeypatch.setattr(boosting, "ALONE", 0)
    rows.sparkSession.sparkContext.setJobGroup("many", "")
    many = boosting.grow(rows, COLS, "label", cuts, 3000, told)
    assert len(jobs.getJobIdsForGroup("many")) > 4 * 3
    for a, b in zip(alone, many, strict=True):
        assert a.column.tolist() == b.column.tolist() and a.bin.tolist() == b.bin.tolist() and a.n.tolist() == b.n.tolist()
        assert a.values() == pytest.approx(b.values(), abs=1e-12)


def test_trees_in_many_tasks_are_those_grown_row_by_row(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "ALONE", 0)
    test_trees_are_those_grown_row_by_row(spark, rows, monkeypatch)


def test_columns_share_keys():
    sizes = [7, 32, 1, 200, 32, 2, 32, 11]
    keys = boosting.Keys.of(sizes)
    assert len(keys.groups) == 3 and all(sum(keys.at[c][2] for c in g) <= boosting.KEY_BITS for g in keys.groups)
    rng = np.random.default_rng(1)
    bins = [rng.integers(0, n, 1000) for n in sizes]
    rows = keys.packed(bins, 1000)
    for c, own in enumerate(bins):
        assert all((keys.above(rows, c, at) == (own > at)).all() for at in range(sizes[c]))
    totals = boosting._Totals(keys)
    want = rng.random(1000)
    totals.add(rows, want)
    found = totals.per_column()
    for c, own in enumerate(bins):
        assert found[0, c, : sizes[c]].tolist() == np.bincount(own, minlength=sizes[c]).tolist()
        assert found[1, c, : sizes[c]] == pytest.approx(np.bincount(own, want, sizes[c]))


def test_equal_gains_go_to_the_first_column():
    counts = np.zeros((2, 2, 4))
    counts[0], counts[1] = 10, [[-3.0, 1.0, 4.0, -2.0], [-3.0, 1.0 + 1e-14, 4.0, -2.0]]
    assert boosting._best(counts, 1)[0] == 0
    assert boosting._best(counts[:, ::-1], 1)[0] == 0
