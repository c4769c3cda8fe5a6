"""Failure classifiers on the feature table, with Spark ML.

Preparation (exact medians, population scaling) is that of ``prepare``, fitted
on the training rows of each fit. The filled rows are persisted in as many
partitions as their number asks for: iterations are many small jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fleetwear.operators import boosting, prepare
from fleetwear.operators.distribution import cut_points
from fleetwear.operators.evaluate import ranking_summary, roc_auc
from fleetwear.session import python_workers, scratch_path, stage

SEED = 42
# Boosting rounds, depth, step, leaf size, row sample.
ROUNDS, DEPTH, STEP, LEAF, SAMPLE = 200, 3, 0.05, 5, 0.8
MAX_ITER = 1000
TOLERANCE = 1e-8
ROWS_A_PARTITION = 100_000
ROWS_AT_ONCE = 50_000_000  # of fits that run side by side
PACKED_AT_ONCE = 400_000_000  # the same of boosted trees, whose rows are some 21 bytes each
BINS = 32  # of a column when trees are grown

WEIGHT = "class_weight"


@dataclass(frozen=True)
class Fitted:
    """A model with the preparation it was fitted on."""

    model: Model
    columns: tuple[str, ...]
    fills: dict[str, float]
    scaling: dict[str, tuple[float, float]] | None = None

    def inputs(self, df: DataFrame) -> DataFrame:
        """``df`` with its model columns filled (and scaled), and the vector ``features``."""
        return _vectors(_prepared(df, self.fills, self.scaling), self.columns)


def _prepared(df: DataFrame, fills: dict, scaling: dict | None) -> DataFrame:
    filled = prepare.impute(df, fills)
    return filled if scaling is None else prepare.standardize(filled, scaling)


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight rows so that both classes count the same in total."""
    sizes = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"))).scalar()
    own = F.when(F.col(label) == 1, sizes["p"]).otherwise(sizes["n"] - sizes["p"])
    return df.withColumn(WEIGHT, F.try_divide(sizes["n"].cast("double"), own * 2.0))


def _held(df: DataFrame, rows: int) -> DataFrame:
    """Persisted in partitions of a useful size, on disk: a fit reads it a few times and holds its own form of it in memory."""
    return df.coalesce(max(1, -(-rows // ROWS_A_PARTITION))).persist(StorageLevel.DISK_ONLY)


def fit_lr(train: DataFrame, cols: Sequence[str], label: str) -> Fitted:
    """Impute, scale, logistic regression with balanced classes. The weights sum
    up to the row count, so unit penalty on the summed loss is 1 / rows on
    Spark's averaged loss."""
    rows = train.count()
    fills = prepare.fit_medians(train, cols)
    scaling = prepare.fit_scaling(prepare.impute(train, fills), cols)
    ready = _held(_vectors(with_class_weight(_prepared(train, fills, scaling), label), cols).select("features", label, WEIGHT), rows)
    clf = LogisticRegression(
        labelCol=label, weightCol=WEIGHT, maxIter=MAX_ITER, tol=TOLERANCE, regParam=1.0 / max(rows, 1),
        elasticNetParam=0.0, standardization=False,
    )
    try:
        return Fitted(clf.fit(ready), tuple(cols), fills, scaling)
    finally:
        ready.unpersist()


def fit_gbt(train: DataFrame, cols: Sequence[str], label: str, rounds: int = ROUNDS) -> Fitted:
    """Impute, boosted trees."""
    found, cuts = cut_points(train, cols, BINS)
    fills = {c: found.get(c) or 0.0 for c in cols}
    told = boosting.Settings(rounds, DEPTH, STEP, LEAF, SAMPLE, SEED)
    trees = boosting.grow(prepare.impute(train, fills), cols, label, cuts, train.count(), told)
    return Fitted(boosting.as_model(trees, cols, label, cuts, told, train.sparkSession), tuple(cols), fills)


def score(fitted: Fitted, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (probability of failure) and the 0/1 ``predicted``; model columns are shown filled."""
    filled = prepare.impute(df, fitted.fills)
    shown = filled.withColumns({f"_shown_{c}": F.col(c) for c in fitted.columns})
    ready = shown if fitted.scaling is None else prepare.standardize(shown, fitted.scaling)
    p = vector_to_array("probability")[1]
    kept = [F.col(f"_shown_{c}").alias(c) if c in fitted.columns else F.col(c) for c in df.columns]
    scored = fitted.model.transform(_vectors(ready, fitted.columns))
    return scored.select(*kept, p.alias("score"), (p > threshold).cast("int").alias("predicted"))


def gradient(fitted: Fitted, train: DataFrame, label: str) -> DataFrame:
    """(column_name, gradient) of the penalised loss at the fitted coefficients: zero at the optimum.

    The intercept, which is not penalised, is ``(intercept)``.
    """
    rows = train.count()
    ready = with_class_weight(_prepared(train, fitted.fills, fitted.scaling), label)
    linear = F.lit(float(fitted.model.intercept))
    weights = dict(zip(fitted.columns, (float(w) for w in fitted.model.coefficients), strict=True))
    for c, w in weights.items():
        linear = linear + F.lit(w) * F.col(c)
    miss = (1 / (1 + F.exp(-linear)) - F.col(label)) * F.col(WEIGHT) / F.lit(float(rows))
    missed = ready.withColumn("_miss", miss)
    sums = missed.agg(
        F.sum("_miss").alias("(intercept)"),
        *[(F.sum(F.col("_miss") * F.col(c)) + F.lit(w / rows)).alias(c) for c, w in weights.items()],
    )
    names = ["(intercept)", *weights]
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("gradient")) for c in names]
    return sums.select(F.inline(F.array(*cells)))


def out_of_fold(
    fit, folded: DataFrame, label: str, keys: Sequence[str] = (), k: int = 5, at_once: int | None = None
) -> DataFrame:
    """Rows (keys, label, fold, score), staged: one score a row, by a model that was fitted without its fold.

    ``fit`` is called once a fold with the rows of the others, so preparation,
    class weights and penalty too come from rows that the model scores none of.
    Fits run side by side while their rows together are few (``at_once``): each
    holds its own in memory, and many rows keep all cores busy with one fit. All
    folds are scored in one job.
    """
    def one(i: int) -> DataFrame:
        scored = score(fit(folded.where(F.col("fold") != i)), folded.where(F.col("fold") == i))
        return scored.select(*keys, label, "fold", "score")

    with ThreadPoolExecutor(max(1, min(k, (at_once or ROWS_AT_ONCE) // max(1, folded.count())))) as pool:
        parts = list(pool.map(inheritable_thread_target(folded.sparkSession)(one), range(k)))
    return stage(reduce(DataFrame.unionByName, parts), "out-of-fold")


def fold_areas(scored: DataFrame, label: str) -> DataFrame:
    """(fold, roc_auc) of the scores of ``out_of_fold``, all folds in one ranking; no area for a fold of one class."""
    return roc_auc(scored, "score", label, by=["fold"])


def cross_validate(fit, folded: DataFrame, label: str, k: int = 5, at_once: int | None = None) -> tuple[float, float]:
    """(mean, population deviation) of the exact AUC over ``fold``, from the scores out of fold."""
    areas = fold_areas(out_of_fold(fit, folded, label, k=k, at_once=at_once), label)
    found = areas.agg(F.avg("roc_auc"), F.stddev_pop("roc_auc")).first()
    return found[0], found[1]


# ------------------------------------------------------- boosted trees as rows


def node_table(fitted: Fitted) -> DataFrame:
    """The trees as rows: tree, weight, node, column_name, threshold, left_node, right_node, prediction, gain, n.

    A leaf has no column. Read back from the stored form of the model: at most
    rounds x 2^(depth + 1) rows.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "boosted")
    fitted.model.write().save(path)
    node, split = F.col("nodeData"), F.col("nodeData.split")
    names = F.array(*map(F.lit, fitted.columns))
    inner = split["featureIndex"] >= 0
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"),
        F.when(inner, F.get(names, split["featureIndex"])).alias("column_name"),
        F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, node["leftChild"]).alias("left_node"), F.when(inner, node["rightChild"]).alias("right_node"),
        node["prediction"].alias("prediction"), F.when(inner, node["gain"]).alias("gain"), node["rawCount"].alias("n"),
    )
    weights = spark.createDataFrame(list(enumerate(map(float, fitted.model.treeWeights))), "tree int, weight double")
    return rows.join(F.broadcast(weights), "tree")  # a row a round


def _leaves(nodes: dict[int, Row], values: Mapping[str, np.ndarray], at: int = 0) -> np.ndarray | float:
    """What one tree says of each row; a null is on the right of every threshold."""
    n = nodes[at]
    if n["column_name"] is None:
        return n["prediction"]
    left, right = (_leaves(nodes, values, n[side]) for side in ("left_node", "right_node"))
    return np.where(values[n["column_name"]] <= n["threshold"], left, right)


def replay(nodes: DataFrame, filled: DataFrame, out: str = "replayed") -> DataFrame:
    """Add the probability that the node table gives to rows with filled columns.

    The trees are followed for a batch of rows at a time; the model itself is
    not asked. The margin is the weighted sum of the leaves, the probability its
    logistic of twice the margin.
    """
    trees: dict[int, dict[int, Row]] = {}
    for r in nodes.collect():  # bounded by rounds and depth
        trees.setdefault(r["tree"], {})[r["node"]] = r
    weighted = [(t[0]["weight"], t) for _, t in sorted(trees.items())]
    used = sorted({n["column_name"] for _, t in weighted for n in t.values()} - {None})
    python_workers(filled.sparkSession)

    @F.arrow_udf("double")
    def margin(*columns: pa.Array) -> pa.Array:
        values = {c: v.to_numpy(zero_copy_only=False) for c, v in zip(used, columns, strict=False)}
        total = np.zeros(len(columns[0]))
        for weight, tree in weighted:
            total += weight * _leaves(tree, values)
        return pa.array(total)

    asked = [F.col(c).cast("double") for c in used] or [F.lit(0.0)]
    return filled.withColumn(out, 1 / (1 + F.exp(-2 * margin(*asked))))


def importance_of(nodes: DataFrame) -> DataFrame:
    """(column_name, importance) from the gains in the node table, weighted by the rows split; the sum is 1."""
    gains = nodes.where(F.col("column_name").isNotNull()).groupBy("column_name").agg(F.sum(F.col("gain") * F.col("n")).alias("g"))
    total = gains.agg(F.sum("g")).scalar()
    return gains.select("column_name", (F.col("g") / total).alias("importance"))


def importance(fitted: Fitted) -> list[tuple[str, float]]:
    """(column, importance), strongest first."""
    weights = fitted.model.featureImportances.toArray()
    ranked = zip(fitted.columns, (float(w) for w in weights), strict=True)
    return sorted(ranked, key=lambda item: (-item[1], item[0]))


def compare(models: Mapping[str, Fitted], test: DataFrame, label: str) -> DataFrame:
    """Exact AUC and average precision of each model on the same rows, each scored once."""
    rows = None
    for name, fitted in models.items():
        one = ranking_summary(score(fitted, test), "score", label).withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def risk_surface(fitted: Fitted, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The two strongest features of each row, filled as the model saw them, beside its probability."""
    top = [name for name, _ in importance(fitted)[:2]]
    pairs = [
        c
        for i, name in enumerate(top, 1)
        for c in (F.lit(name).alias(f"feature_{i}"), F.col(name).cast("double").alias(f"value_{i}"))
    ]
    return score(fitted, df).select(*keys, *pairs, "score")
