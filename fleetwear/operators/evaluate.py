"""Exact binary classification metrics as aggregations.

Every function takes a score column and a 0/1 label column. Scores are first
counted per distinct value; ranks and curves come from running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.functions import ratio
from fleetwear.operators.ordered import running_totals, value_counts

# Minutes lost per missed failure and per needless check.
COST_MISS = 239
COST_CHECK = 60
# Range and number of the thresholds tried.
LOWEST, HIGHEST, STEPS = 0.1, 0.9, 50


def _ranked(df: DataFrame, score: str, label: str, descending: bool, by: Sequence[str] = ()) -> DataFrame:
    positive = F.coalesce(F.col(label) == 1, F.lit(False)).cast("long")
    counts = value_counts(df, F.col(score), by, pos=positive, neg=F.lit(1) - positive)
    return running_totals(counts, ["pos", "neg"], by, descending=descending)


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, per group of ``by``; ties count half."""
    ranked = _ranked(df, score, label, False, by)
    below = (F.col("cum_neg") - F.col("neg")).cast("double")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0)))
    return ranked.groupBy(*by).agg(
        F.try_divide(wins, F.max("all_pos").cast("double") * F.max("all_neg")).alias("roc_auc")
    )


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum of precision times recall gained, over the distinct scores."""
    ranked = _ranked(df, score, label, descending=True)
    precision = ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    gained = ratio(F.col("pos"), F.col("all_pos"))
    return ranked.agg(F.sum(precision * gained).alias("average_precision"))


def ranking_summary(df: DataFrame, score: str, label: str) -> DataFrame:
    """``roc_auc`` and ``average_precision`` from one ranking."""
    ranked = _ranked(df, score, label, descending=True)
    below = (F.col("all_neg") - F.col("cum_neg")).cast("double")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0)))
    precision = ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return ranked.agg(
        F.try_divide(wins, F.max("all_pos").cast("double") * F.max("all_neg")).alias("roc_auc"),
        F.sum(precision * ratio(F.col("pos"), F.col("all_pos"))).alias("average_precision"),
    )


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """A point per distinct score, and the origin (threshold null)."""
    points = _ranked(df, score, label, descending=True).select(
        F.col("value").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """A point per distinct score with the base rate; end point threshold null."""
    flagged = F.col("cum_pos") + F.col("cum_neg")
    points = _ranked(df, score, label, descending=True).select(
        F.col("value").alias("threshold"),
        ratio(F.col("cum_pos"), flagged).alias("precision"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
        ratio(F.col("all_pos"), F.col("all_pos") + F.col("all_neg")).alias("base_rate"),
    )
    end = df.where(F.col(score).isNotNull()).agg(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        ratio(F.sum((F.col(label) == 1).cast("long")), F.count(F.lit(1))).alias("base_rate"),
    )
    return points.unionByName(end)


def _cells(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row: tn, fp, fn, tp for predictions ``score > threshold``."""
    predicted = F.col(score) > threshold
    actual = F.col(label) == 1
    return df.where(F.col(score).isNotNull()).agg(
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(actual & predicted).alias("tp"),
    )


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Counts over the full 2 x 2 domain."""
    cells = [
        F.struct(F.lit(a).alias("label"), F.lit(p).alias("predicted"), F.col(name).alias("n"))
        for a, p, name in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ]
    return _cells(df, score, label, threshold).select(F.inline(F.array(*cells)))


def _or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _or_zero(precision * recall * 2, precision + recall)


def classification_report(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support: both classes, accuracy, averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    row = _cells(df, score, label, threshold)
    row = row.withColumns({
        "p0": _or_zero(tn, tn + fn), "r0": _or_zero(tn, tn + fp), "s0": tn + fp,
        "p1": _or_zero(tp, tp + fp), "r1": _or_zero(tp, tp + fn), "s1": tp + fn,
    })
    row = row.withColumns({
        "f0": _f1(F.col("p0"), F.col("r0")),
        "f1": _f1(F.col("p1"), F.col("r1")),
        "n": F.col("s0") + F.col("s1"),
    })

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.alias("support"),
        )

    def macro(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / F.lit(2.0)

    def weighted(m: str) -> Column:
        total = F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1")
        return _or_zero(total, F.col("n"))

    none = F.lit(None).cast("double")
    lines = [
        *[line(str(i), F.col(f"p{i}"), F.col(f"r{i}"), F.col(f"f{i}"), F.col(f"s{i}")) for i in (0, 1)],
        line("accuracy", none, none, _or_zero(tn + tp, F.col("n")), F.col("n")),
        line("macro avg", macro("p"), macro("r"), macro("f"), F.col("n")),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("n")),
    ]
    return row.select(F.inline(F.array(*lines)))


def threshold_grid(lo: float = LOWEST, hi: float = HIGHEST, n: int = STEPS) -> list[float]:
    """``n`` evenly spaced thresholds, both ends included exactly."""
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [hi]


def threshold_sweep(
    df: DataFrame,
    score: str,
    label: str,
    lo: float = LOWEST,
    hi: float = HIGHEST,
    n: int = STEPS,
    cost_miss: int = COST_MISS,
    cost_check: int = COST_CHECK,
) -> DataFrame:
    """Quality and net minutes saved when flagging ``score >= threshold``.

    Each row is counted once under the number of thresholds it reaches; the
    rest works on those ``n + 1`` counts.
    """
    grid = threshold_grid(lo, hi, n)
    p = F.col(score)
    values = F.array(*[F.lit(t) for t in grid])
    guess = F.floor((p - lo) / F.lit((hi - lo) / (n - 1)))
    guess = F.greatest(F.least(guess, F.lit(n - 1)), F.lit(0)).cast("int")

    def at(i: Column) -> Column:
        return F.get(values, i)

    # The division can be off by one step; the exact thresholds settle it.
    up = F.coalesce(p >= at(guess + 1), F.lit(False)).cast("int")
    down = (p < at(guess)).cast("int")
    reached = guess + 1 + up - down
    positive = (F.col(label) == 1).cast("long")
    counts = (
        df.where(p.isNotNull())
        .groupBy(reached.alias("reached"))
        .agg(F.sum(positive).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    spark = df.sparkSession
    steps = spark.range(n + 1).select(F.col("id").cast("int").alias("reached"))
    full = steps.join(counts, "reached", "left").na.fill(0, ["pos", "n"])
    # n + 1 rows in all from here on.
    all_rows = Window.partitionBy(F.lit(0))
    upward = all_rows.orderBy(F.desc("reached"))
    full = full.select(
        "reached",
        F.sum("pos").over(upward).alias("tp"),
        F.sum(F.col("n") - F.col("pos")).over(upward).alias("fp"),
        F.sum("pos").over(all_rows).alias("p"),
        F.sum("n").over(all_rows).alias("total"),
    ).where("reached > 0")
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("p") - tp
    precision, recall = _or_zero(tp, tp + fp), _or_zero(tp, F.col("p"))
    return full.select(
        at(F.col("reached") - 1).alias("threshold"),
        "tp",
        "fp",
        fn.alias("fn"),
        (F.col("total") - F.col("p") - fp).alias("tn"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        (tp * cost_miss - fp * cost_check - fn * cost_miss).alias("net_saving"),
    )


def best_threshold(
    sweep: DataFrame, cost_miss: int = COST_MISS, cost_check: int = COST_CHECK
) -> DataFrame:
    """The lowest threshold with the largest saving, and what it means in hours."""
    best = sweep.orderBy(F.desc("net_saving"), "threshold").limit(1)

    def hours(minutes: Column) -> Column:
        return minutes / F.lit(60.0)

    return best.select(
        "threshold", "tp", "fp", "fn", "tn", "net_saving",
        hours(F.col("tp") * cost_miss).alias("prevented_h"),
        hours(F.col("fp") * cost_check).alias("checks_h"),
        hours(F.col("fn") * cost_miss).alias("missed_h"),
        hours(F.col("net_saving")).alias("net_h"),
    )


def held_out_threshold(
    valid: DataFrame, test: DataFrame, score: str, label: str, cost_miss: int = COST_MISS, cost_check: int = COST_CHECK
) -> DataFrame:
    """The best threshold of ``valid``, what it saves there (``valid_saving``), and what it does on ``test``."""
    chosen = threshold_sweep(valid, score, label, cost_miss=cost_miss, cost_check=cost_check)
    best = best_threshold(chosen, cost_miss, cost_check).agg(
        F.struct(F.first("threshold").alias("threshold"), F.first("net_saving").alias("net_saving"))
    ).scalar()
    flagged, failed = F.col(score) >= best["threshold"], F.col(label) == 1

    def n(c: Column) -> Column:
        return F.count_if(c)

    cells = test.where(F.col(score).isNotNull()).agg(
        n(flagged & failed).alias("tp"), n(flagged & ~failed).alias("fp"), n(~flagged & failed).alias("fn"), n(~flagged & ~failed).alias("tn")
    )
    saved = F.col("tp") * cost_miss - F.col("fp") * cost_check - F.col("fn") * cost_miss
    return cells.select(
        best["threshold"].alias("threshold"), best["net_saving"].alias("valid_saving"), "tp", "fp", "fn", "tn",
        saved.alias("net_saving"), (saved / F.lit(60.0)).alias("net_h"),
    )
