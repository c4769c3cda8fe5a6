"""Feature table to model matrix: fill, split, impute, scale, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.operators.distribution import medians
from fleetwear.operators.ordered import running_totals
from fleetwear.plans.features import HORIZON

FULL = 100.0  # fixed value: residual of a part nothing is known about
AGING = "AGING"
RESIDUALS = ("brush_residual_last", "filter_residual_last", "squeegee_residual_last")
LAST_DATES = 4


def postprocess(features: DataFrame) -> DataFrame:
    """Health text to a 0/1 flag; unknown residuals count as new parts."""
    aging = F.col("battery_health_last").eqNullSafe(F.lit(AGING)).cast("int")
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(FULL)) for c in RESIDUALS}
    return features.withColumns({"battery_aging": aging, **fill}).drop("battery_health_last")


def with_split(df: DataFrame, date: str = "feature_date", last: int = LAST_DATES) -> DataFrame:
    """Add ``is_test``: the row is in the ``last`` most recent dates."""
    newest = df.select(date).distinct().orderBy(F.desc(date)).limit(last)
    cutoff = newest.agg(F.min(date)).scalar()
    return df.withColumn("is_test", F.col(date) >= cutoff)


def temporal_split(
    df: DataFrame, date: str = "feature_date", last: int = LAST_DATES
) -> tuple[DataFrame, DataFrame]:
    """(train, test): the most recent dates are the test part."""
    marked = with_split(df, date, last)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def three_way_split(
    df: DataFrame, date: str = "feature_date", valid: int = LAST_DATES, test: int = LAST_DATES
) -> DataFrame:
    """Add ``part``: the ``test`` most recent dates are ``test``, the ``valid`` before them ``valid``, the rest ``train``.

    A threshold chosen on ``valid`` has not seen the rows that it is judged by.
    """
    newest = df.select(date).distinct().orderBy(F.desc(date)).limit(valid + test)
    order = newest.agg(F.sort_array(F.collect_list(date), asc=False)).scalar()  # that many dates at most
    first_test = F.get(order, F.least(F.lit(test), F.size(order)) - 1)
    first_valid = F.get(order, F.size(order) - 1)
    part = F.when(F.col(date) >= first_test, "test") if test else F.when(F.lit(False), "test")
    return df.withColumn("part", part.when(F.col(date) >= first_valid, "valid").otherwise("train") if valid else part.otherwise("train"))


def frontier(df: DataFrame, at: str) -> Column:
    """The newest date a source has reached, as one scalar."""
    return df.agg(F.max(F.to_date(at))).scalar()


def with_label_complete(features: DataFrame, reached: Column, date: str = "feature_date", horizon: int = HORIZON) -> DataFrame:
    """Add ``label_complete``: all days that the label looks at are loaded.

    Later rows have a label of 0 that may only mean that the failure is not
    known yet; they can be scored, but are left out of training and test.
    """
    return features.withColumn("label_complete", F.coalesce(F.date_add(date, horizon) <= reached, F.lit(False)))


def fit_medians(train: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median per column; 0 for a column without any value."""
    found = {r["column_name"]: r["median"] for r in medians(train, cols).collect()}
    return {c: found.get(c) or 0.0 for c in cols}


def impute(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()})


def fit_scaling(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) per column; deviation 1 if constant."""
    row = train.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols],
    ).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols}


def standardize(df: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaling.items()})


def stratified_folds(
    df: DataFrame, label: str, key: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold``: rows of each label dealt out in turn, in hashed key order.

    ``key`` identifies a row, so the hashes spread evenly over the pieces of
    the distributed ranking and no label goes to one task.
    """
    dealt = df.withColumns({"value": F.xxhash64(*key, F.lit(seed)), "n": F.lit(1).cast("long")})
    ranked = running_totals(dealt, ["n"], [label])
    fold = ((F.col("cum_n") - 1) % k).cast("int")
    return ranked.select(*df.columns, fold.alias("fold"))
