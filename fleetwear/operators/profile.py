"""Counts, totals and means by group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.functions import latest_part, newest_int, ratio, share_pct


def mean(c: str | Column) -> Column:
    return ratio(F.sum(c), F.count(c))


def profile(df: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in measures.items()])


def frequency(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, n) for each column, most frequent first."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]
    counts = df.select(F.inline(F.array(*pairs))).groupBy("column_name", "value")
    return counts.agg(F.count(F.lit(1)).alias("n")).orderBy("column_name", F.desc("n"), "value")


def frequency_in(df: DataFrame, col: str, domain: Sequence[str]) -> DataFrame:
    """Counts over a fixed ordered domain; absent values count 0."""
    counts = df.agg(*[F.count_if(F.col(col) == v).alias(f"n{i}") for i, v in enumerate(domain)])
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(v).alias(col), F.col(f"n{i}").alias("n"))
        for i, v in enumerate(domain)
    ]
    return counts.select(F.inline(F.array(*rows)))


OTHER = "other"


def crosstab(
    df: DataFrame, rows: Sequence[str], col: str, values: Mapping[object, str]
) -> DataFrame:
    """Row keys against the listed values; absent combinations count 0.

    Rows with any other value, or none, count in ``other``.
    """
    hits = {n: F.count_if(F.col(col).eqNullSafe(F.lit(v))) for v, n in values.items()}
    table = profile(df, rows, **hits, **{OTHER: F.count(F.lit(1))})
    listed = sum((F.col(n) for n in values.values()), F.lit(0))
    return table.withColumn(OTHER, F.col(OTHER) - listed)


def share(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Count and percentage of each key combination within its parent group."""
    counts = df.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("n"))
    if not within:
        # One scalar instead of a window that would gather all groups.
        total = counts.select(F.sum("n")).scalar()
    else:
        total = F.sum("n").over(Window.partitionBy(*within))
    return counts.withColumn("pct", share_pct(F.col("n"), total))


def shares_of(
    df: DataFrame, keys: Sequence[str], col: str, values: Mapping[object, str]
) -> DataFrame:
    """Percentage of each listed value, and of all others, among all rows."""
    names = [*values.values(), OTHER]
    table = crosstab(df, keys, col, values)
    whole = sum((F.col(n) for n in names), F.lit(0))
    return table.select(*keys, *[share_pct(F.col(n), whole).alias(n) for n in names])


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values per column, one pass over the data."""
    dtypes = dict(df.dtypes)

    def missing(c: str) -> Column:
        gone = F.col(c).isNull()
        if dtypes[c] in ("double", "float"):
            gone = gone | F.isnan(c)
        return F.count_if(gone)

    counts = df.agg(*[missing(c).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in cols]
    return counts.select(F.inline(F.array(*rows)))


def facts(df: DataFrame, date: Column, entity: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count_distinct(entity).alias("n_entities"),
    )


def latest(
    df: DataFrame, keys: Sequence[str], at: str, value: str, keep_null: bool = True
) -> DataFrame:
    """Newest value of each group; of equal times the larger value."""
    if dict(df.dtypes)[value] == "int":
        return df.groupBy(*keys).agg(newest_int(F.col(at), F.col(value), keep_null).alias(value))
    newest = F.max(latest_part(F.col(at), F.col(value), keep_null))
    return df.groupBy(*keys).agg(newest.alias("_pair")).select(*keys, F.col("_pair.value").alias(value))


def left_fill(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join; ``cols`` of the right side are 0 where it has no match."""
    return left.join(right, list(keys), "left").na.fill(0, list(cols))
