"""Descriptive statistics, histograms and box summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.functions import ratio
from fleetwear.operators.ordered import beside_quantiles, quantiles, value_counts
from fleetwear.session import stage

WHISKER = 1.5  # fixed value: whisker reach in interquartile ranges


def long_form(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value) rows; values as double."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*pairs)))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum, exact median, mean and maximum of each column."""
    counts = value_counts(long_form(df, cols), F.col("value"), ["column_name"])
    value, n = F.col("value"), F.col("n")
    return quantiles(
        counts, [0.5], ["median"], ["column_name"],
        min=F.min(value), mean=ratio(F.sum(value * n), F.sum(n)), max=F.max(value),
    )


def _by_place(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts; columns go by their place, names are longer than the values."""
    pairs = [F.struct(F.lit(i).alias("place"), F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)]
    return value_counts(df.select(F.inline(F.array(*pairs))), F.col("value"), ["place"])


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, median)."""
    name = F.get(F.array(*map(F.lit, cols)), F.col("place"))
    return quantiles(_by_place(df, cols), [0.5], ["median"], ["place"]).select(name.alias("column_name"), "median")


def cut_points(df: DataFrame, cols: Sequence[str], bins: int) -> tuple[dict[str, float], dict[str, list[float]]]:
    """Exact median of each column with values, and where to cut it into at most ``bins`` bins of like size.

    A column of no more distinct values is cut between them all. Cuts lie below
    the largest value, and a value that equals one is in the bin below it.
    """
    counts = stage(_by_place(df, cols), "value-counts")
    points = [0.5, *(i / bins for i in range(1, bins))]
    names = [f"q{i}" for i in range(bins)]
    value = F.col("value")
    found = quantiles(counts, points, names, ["place"], most=F.max(value), distinct=F.count(value)).collect()
    few = [r["place"] for r in found if r["distinct"] <= bins]
    seen: dict[int, list[float]] = {}
    for r in counts.where(F.col("place").isin(few)).collect():  # at most bins a column
        seen.setdefault(r["place"], []).append(r["value"])
    middle, cuts = {}, {c: [] for c in cols}
    for r in found:
        middle[cols[r["place"]]] = r["q0"]
        own = sorted(seen.get(r["place"], []))
        at = [a + (b - a) / 2 for a, b in zip(own, own[1:])] if own else sorted({r[n] for n in names[1:] if r[n] < r["most"]})
        cuts[cols[r["place"]]] = at
    return middle, cuts


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed."""
    rows = df.select(value.cast("double").alias("value"))
    return _binned(rows.withColumn("grp", F.lit("")), [""], bins).drop("grp", "density")


def histogram_by(df: DataFrame, value: Column, by: str, groups: Sequence[str], bins: int) -> DataFrame:
    """One density-normalised histogram per listed group, each over its own range."""
    rows = df.where(F.col(by).isin(list(groups)))
    rows = rows.select(F.col(by).alias("grp"), value.cast("double").alias("value"))
    return _binned(rows, groups, bins).withColumnRenamed("grp", by)


def _binned(rows: DataFrame, groups: Sequence[str], bins: int) -> DataFrame:
    rows = rows.where(F.col("value").isNotNull())

    def of(fn, i: int, name: str) -> Column:
        return fn(F.when(F.col("grp") == groups[i], F.col("value"))).alias(f"{name}{i}")

    each = range(len(groups))
    # Ranges of all listed groups in one row, read back as a scalar.
    limits = rows.agg(
        F.struct(
            *[of(F.min, i, "lo") for i in each],
            *[of(F.max, i, "hi") for i in each],
        )
    ).scalar()

    def limit(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("grp") == groups[i], limits[f"{name}{i}"]) for i in each])

    flat = limit("lo") == limit("hi")
    lo = F.when(flat, limit("lo") - 0.5).otherwise(limit("lo"))
    hi = F.when(flat, limit("hi") + 0.5).otherwise(limit("hi"))
    width = (hi - lo) / F.lit(bins)
    index = F.least(F.floor((F.col("value") - lo) / width).cast("int"), F.lit(bins - 1))
    counts = rows.groupBy("grp", index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    spark = rows.sparkSession
    # Fixed domain of groups x bins, so that empty bins show as 0.
    domain = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in groups])).alias("grp"))
    domain = domain.select("grp", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = domain.join(counts, ["grp", "bin"], "left").na.fill(0, ["n"])
    size = F.sum("n").over(Window.partitionBy("grp"))  # over `bins` rows per group
    return full.select(
        "grp",
        "bin",
        (lo + width * F.col("bin")).alias("bin_lo"),
        (lo + width * (F.col("bin") + 1)).alias("bin_hi"),
        "n",
        ratio(F.col("n"), size * width).alias("density"),
    )


def box_summary(df: DataFrame, value: Column, by: str) -> DataFrame:
    """Quartiles, and the extreme values within 1.5 IQR of them, per group."""
    rows = beside_quantiles(value_counts(df, value, [by]), [0.25, 0.5, 0.75], ["q1", "median", "q3"], [by])
    reach = (F.col("q3") - F.col("q1")) * WHISKER
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    seen = F.when(inside, F.col("value")).cast("double")
    ends = rows.groupBy(by, F.col("all_n").alias("n_values"), "q1", "median", "q3").agg(
        F.min(seen).alias("lo"), F.max(seen).alias("hi")
    )
    return ends.select(
        by,
        F.col("n_values").alias("n"),
        F.least("lo", "q1").alias("whisker_lo"),
        "q1",
        "median",
        "q3",
        F.greatest("hi", "q3").alias("whisker_hi"),
    )
