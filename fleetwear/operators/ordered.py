"""Running totals and exact quantiles without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024  # a power of two


def value_counts(
    df: DataFrame, value: Column, by: Sequence[str] = (), **sums: Column
) -> DataFrame:
    """Distinct values with sums (default: the row count ``n``), combined map-side."""
    sums = sums or {"n": F.lit(1)}
    return (
        df.select(*by, value.alias("value"), *[c.alias(name) for name, c in sums.items()])
        .where(F.col("value").isNotNull())
        .groupBy(*by, "value")
        .agg(*[F.sum(name).alias(name) for name in sums])
    )


def running_totals(
    counts: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int = BUCKETS,
    keep_piece: bool = False,
) -> DataFrame:
    """Add ``cum_<m>`` (sums up to and including the row) and ``all_<m>``; with ``keep_piece`` also ``_piece``.

    ``counts`` has one row per (by, value). A single ordered window would sort
    everything in one task, so the value range is cut at approximate quantiles
    of the distinct values: windows run inside the pieces, and the totals of
    the pieces before (at most ``buckets`` rows per group) are added.
    The cut points steer only the split, never the result.
    """
    # Naming the measures keeps all uses of ``counts`` on one shuffle: without
    # it column pruning would make the cut points a second plan over the input.
    present = F.coalesce(*[F.col(m) for m in measures]).isNotNull()
    cuts = counts.select(
        F.percentile_approx(
            F.when(present, F.col("value")), [i / buckets for i in range(1, buckets)], 4 * buckets
        )
    ).scalar()
    rows = counts.withColumns({"_cuts": cuts, "_piece": F.lit(0)})
    step = buckets // 2
    while step:  # binary search: how many cut points are not above the value
        cut = F.get("_cuts", F.col("_piece") + F.lit(step - 1))
        passed = F.coalesce(cut <= F.col("value"), F.lit(False))
        rows = rows.withColumn("_piece", F.col("_piece") + F.when(passed, step).otherwise(0))
        step //= 2
    rows = rows.drop("_cuts")

    def sort_key(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    pieces = rows.groupBy(*by, "_piece").agg(*[F.sum(m).alias(m) for m in measures])
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = whole.orderBy(sort_key("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *by,
        "_piece",
        *[F.coalesce(F.sum(m).over(upto), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"all_{m}") for m in measures],
    )
    if not by:
        offsets = F.broadcast(offsets)  # at most `buckets` rows
    inside = Window.partitionBy(*by, "_piece").orderBy(sort_key("value"))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.select("*", *[F.sum(m).over(inside).alias(f"_cum_{m}") for m in measures])
    keys = [*by, "_piece"]
    joined = null_safe_join(totals, offsets, keys)
    return joined.select(
        *counts.columns,
        *(["_piece"] if keep_piece else []),
        *[(F.col(f"_cum_{m}") + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.col(f"all_{m}") for m in measures],
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, same)


def quantiles(
    counts: DataFrame,
    points: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    **others: Column,
) -> DataFrame:
    """Exact quantiles, linearly interpolated between neighbours, per group.

    ``counts`` holds distinct values with their row count ``n``; the ranks are
    read off the running totals, so no group is collected anywhere. ``others``
    are further aggregates over ``value`` and ``n``.
    """
    ranked = running_totals(counts, ["n"], by)
    bounds = ranked.groupBy(*by).agg(*_bounds(points, names), *[c.alias(name) for name, c in others.items()])
    return bounds.select(*by, *_between(points, names), *others)


def _bounds(points: Sequence[float], names: Sequence[str]) -> list[Column]:
    """Aggregates over ranked values: the row count and the neighbours of each quantile."""
    rank = [(F.col("all_n") - 1) * F.lit(p) for p in points]

    def value_at(position: Column) -> Column:
        # Smallest value whose running count exceeds the 0-based position.
        return F.min(F.when(F.col("cum_n") > position, F.col("value")))

    return [
        F.max("all_n").alias("_n"),
        *[value_at(F.floor(r)).alias(f"_lo_{n}") for r, n in zip(rank, names, strict=True)],
        *[value_at(F.ceil(r)).alias(f"_hi_{n}") for r, n in zip(rank, names, strict=True)],
    ]


def _between(points: Sequence[float], names: Sequence[str]) -> list[Column]:
    def between(name: str, p: float) -> Column:
        exact = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (exact - F.floor(exact))).cast("double").alias(name)

    return [between(n, p) for n, p in zip(names, points, strict=True)]


def beside_quantiles(
    counts: DataFrame, points: Sequence[float], names: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """``counts`` with its group's exact quantiles and ``all_n`` beside every value.

    The quantiles are found from the pieces of a group (at most ``BUCKETS``
    rows) and come back to the values by group and piece, so that a group with
    very many values is not gathered for it. A null group is a group.
    """
    ranked = running_totals(counts, ["n"], by, keep_piece=True)
    columns = _bounds(points, names)
    each = ranked.groupBy(*by, "_piece").agg(*columns)
    whole = Window.partitionBy(*by)
    made = [c for c in each.columns if c not in (*by, "_piece")]
    each = each.select(*by, "_piece", *[(F.max(c) if c == "_n" else F.min(c)).over(whole).alias(c) for c in made])
    each = each.select(*by, "_piece", *_between(points, names))
    joined = null_safe_join(ranked, each, [*by, "_piece"])
    return joined.select(*counts.columns, "all_n", *names)
