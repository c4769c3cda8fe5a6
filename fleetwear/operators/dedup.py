"""Keep one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """First row of each key under ``order``.

    The columns outside the key follow as ascending tiebreaks, so the survivor
    never depends on the physical row order. Spark keeps one row per key in
    each map task before the shuffle (WindowGroupLimit), so a key with very
    many copies does not reach one task whole.
    """
    rest = [F.col(c).asc_nulls_first() for c in df.columns if c not in keys]
    ranked = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")
