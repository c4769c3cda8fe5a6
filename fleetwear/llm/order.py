"""The next row in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.llm.common import partitions


def with_piece(df: DataFrame, key: str, cuts: list) -> DataFrame:
    """Add ``piece``: how many of the sorted ``cuts`` are not above the key, by binary search; 0 for null.

    Every step is a column of its own: nested in one expression, the steps
    would double its size each time.
    """
    rows = df.withColumn("piece", F.lit(0))
    if not cuts:
        return rows
    array = F.lit(cuts)
    steps = 1 << (len(cuts).bit_length() - 1)
    while steps:
        passed = F.coalesce(F.get(array, F.col("piece") + F.lit(steps - 1)) <= F.col(key), F.lit(False))
        rows = rows.withColumn("piece", F.col("piece") + F.when(passed, steps).otherwise(0))
        steps //= 2
    return rows


def with_next(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Rows in descending order of ``key`` (nulls last), then ``tie``, each beside its successor.

    Adds ``piece``, ``rank`` (within the piece) and ``ghost``. Every piece, a
    range of keys, ends with a copy of the first row of the next piece, marked
    ``ghost``, so that a window inside the piece sees each row's successor; the
    last piece ends with the first row of all. ``rank`` is consecutive, so
    ``lead`` over ``ring`` works on this frame and on what is computed from it.

    The cut points are approximate quantiles: they steer the split only. What
    reaches the driver is a cut and the first key for each piece.
    """
    pieces = 4 * partitions(df.sparkSession)
    cuts = df.agg(F.percentile_approx(key, [i / pieces for i in range(1, pieces)], 10 * pieces)).first()[0]
    cuts = sorted(set(cuts or []))
    rows = with_piece(df, key, cuts)
    firsts = sorted(
        (r["piece"], r["first"])
        for r in rows.select("piece", key).groupBy("piece").agg(F.max(key).alias("first")).collect()
    )
    if not firsts:
        return rows.select("*", F.lit(0).alias("ghost"), F.lit(0).alias("rank"))
    # The successor of a piece is the one below it; of the lowest, the highest.
    goes_to = [(first, firsts[(i + 1) % len(firsts)][0]) for i, (_, first) in enumerate(firsts)]
    kind = dict(df.dtypes)[key]
    targets = df.sparkSession.createDataFrame(goes_to, f"_key {kind}, _to int")
    first_rows = (
        df.join(F.broadcast(targets), F.col(key).eqNullSafe(F.col("_key")))  # a row a piece
        .groupBy("_key", "_to")
        .agg(F.max(F.struct(tie, *[c for c in df.columns if c != tie])).alias("r"))
    )
    ghosts = first_rows.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], F.col("_to").alias("piece"))
    both = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts.withColumn("ghost", F.lit(1)))
    inside = Window.partitionBy("piece").orderBy("ghost", F.desc_nulls_last(key), F.desc_nulls_last(tie))
    return both.select("*", F.row_number().over(inside).alias("rank"))


def ring() -> Window:
    """The window over which ``lead`` gives the successor; ghosts have none and are dropped afterwards."""
    return Window.partitionBy("piece").orderBy("rank")
