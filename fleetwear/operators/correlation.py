"""Pearson correlations, all of them from one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(a: str, b: str) -> Column:
    """r over the rows where both are present; null if either is constant there."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), spread)


def corr_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(pearson(a, b).alias("r"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, r) for every ordered pair, the diagonal included.

    Columns without nulls share one covariance matrix; a pair with a column that
    has nulls looks at the rows where both are present. Constant columns have
    a null r.
    """
    # The columns asked for, once: every later pass reads these.
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()
    try:
        facts = values.agg(
            *[F.count_if(F.col(c).isNull()).alias(f"gone_{i}") for i, c in enumerate(cols)],
            *[(F.min(c) == F.max(c)).alias(f"flat_{i}") for i, c in enumerate(cols)],
            F.count(F.lit(1)).alias("rows"),
        ).first()
        full = [c for i, c in enumerate(cols) if facts["rows"] and not facts[f"gone_{i}"]]
        # A constant column has no correlation, with itself neither; the matrix holds 1 there.
        constant = {c for i, c in enumerate(cols) if facts[f"flat_{i}"]}
        found = {}
        if full:
            ready = VectorAssembler(inputCols=full, outputCol="v").transform(values.select(*full)).select("v")
            matrix = Correlation.corr(ready, "v").first()[0].toArray()
            for i, a in enumerate(full):
                for j, b in enumerate(full):
                    r = float(matrix[i][j])
                    found[a, b] = None if r != r or a in constant or b in constant else r
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:] if (a, b) not in found]
        if pairs:
            row = values.agg(*[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
            for i, (a, b) in enumerate(pairs):
                found[a, b] = found[b, a] = row[i]
    finally:
        values.unpersist()
    cells = [(a, b, found[a, b]) for a in cols for b in cols]
    return df.sparkSession.createDataFrame(cells, "col_a string, col_b string, r double")


def corr_target(df: DataFrame, cols: Sequence[str], target: str, k: int | None = None) -> DataFrame:
    """Correlation of each column with the target, strongest first."""
    row = df.agg(*[pearson(c, target).alias(c) for c in cols])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("r")) for c in cols]
    ranked = row.select(F.inline(F.array(*cells))).orderBy(
        F.abs("r").desc_nulls_last(), "column_name"
    )
    return ranked if k is None else ranked.limit(k)
