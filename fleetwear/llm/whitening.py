"""Whitening of embeddings by polarisation covariance.

Every entry becomes a whole number x, and each distinct vector counts once (the
fit list). Covariances come from squares alone: the sums of squared centred
values of every dimension and of every sum of two dimensions give
``2 cov(i, j) = var(i + j) - var(i) - var(j)``. All sums are exact. Values are
centred on the whole part m of their mean S/n before they are squared; the rest
r = S - n*m is put right afterwards in whole numbers of any size:
``sum((n*x - S)^2) = n^2 * sum((x - m)^2) - n * r^2``. The matrix of the
dimensions (its size does not depend on the rows) is assembled on the driver,
each entry rounded once, and goes to ``eigh``.

Per task there is one partial sum a dimension pair, added up by Spark. The fit
list is staged, so each pass reads the same rows whatever executors are lost.

Nulls and odd rows: rows whose vector is null, empty, or holds a null, infinite
or not-a-number entry, or one of 2^30 or more, are dropped; so are vectors that
do not have the most frequent length (ties: the longer). A null key is kept,
repeated rows get the same values each and count once in the fit. ``deviation``
is null where it does not fit a long. Components without variance (an
eigenvalue within rounding of 0) are left out, so fewer than ``components`` may
come back; an empty table, or one with a single distinct vector, gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.common import python_workers
from fleetwear.session import stage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LARGEST = 1 << 30  # entries from here on are dropped: sums of squares stay below 10^38
BLOCK = 1024  # rows handled at once


@dataclass
class Model:
    n: int
    whole: np.ndarray  # m, the whole part of the means
    rest: np.ndarray  # r = S - n*m
    values: np.ndarray  # eigenvalues, falling, those kept
    axes: np.ndarray  # a column a component, over the root of its eigenvalue
    trace: float
    identity_error: float = 0.0


def whole_numbers(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (key, x) of the usable vectors, entries as whole numbers."""
    entry = F.col(vector)
    usable = entry.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST)
    )
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(key).alias("key"), x.alias("x"))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return rows, 0
    return rows.where(F.size("x") == most["d"]), most["d"]


def blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.column(column).slice(at, BLOCK).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def square_sums(y: np.ndarray) -> np.ndarray:
    """Of a block, transposed: row i holds the sums of squares of y_i, then of y_i + y_j for j > i; exact."""
    d, rows = y.shape
    # Whole numbers of any size where a square or its sum might pass 64 bits.
    if rows and 4 * max(-int(y.min()), int(y.max())) ** 2 * rows >= 1 << 62:
        y = y.astype(object)
    out = np.zeros((d, d), y.dtype)
    for i in range(d):
        out[i, i] = (y[i] * y[i]).sum()
        both = y[i + 1:] + y[i]
        out[i, i + 1:] = (both * both).sum(axis=1)
    return out


def exact_sums(fit: DataFrame, sums: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum over all blocks of whole-number arrays of one shape, as Python integers."""
    python_workers(fit.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in blocks(batches, 0, d):
            part = sums(block).astype(object).ravel()
            total = part if total is None else total + part
        if total is not None:
            filled = [i for i, v in enumerate(total) if v]
            yield pa.RecordBatch.from_arrays(
                [pa.array(filled, pa.int32()), pa.array([Decimal(total[i]) for i in filled], pa.decimal128(38))], ["at", "v"]
            )

    shape = sums(np.zeros((0, d), np.int64)).shape
    out = np.zeros(int(np.prod(shape)), object)
    for r in fit.mapInArrow(add, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = int(r["v"])
    return out.reshape(shape)


def covariance(squares: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """Polarisation: from sums of squares (upper triangle) to the covariance matrix, every entry rounded once."""
    d = len(rest)
    spread = [n * n * int(squares[i, i]) - n * int(rest[i]) ** 2 for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = spread[i] / n**3
        for j in range(i + 1, d):
            both = n * n * int(squares[i, j]) - n * int(rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - spread[i] - spread[j]) / (2 * n**3)
    return out


def fit_model(fit: DataFrame, d: int, components: int = COMPONENTS) -> Model | None:
    """The model of a staged list of distinct vectors; None where there is no variance."""
    first = exact_sums(fit, lambda x: np.append((x - SHIFT).sum(axis=0), len(x)), d)
    n = int(first[-1])
    if not n:
        return None
    sums = [int(s) + SHIFT * n for s in first[:-1]]
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object)
    squares = exact_sums(fit, lambda x: square_sums(np.ascontiguousarray((x - whole).T)), d)
    matrix = covariance(squares, rest, n)
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    real = values > d * np.finfo(float).eps * max(values[0], 0)
    if not real.any():
        return None
    values, axes = values[real], axes[:, real] / np.sqrt(values[real])
    model = Model(n, whole, rest, values, axes, float(np.trace(matrix)))
    model.identity_error = identity_error(fit, model, d)
    return model


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    shift = np.array([int(r) / model.n for r in model.rest])
    return ((x - model.whole) - shift) @ model.axes


def identity_error(fit: DataFrame, model: Model, d: int) -> float:
    """The covariance of the whitened fit list itself, against the identity."""
    k = len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for block in blocks(batches, 0, d):
            w = whitened(block, model)
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    total = np.zeros((k + 1) * k)
    for r in fit.mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r["v"]
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Exact sums over the dimensions of (n*x - S)^2; None where a long is too short."""
    y = x - model.whole
    most = model.n * (max(abs(int(y.min())), abs(int(y.max()))) + 1) if y.size else 0
    kind = np.int64 if y.shape[1] * most**2 < 1 << 63 else object
    z = model.n * y.astype(kind) - model.rest.astype(kind)
    return [v if v < 1 << 63 else None for v in map(int, (z * z).sum(axis=1))]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error): one per usable row and component."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = of_one_length(whole_numbers(df, key, vector))
    model = None
    if d:
        # Partial aggregation keeps one of equal vectors in every map task before the shuffle.
        model = fit_model(stage(rows.select("x").distinct(), "whitening-fit"), d, components)
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    python_workers(spark)
    k = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = model.values / model.trace
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                for x in blocks(iter([part]), 1, d):
                    n = len(x)
                    each = np.repeat(np.arange(n), k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(each)),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                            pa.array(np.full(n * k, model.n, np.int64)),
                            pa.array(deviations(x, model), pa.int64()).take(pa.array(each)),
                            pa.array(whitened(x, model).ravel()),
                            pa.array(np.tile(explained, n)),
                            pa.array(np.full(n * k, model.identity_error)),
                        ],
                        ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return rows.mapInArrow(project, schema).withColumnRenamed("key", key)
