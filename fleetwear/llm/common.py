"""Reading the tables and what several operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwear.session import python_workers as python_workers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


BATCH, TEXTS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of 2,000 from now on.

    Ten thousand whole texts, Spark's default, are tens of megabytes on both
    sides of every task, which a session keeps from stage to stage. Another
    number that the session has chosen stays.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(TEXTS_A_BATCH))


_tables: dict[str, Callable[[], None]] = {}


def working(owner: str, drop: Callable[[], None] = lambda: None) -> None:
    """Begin a task of ``owner`` in a Python worker: what other operators' tasks remember here is dropped.

    Workers live on from stage to stage. An operator keeps its tables for its
    next task, but not beside those of the operator after it.
    """
    others = [n for n in _tables if n != owner]
    for name in others:
        _tables.pop(name)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    _tables[owner] = drop


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of at most ``most`` bytes of one text column; a longer text is a slice of its own."""
    for at, stop in _cuts(batch.column(column), most):
        yield batch.slice(at, stop - at)


def texts_by_bytes(texts: pa.Array, most: int = 4 << 20) -> Iterator[list[str | None]]:
    """The same of a column of texts alone."""
    for at, stop in _cuts(texts, most):
        yield texts.slice(at, stop - at).to_pylist()


def _cuts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        used = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, used + most, "right")))
        yield at, stop
        at = stop
