"""Raw JSON scans. Layout: ``<root>/source=<s>/load_dt=<date>/<file>``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwear.schemas import envelope, paged

LOAD_DATE = "load_dt"


class MissingData(RuntimeError):
    """A required dataset has no data for the requested dates."""


def _json(reader: DataFrameReader, paths: str | Sequence[str], root: str | None) -> DataFrame:
    if root:
        reader = reader.option("basePath", root)
    return reader.json(paths if isinstance(paths, str) else list(paths))


def read_envelope(
    spark: SparkSession,
    paths: str | Sequence[str],
    record: T.StructType,
    root: str | None = None,
    where=None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per element of ``data``; null or empty ``data`` gives no rows.

    ``keep``: folder columns under ``root`` that stay beside the record.
    """
    reader = spark.read.schema(envelope(record)).option("multiLine", True)
    raw = _json(reader, paths, root)
    if where is not None:
        raw = raw.where(where)
    return raw.select(*keep, F.explode("data").alias("rec")).select(*keep, "rec.*")


def read_paged(
    spark: SparkSession,
    paths: str | Sequence[str],
    record: T.StructType,
    items: str,
    root: str | None = None,
    where=None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per element of ``data[].<items>``."""
    reader = spark.read.schema(paged(items, record)).option("multiLine", True)
    raw = _json(reader, paths, root)
    if where is not None:
        raw = raw.where(where)
    return (
        raw.select(*keep, F.explode("data").alias("page"))
        .select(*keep, F.explode(F.col("page").getField(items)).alias("rec"))
        .select(*keep, "rec.*")
    )


def read_jsonl(
    spark: SparkSession,
    paths: str | Sequence[str],
    record: T.StructType,
    root: str | None = None,
    where=None,
    keep: Sequence[str] = (),
    dropped: Observation | None = None,
) -> DataFrame:
    """One row per line; lines that are no JSON object are dropped.

    ``dropped`` gets ``lines`` and ``dropped``, counted as the scan runs.
    """
    if dropped is None:
        raw = _json(spark.read.schema(record).option("mode", "DROPMALFORMED"), paths, root)
    else:
        broken = "_broken_line"
        marked = T.StructType([*record.fields, T.StructField(broken, T.StringType())])
        raw = _json(spark.read.schema(marked).option("columnNameOfCorruptRecord", broken), paths, root)
    if where is not None:
        raw = raw.where(where)
    if dropped is not None:
        bad = F.col(broken).isNotNull()
        raw = raw.observe(dropped, F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("dropped")).where(~bad)
    return raw.select(*keep, *record.fieldNames())


def day_paths(root: str, day: dt.date, source: str = "*") -> str:
    return f"{root}/source={source}/{LOAD_DATE}={day.isoformat()}"


def read_load_dates(
    spark: SparkSession,
    read: Callable[..., DataFrame],
    root: str,
    lo: dt.date,
    hi: dt.date,
    keep: Sequence[str] = (),
) -> DataFrame | None:
    """Apply one of the readers above to the load dates ``lo..hi``; None if absent.

    A single date lists only its own folders; a range scans the root and lets
    partition pruning pick the dates.
    """
    if lo == hi:
        path = day_paths(root, lo)
        return read_or_none(spark, path, lambda: read(path, root=root, keep=keep))
    dates = F.col(LOAD_DATE).between(F.lit(lo), F.lit(hi))
    return read_or_none(spark, root, lambda: read(root, root=root, where=dates, keep=keep))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` (globs allowed) matches anything in its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_or_none(spark: SparkSession, path: str, read: Callable[[], DataFrame]) -> DataFrame | None:
    """The scan of ``path``, or None where it does not exist."""
    return read() if path_exists(spark, path) else None


def require_rows(df: DataFrame | None, dataset: str) -> DataFrame:
    """The scan itself, or an error naming the dataset if it holds nothing."""
    if df is None or df.isEmpty():
        raise MissingData(f"{dataset}: no data for the requested dates")
    return df
