"""Scans of the partitioned Parquet tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwear.files import Folder
from fleetwear.sources.bronze import day_paths, read_or_none


def date_window(day: dt.date, back: int, forward: int = 0) -> tuple[dt.date, dt.date]:
    """Closed window ``[day - back, day + forward]``; empty where lo > hi."""
    return day - dt.timedelta(days=back), day + dt.timedelta(days=forward)


def read_window(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    lo: dt.date | None = None,
    hi: dt.date | None = None,
    key: str = "dt",
) -> DataFrame:
    """Table rows with ``lo <= key <= hi``; an absent table is an empty one.

    The bounds reach the scan as partition filters.
    """
    df = read_or_none(spark, root, lambda: spark.read.schema(schema).parquet(root))
    if df is None:
        return spark.createDataFrame([], schema)
    if lo is not None:
        df = df.where(F.col(key) >= F.lit(lo))
    if hi is not None:
        df = df.where(F.col(key) <= F.lit(hi))
    return df


def read_partitions(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    days: Iterable[dt.date],
    key: str = "dt",
) -> DataFrame:
    """Rows of the listed partitions; absent ones count as empty."""
    days = list(days)
    df = read_or_none(spark, root, lambda: spark.read.schema(schema).parquet(root))
    if df is None or not days:
        return spark.createDataFrame([], schema)
    return df.where(among(key, days))


def among(column: str, values: Iterable[object]) -> Column:
    """Whether a column is one of the values, null being one like any other."""
    values = list(values)
    found = F.col(column).isin([v for v in values if v is not None])
    return found | F.col(column).isNull() if None in values else found


def within(column: str, spans: Iterable[tuple[dt.date, dt.date]]) -> Column:
    """Whether a date lies in one of the closed spans."""
    return reduce(or_, (F.col(column).between(F.lit(a), F.lit(b)) for a, b in spans), F.lit(False))


def read_spans(
    spark: SparkSession, root: str, schema: T.StructType, spans: Iterable[tuple[dt.date, dt.date]], key: str = "dt"
) -> DataFrame:
    """Table rows of dates in the closed spans; an absent table is an empty one."""
    return read_window(spark, root, schema).where(within(key, spans))


def partition_dates(spark: SparkSession, root: str, key: str = "dt") -> list[dt.date]:
    """Dates of the partitions of a table, in order, from the names of its folders."""
    start = f"{key}="
    names = [n.removeprefix(start) for n in Folder(spark, root).names("") if n.startswith(start)]
    return sorted(dt.date.fromisoformat(n) for n in names if n[:1].isdigit())


def listing(
    spark: SparkSession, root: str, key: str, lo: dt.date | None = None, hi: dt.date | None = None
) -> DataFrame:
    """Rows (key, files, bytes, newest): the files of every date folder, newest in microseconds. Nothing is read of them."""
    path = day_paths(root, lo) if lo is not None and lo == hi else root
    reader = spark.read.format("binaryFile").option("basePath", root)
    files = read_or_none(spark, path, lambda: reader.load(path))
    if files is None:
        return spark.createDataFrame([], f"{key} date, files bigint, bytes bigint, newest bigint")
    day = F.col(key).cast("date")
    if lo is not None:
        files = files.where(day >= F.lit(lo))
    if hi is not None:
        files = files.where(day <= F.lit(hi))
    return files.groupBy(day.alias(key)).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.max(F.unix_micros("modificationTime")).alias("newest"),
    )
