"""Partitioned Parquet writes and the load report."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwear.files import Folder
from fleetwear.operators.dedup import dedup
from fleetwear.sinks.journal import folder_name, recover, swap_partitions
from fleetwear.sources.tables import among, read_partitions, read_window


def write_partitions(
    df: DataFrame,
    path: str,
    key: str = "dt",
    mode: str = "dynamic",
    order: Sequence[str] = (),
    seen: Observation | None = None,
) -> None:
    """Write ``df`` partitioned by ``key``; ``seen`` gets ``rows`` and ``values`` (of the key) as they are written.

    ``dynamic`` replaces only the partitions present in ``df`` (none if it is
    empty); ``rebuild`` replaces the table. The adaptive rebalance packs a small
    partition into one file and splits a large one over several tasks.
    """
    if mode not in ("dynamic", "rebuild"):
        raise ValueError(f"mode: {mode}")
    overwrite = "dynamic" if mode == "dynamic" else "static"
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    # Without adaptive execution the hint does nothing, so the key is dealt out plainly.
    dealt = (df.hint("rebalance", key) if adaptive else df.repartition(key)).sortWithinPartitions(key, *order)
    if seen is not None:
        # In the last stage, so that no row counts twice when a task is repeated.
        dealt = dealt.observe(seen, F.count(F.lit(1)).alias("rows"), F.collect_set(key).alias("values"))
    (
        dealt.write.mode("overwrite")
        .option("partitionOverwriteMode", overwrite)
        .partitionBy(key)
        .parquet(path)
    )


def merge_partitions(
    df: DataFrame,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    order: Sequence[Column],
    key: str = "dt",
    sort: Sequence[str] = (),
    lasting: bool = False,
) -> int:
    """Merge ``df`` into the partitions it touches and return the rows of ``df``; see ``merge_changes``."""
    return merge_changes(df, path, schema, keys, order, key, sort, lasting)[0]


def merge_changes(
    df: DataFrame,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    order: Sequence[Column],
    key: str = "dt",
    sort: Sequence[str] = (),
    lasting: bool = False,
    announce: Callable[[set], None] | None = None,
) -> tuple[int, set]:
    """Merge ``df`` into the partitions it touches: rows of ``df``, and the partitions whose rows are not what they were.

    A load may hold rows of neighbouring dates, so a plain replacement of the
    touched partitions would lose rows that came with other loads. The old rows
    of those partitions are read, merged and deduplicated within each date.

    ``lasting`` keys are unique over all dates: the dates where incoming keys
    already stand are rewritten too, and a date left without rows is removed.

    The partitions are swapped by the journal: a merge that was broken off is
    finished or undone when the next one begins, and can be repeated. Partitions
    that come out as they were are not written; a repeated load changes nothing.

    ``announce`` is told the changed partitions before the first of them changes.
    """
    spark = df.sparkSession
    recover(spark, path)
    incoming = df.select(*schema.fieldNames()).persist()
    try:
        # Distinct calendar dates of one load: bounded by the calendar.
        days = {r[0] for r in incoming.select(key).distinct().collect()}
        if not days:
            return 0, set()
        if lasting:
            held = read_window(spark, path, schema).select(*keys, key)
            moved = held.join(incoming.select(*keys).distinct(), list(keys), "left_semi")
            days |= {r[0] for r in moved.select(key).distinct().collect()}
        old = read_partitions(spark, path, schema, days, key).select(*schema.fieldNames())
        unique = list(keys) if lasting or key in keys else [*keys, key]
        merged = dedup(old.unionByName(incoming), unique, order).persist()
        try:
            before, after = _content(old, key), _content(merged, key)
            changed = {d for d in days if before.get(d) != after.get(d)}
            if changed:
                if announce is not None:
                    announce(changed)
                fresh = merged.where(among(key, changed))
                swap_partitions(
                    spark, path, key, changed, lambda place: write_partitions(fresh, place, key, "rebuild", sort)
                )
        finally:
            merged.unpersist()
        return incoming.count(), changed
    finally:
        incoming.unpersist()


def replace_partitions(
    df: DataFrame, path: str, values: Iterable[object], key: str = "dt", order: Sequence[str] = ()
) -> None:
    """The partitions ``values`` become the rows of ``df``; those without rows are removed."""
    recover(df.sparkSession, path)
    swap_partitions(
        df.sparkSession, path, key, values, lambda place: write_partitions(df, place, key, "rebuild", order)
    )


def drop_partitions(spark: SparkSession, path: str, values: Iterable[object], key: str = "dt") -> None:
    """Remove partitions; absent ones are no error."""
    recover(spark, path)
    swap_partitions(spark, path, key, values, lambda place: None)


@dataclass(frozen=True)
class Written:
    """What one write has put down."""

    rows: int
    partitions: int
    files: int
    bytes: int


def write_reported(
    df: DataFrame, path: str, key: str = "dt", mode: str = "dynamic", order: Sequence[str] = ()
) -> Written:
    """``write_partitions``, and what it wrote: counted on the way and listed afterwards, the table is not read again."""
    seen = Observation()
    write_partitions(df, path, key, mode, order, seen)
    found = seen.get
    folder = Folder(df.sparkSession, path)
    sizes = [size for v in found["values"] for size in folder.sizes(folder_name(key, v))]
    return Written(found["rows"], len(found["values"]), len(sizes), sum(sizes))


def report(spark: SparkSession, written: Mapping[str, Written], total: str = "total") -> DataFrame:
    """A row per table in the given order: table_name, rows, partitions, files, bytes; the last one sums them up."""
    lines = [(name, w.rows, w.partitions, w.files, w.bytes) for name, w in written.items()]
    lines.append((total, *(sum(line[i] for line in lines) for i in range(1, 5))))
    return spark.createDataFrame(lines, "table_name string, rows bigint, partitions bigint, files bigint, bytes bigint")


def _content(df: DataFrame, key: str) -> dict:
    """Per partition: rows and two sums that depend on every value of every row, not on their order."""
    columns = [c for c in df.columns if c != key]
    one = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])
    two = F.xxhash64(F.lit(1), *reversed(columns), *[F.col(c).isNull() for c in columns])
    found = df.groupBy(key).agg(F.count(F.lit(1)), F.sum(one.cast("decimal(20,0)")), F.bit_xor(two))
    return {r[0]: tuple(r)[1:] for r in found.collect()}


def table_report(spark: SparkSession, path: str, key: str = "dt", name: str | None = None) -> DataFrame:
    """One row: table name, rows, partitions, files, bytes."""
    files = (
        spark.read.parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("file"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size"))
    )
    return files.agg(
        F.lit(name or path.rstrip("/").rsplit("/", 1)[-1]).alias("table_name"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_distinct(key).alias("partitions"),
        F.count_distinct("file").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )
