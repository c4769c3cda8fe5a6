"""Bronze to Silver: one table definition per dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwear import schemas
from fleetwear.operators.dedup import dedup
from fleetwear.operators.flatten import flatten_maintenance, flatten_missions, flatten_status


@dataclass(frozen=True)
class SilverTable:
    name: str
    schema: T.StructType
    flatten: Callable[..., DataFrame]
    keys: tuple[str, ...]
    order: Callable[[], Sequence[Column]]
    sort: tuple[str, ...]
    required: bool


# Newest version of an event, earliest of a report; polls are unique by key.
MAINTENANCE = SilverTable(
    "maintenance_events", schemas.MAINTENANCE, flatten_maintenance, ("maintenance_id",),
    lambda: [F.col("updated_at").desc_nulls_last()], ("robot_id", "completed_at"), required=False,
)
MISSIONS = SilverTable(
    "task_reports", schemas.MISSIONS, flatten_missions, ("report_id",),
    lambda: [F.col("start_time").asc()], ("robot_serial_number", "start_time"), required=True,
)
STATUS = SilverTable(
    "robot_status", schemas.STATUS, flatten_status, ("serial_number", "poll_ts"),
    lambda: [], ("serial_number", "poll_ts"), required=True,
)
TABLES = (MAINTENANCE, MISSIONS, STATUS)


def silver(
    records: DataFrame, table: SilverTable, keys: Sequence[str] | None = None, loads: Sequence[str] = ()
) -> DataFrame:
    """Typed and filtered rows in the table's column order, one per key.

    ``loads`` are columns of ``records`` that tell the load apart: several loads
    are deduplicated each by itself, as if they had come one after the other.
    """
    columns = [*loads, *table.schema.fieldNames()]
    rows = table.flatten(records, loads).select(*columns)
    return dedup(rows, [*loads, *(keys or table.keys)], table.order()).drop(*loads)
