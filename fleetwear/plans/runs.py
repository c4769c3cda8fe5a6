"""Daily runs and backfills over the stored layers."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwear import schemas
from fleetwear.files import Folder
from fleetwear.plans import silver as tables
from fleetwear.plans.features import LONGEST, Inputs, features_range
from fleetwear.plans.silver import SilverTable, silver
from fleetwear.plans.spans import Span, clipped, merged, of_dates, reach, shifted, stale
from fleetwear.session import release, stage
from fleetwear.sinks import drop_partitions, merge_changes, recover, replace_partitions
from fleetwear.sources import (
    listing,
    partition_dates,
    read_envelope,
    read_jsonl,
    read_load_dates,
    read_paged,
    read_spans,
    read_window,
    require_rows,
)
from fleetwear.sources.bronze import LOAD_DATE
from fleetwear.sources.tables import within

GOLD_TABLE = "robot_features"
FLEET_DATASET = "list_robots"


@dataclass(frozen=True)
class Layout:
    """Roots of the three layers; ``keys`` replaces a table's dedup key.

    An id names one event of its date: another day may use it again. Tables in
    ``lasting`` have ids that name one event for ever; there a newer version on
    another date replaces the old row, wherever it is.
    """

    bronze: str
    silver: str
    gold: str
    keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    lasting: frozenset[str] = frozenset()

    def raw(self, dataset: str) -> str:
        return f"{self.bronze}/{dataset}"

    def table(self, name: str) -> str:
        return f"{self.silver}/{name}"

    @property
    def features(self) -> str:
        return f"{self.gold}/{GOLD_TABLE}"

    @property
    def ledger(self) -> str:
        """What of Bronze has been loaded."""
        return f"{self.silver}/_loads"

    @property
    def changes(self) -> str:
        """Notes of changed dates whose features are not rebuilt yet."""
        return f"{self.silver}/_changes"


def _reader(spark: SparkSession, table: SilverTable) -> Callable[..., DataFrame]:
    if table is tables.MAINTENANCE:
        return partial(read_envelope, spark, record=schemas.MAINTENANCE_RECORD)
    if table is tables.MISSIONS:
        return partial(read_paged, spark, record=schemas.MISSION_RECORD, items=schemas.MISSION_ITEMS)
    return partial(read_jsonl, spark, record=schemas.STATUS_RECORD)


def read_fleet(spark: SparkSession, layout: Layout, day: dt.date) -> DataFrame | None:
    """Snapshot of the fleet registry of one load date."""
    read = partial(read_paged, spark, record=schemas.FLEET_RECORD, items=schemas.FLEET_ITEMS)
    return read_load_dates(spark, read, layout.raw(FLEET_DATASET), day, day)


class Loaded(dict):
    """Rows merged per table, and in ``changed`` the dates per table whose rows are not what they were."""

    def __init__(self) -> None:
        super().__init__()
        self.changed: dict[str, set[dt.date]] = {}


def run_silver(
    spark: SparkSession, layout: Layout, lo: dt.date, hi: dt.date | None = None, empties: bool = False
) -> Loaded:
    """Load the dates ``lo..hi`` of all datasets; rows merged per table.

    Every load date is deduplicated by itself and a range gives the same rows as
    its days one after the other. Absent service events count as none; absent
    missions or telemetry are an error naming the dataset. What was loaded is
    noted in the ledger once the rows are in place; which dates change is noted
    before they do, for ``refresh_gold``, so that a run lost in between leaves
    no stale features behind.

    With ``empties`` a load date whose files hold no usable row is an answer
    too: the date has no rows, its partition goes, whichever load it came with.
    """
    loaded = Loaded()
    # As listed before reading: what arrives meanwhile is still missing afterwards.
    found = stage(bronze_listing(spark, layout, lo, hi or lo), "bronze-listing")
    for table in tables.TABLES:
        raw = read_load_dates(spark, _reader(spark, table), layout.raw(table.name), lo, hi or lo, [LOAD_DATE])
        if table.required and not (empties and raw is not None):
            raw = require_rows(raw, table.name)
        if raw is None:
            loaded[table.name], loaded.changed[table.name] = 0, set()
            continue
        keys = layout.keys.get(table.name, table.keys)
        rows, announce = silver(raw, table, keys, [LOAD_DATE]), partial(note_changes, spark, layout, table.name)
        loaded[table.name], loaded.changed[table.name] = merge_changes(
            rows, layout.table(table.name), table.schema, keys,
            table.order(), sort=table.sort, lasting=table.name in layout.lasting, announce=announce,
        )
        if empties:
            named = found.where(F.col("dataset") == table.name).select(LOAD_DATE)
            filled = rows.select(F.col("dt").alias(LOAD_DATE)).distinct()
            gone = {r[0] for r in named.join(filled, LOAD_DATE, "left_anti").collect()}  # bounded by the calendar
            gone &= set(partition_dates(spark, layout.table(table.name)))
            if gone:
                announce(gone)
                drop_partitions(spark, layout.table(table.name), gone)
                loaded.changed[table.name] |= gone
    note_loads(found, layout)
    release(found)
    return loaded


def _inputs(spark: SparkSession, layout: Layout, dates: list[Span], lookback: int | None) -> Inputs:
    """Silver partitions that features of these dates can need."""

    def window(table: SilverTable) -> DataFrame:
        back, ahead = reach(table.name, lookback)
        needed = merged((shifted(a, None if ahead is None else -ahead, dt.date.min), shifted(b, back, dt.date.max)) for a, b in dates)
        recover(spark, layout.table(table.name))
        return read_spans(spark, layout.table(table.name), table.schema, needed)

    return Inputs(window(tables.MISSIONS), window(tables.MAINTENANCE), window(tables.STATUS))


def build_gold(spark: SparkSession, layout: Layout, dates: list[Span], lookback: int | None = LONGEST) -> None:
    """Features of all these dates in one plan; each date becomes what the tables say, be it nothing."""
    dates = merged(dates)
    if not dates:
        return
    lo, hi = dates[0][0], dates[-1][1]
    only = None if len(dates) == 1 else partial(within, spans=dates)
    features = features_range(_inputs(spark, layout, dates, lookback), lo, hi, lookback, only=only)
    dated = features.withColumn("dt", F.col("feature_date"))
    held = {d for d in built(spark, layout) if any(a <= d <= b for a, b in dates)}
    replace_partitions(dated, layout.features, held, order=["serial_number"])


def built(spark: SparkSession, layout: Layout) -> list[dt.date]:
    """Dates that the feature table holds, from the names of its folders."""
    recover(spark, layout.features)
    return partition_dates(spark, layout.features)


def note_changes(spark: SparkSession, layout: Layout, table: str, days: Iterable[dt.date]) -> None:
    """Keep dates of a table that are about to change, until the features that see them are rebuilt."""
    note = {"table": table, "days": sorted(d.isoformat() for d in days)}
    Folder(spark, layout.changes).write(f"{uuid.uuid4().hex}.json", json.dumps(note))


def refresh_gold(
    spark: SparkSession, layout: Layout, more: Iterable[Span] = (), lookback: int | None = LONGEST
) -> list[Span]:
    """Rebuild the features that noted changes have made stale, and ``more``, in one plan; the dates built.

    Late rows reach feature dates before them (labels) and after them (windows).
    Dates from the first to the last one built so far count; later ones come
    with their own run. The notes go when the features are in place.
    """
    folder = Folder(spark, layout.changes)
    names = [n for n in folder.names("") if n.endswith(".json")]
    changed: dict[str, set[dt.date]] = {}
    for name in names:
        note = json.loads(folder.read(name))
        changed.setdefault(note["table"], set()).update(map(dt.date.fromisoformat, note["days"]))
    held = built(spark, layout)
    old = clipped(stale(changed, lookback), held[0], held[-1]) if held else []
    dates = merged([*old, *more])
    build_gold(spark, layout, dates, lookback)
    for name in names:
        folder.delete(name)
    return dates


def _rows(spark: SparkSession, layout: Layout, lo: dt.date, hi: dt.date) -> int:
    # Answered from the Parquet footers of the partitions written.
    return read_window(spark, layout.features, schemas.FEATURES, lo, hi).count()


def run_gold(spark: SparkSession, layout: Layout, day: dt.date, lookback: int | None = LONGEST) -> int:
    """Features of one date as its partition of the feature table."""
    build_gold(spark, layout, [(day, day)], lookback)
    return _rows(spark, layout, day, day)


def run_day(spark: SparkSession, layout: Layout, day: dt.date) -> dict[str, int]:
    """Raw documents to features for one date, and for earlier and later ones that its rows change; safe to repeat."""
    return run_range(spark, layout, day, day)


def run_range(
    spark: SparkSession, layout: Layout, lo: dt.date, hi: dt.date, lookback: int | None = LONGEST
) -> dict[str, int]:
    """Backfill: the same tables as a daily run of every date, in one pass each."""
    loaded = run_silver(spark, layout, lo, hi)
    refresh_gold(spark, layout, [(lo, hi)], lookback)
    return {**loaded, GOLD_TABLE: _rows(spark, layout, lo, hi)}


# ---------------------------------------------------------------- catching up


def bronze_listing(spark: SparkSession, layout: Layout, lo: dt.date | None = None, hi: dt.date | None = None) -> DataFrame:
    """Rows (dataset, load_dt, files, bytes, newest): what Bronze holds per dataset and load date."""
    return reduce(
        DataFrame.unionByName,
        (listing(spark, layout.raw(t.name), LOAD_DATE, lo, hi).withColumn("dataset", F.lit(t.name)) for t in tables.TABLES),
    )


def note_loads(found: DataFrame, layout: Layout) -> None:
    """Add loads to the ledger, a row per dataset and load date."""
    found.withColumn("noted_at", F.current_timestamp().cast("timestamp_ntz")).select(
        *schemas.LOADS.fieldNames()
    ).coalesce(1).write.mode("append").parquet(layout.ledger)


def missed_loads(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Of a listing, what the ledger does not have in this state: dates never loaded, and those with other files since."""
    same = ["dataset", LOAD_DATE, "files", "bytes", "newest"]
    return found.join(ledger.select(*same).distinct(), same, "left_anti")


def missed(spark: SparkSession, layout: Layout, hi: dt.date | None = None) -> DataFrame:
    """Rows (dataset, load_dt, files, bytes, newest) of Bronze up to ``hi`` that are not loaded."""
    ledger = read_window(spark, layout.ledger, schemas.LOADS)
    return missed_loads(bronze_listing(spark, layout, None, hi), ledger)


def catch_up(
    spark: SparkSession, layout: Layout, hi: dt.date | None = None, lookback: int | None = LONGEST
) -> list[Span]:
    """Load every date that was missed, oldest first, and build the features that follow from it; the dates loaded.

    Dates that have come late count again. Dates whose missions or telemetry
    are absent altogether are no error here: they are left for a later run.
    """
    days = {t.name: set() for t in tables.TABLES}
    for r in bronze_listing(spark, layout, None, hi).select("dataset", LOAD_DATE).collect():  # bounded by the calendar
        days[r["dataset"]].add(r[LOAD_DATE])
    whole = set.intersection(*(days[t.name] for t in tables.TABLES if t.required))
    late = {r[0] for r in missed(spark, layout, hi).select(LOAD_DATE).distinct().collect()}
    loads = of_dates(late & whole)
    for lo, last in loads:
        run_silver(spark, layout, lo, last)
    if loads:
        refresh_gold(spark, layout, loads, lookback)
    return loads
