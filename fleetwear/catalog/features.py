"""Feature queries: one date, every Monday, every day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.catalog.registry import query
from fleetwear.catalog.roles import (
    ASOF,
    ASOF_STATUS,
    FIRST,
    LAST,
    MAINTENANCE,
    STATUS,
    USAGE,
    Tables,
    maintenance,
    status,
    status_sql,
    usage,
)
from fleetwear.operators.profile import latest
from fleetwear.plans.features import (
    KEYS,
    LABEL,
    LONGEST,
    MAINTENANCE_FEATURES,
    STATUS_FEATURES,
    USAGE_FEATURES,
    Inputs,
    asof_features,
    features_range,
    spine_asof,
    spine_weekly,
    status_daily,
    weekly_features,
)

# ------------------------------------------------------------ expected answers
#
# All expected answers have one shape. ``moments`` lists whatever happened to a
# device, of any kind; ``grid`` lists the devices and dates asked for; ``seen``
# pairs every date with its device's moments and their distance in days (positive:
# before the date). Every feature is then one aggregate over ``seen``.

_DATE = f"date '{ASOF}'"
_STATUS_DATE = f"date '{ASOF_STATUS}'"


def _newest(value: str, at: str, where: str, nulls: bool) -> str:
    """Value of the latest moment; of equal times the larger, a null is the smallest."""
    only = where if nulls else f"{where} and {value} is not null"
    return f"last({value} order by {at}, {value} nulls first) filter (where {only})"


def _polled(nulls: bool) -> str:
    return f"""polled as (
  select serial_number, poll_ts::date as day, avg(battery_soc) as avg_battery_soc,
    {_newest("battery_cycle_times", "poll_ts", "true", nulls)} as battery_cycle_times,
    {_newest("battery_health", "poll_ts", "true", nulls)} as battery_health
  from status group by serial_number, poll_ts::date)"""


_WORK = """select 'work' as kind, robot_serial_number as device, start_time::timestamp as happened, actual_area_m2 as area,
    completion_percentage as done, battery_delta_pct as drained, brush_residual_pct as brush,
    filter_residual_pct as sieve, suction_blade_residual_pct as blade from usage"""
_SERVICE = """select 'service' as kind, robot_id as device, completed_at::timestamp as happened, downtime_minutes as idle,
    failure_detected as broken, maintenance_type = 'corrective' as repaired from maint"""
_POLL = """select 'poll' as kind, serial_number as device, day::timestamp as happened, avg_battery_soc as charge,
    battery_cycle_times as cycles, battery_health as health from polled"""


def _moments(*kinds: str) -> str:
    return "moments as (\n  " + "\n  union all by name ".join(kinds) + ")"


_SEEN = """seen as (
  select serial_number, feature_date, date_diff('day', happened::date, feature_date) as gap, moments.*
  from grid left join moments on device = serial_number
    and (kind = 'service' or date_diff('day', happened::date, feature_date) between 0 and 90))"""


def _grid(table: str = "usage", device: str = "robot_serial_number", at: str = "start_time", day: str = _DATE) -> str:
    """Devices active in the 90 days up to one date."""
    return f"""grid as (
  select {device} as serial_number, {day} as feature_date from {table}
  where date_diff('day', {at}::date, {day}) between 0 and 90 group by {device})"""


_MONDAYS = f"""grid as (
  select robot_serial_number as serial_number, date_trunc('week', start_time::date)::date as feature_date
  from usage where start_time::date >= date '{FIRST}' and start_time::date <= date '{LAST}' group by all)"""

def _every_day(lo: dt.date, hi: dt.date) -> str:
    return f"""grid as (
  select robot_serial_number as serial_number, asked.d::date as feature_date
  from (select distinct robot_serial_number, start_time::date as worked from usage),
    generate_series(date '{lo}', date '{hi}', interval 1 day) as asked(d)
  where date_diff('day', worked, asked.d::date) between 0 and 90 group by all)"""


def _features(near: int, nulls: bool, lookback: int | None = None) -> dict[str, str]:
    """Name of each feature and its aggregate; windows begin ``near`` days before the date."""

    def within(kind: str, far: int, also: str = "") -> str:
        return f"kind = '{kind}' and gap between {near} and {far}{also and ' and ' + also}"

    def n(kind: str, far: int, also: str = "") -> str:
        return f"count(*) filter (where {within(kind, far, also)})"

    def of(aggregate: str, kind: str, far: int) -> str:
        return f"{aggregate} filter (where {within(kind, far)})"

    def age(also: str) -> str:
        far = "" if lookback is None else f" and gap <= {lookback}"
        return f"coalesce(min(gap) filter (where kind = 'service' and gap >= {near}{far}{also}), 999)::int"

    newest = {
        "brush_residual_last": ("brush", "work", 90), "filter_residual_last": ("sieve", "work", 90),
        "squeegee_residual_last": ("blade", "work", 90), "battery_cycle_times_last": ("cycles", "poll", 7),
        "battery_health_last": ("health", "poll", 7),
    }
    return {
        **{name: _newest(v, "happened", within(kind, far), nulls) for name, (v, kind, far) in newest.items()},
        "missions_7d": n("work", 7),
        "missions_30d": n("work", 30),
        "area_30d": f"coalesce({of('sum(area)', 'work', 30)}, 0)",
        "area_90d": f"coalesce({of('sum(area)', 'work', 90)}, 0)",
        "avg_completion_7d": of("avg(done)", "work", 7),
        "avg_completion_30d": of("avg(done)", "work", 30),
        "avg_battery_drop_30d": of("avg(drained)", "work", 30),
        "days_since_last_maintenance": age(""),
        "days_since_last_failure": age(" and broken"),
        "maint_count_30d": n("service", 30),
        "maint_count_90d": n("service", 90),
        "downtime_30d": f"coalesce({of('sum(idle)', 'service', 30)}, 0)::bigint",
        "failure_count_90d": n("service", 90, "broken"),
        "corrective_count_90d": n("service", 90, "repaired"),
        "avg_battery_soc_7d": f"round({of('avg(charge)', 'poll', 7)}, 6)",
        LABEL: "(count(*) filter (where kind = 'service' and broken and gap between -30 and -1) > 0)::int",
    }


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts)


def _expected(
    grid: str, names: Sequence[str], near: int, nulls: bool, *tables: str, kinds: Sequence[str], lookback: int | None = None
) -> str:
    made = _features(near, nulls, lookback)
    columns = ",\n  ".join(f"{made[c]} as {c}" for c in names)
    sources = [*tables, *([_polled(nulls)] if _POLL in kinds else []), grid, _moments(*kinds), _SEEN]
    active = f" having count(*) filter (where kind = 'work' and gap between {near} and 90) > 0" if _WORK in kinds else ""
    return f"{_with(*sources)}\nselect serial_number, feature_date,\n  {columns}\nfrom seen group by all{active}"


_EVERY = (*USAGE_FEATURES, *MAINTENANCE_FEATURES, *STATUS_FEATURES, LABEL)
_TABLES = (USAGE, MAINTENANCE, status_sql(True))
_KINDS = (_WORK, _SERVICE, _POLL)
ASOF_SQL = _expected(_grid(), _EVERY, 0, True, *_TABLES, kinds=_KINDS)
WEEKLY_SQL = _expected(_MONDAYS, _EVERY, 1, False, *_TABLES, kinds=_KINDS)
BACKFILL_SQL = _expected(_every_day(FIRST, LAST), _EVERY, 0, True, *_TABLES, kinds=_KINDS)


def backfill_sql(lo: dt.date, hi: dt.date, lookback: int = LONGEST) -> str:
    """Features of every date of a range, as the runs build them."""
    return _expected(_every_day(lo, hi), _EVERY, 0, True, *_TABLES, kinds=_KINDS, lookback=lookback)

# ----------------------------------------------------------------- queries


def all_inputs(t: Tables) -> Inputs:
    return Inputs(usage(t), maintenance(t), status(t, shifted=True))


def rounded(df: DataFrame) -> DataFrame:
    """A mean of daily means depends on the order of addition in its last bits."""
    return df.withColumn("avg_battery_soc_7d", F.round("avg_battery_soc_7d", 6))


@query("feature_spine", _with(USAGE, _grid()) + " select * from grid")
def feature_spine(t):
    return spine_asof(usage(t), ASOF)


@query("weekly_spine", _with(USAGE, _MONDAYS) + " select * from grid")
def weekly_spine(t):
    return spine_weekly(usage(t), FIRST, LAST)


@query(
    "latest_value",
    _with(USAGE)
    + f""" select robot_serial_number, {_newest("brush_residual_pct", "start_time", "true", True)}
  as brush_residual_pct from usage group by 1""",
)
def latest_value(t):
    return latest(usage(t), ["robot_serial_number"], "start_time", "brush_residual_pct")


@query("asof_usage", _expected(_grid(), USAGE_FEATURES, 0, True, USAGE, kinds=[_WORK]))
def asof_usage(t):
    return asof_features(Inputs(usage(t)), ASOF)


@query(
    "asof_maintenance",
    _expected(_grid(), MAINTENANCE_FEATURES, 0, True, USAGE, MAINTENANCE, kinds=[_WORK, _SERVICE]),
)
def asof_maintenance(t):
    return asof_features(Inputs(usage(t), maintenance(t)), ASOF).select(*KEYS, *MAINTENANCE_FEATURES)


@query("failure_label", _expected(_grid(), [LABEL], 0, True, USAGE, MAINTENANCE, kinds=[_WORK, _SERVICE]))
def failure_label(t):
    return asof_features(Inputs(usage(t), maintenance(t)), ASOF).select(*KEYS, LABEL)


@query("status_daily", _with(STATUS, _polled(True)) + " select * from polled")
def daily_status(t):
    return status_daily(status(t))


@query(
    "asof_status",
    _expected(
        _grid("status", "serial_number", "poll_ts", _STATUS_DATE), STATUS_FEATURES, 0, True, STATUS, kinds=[_POLL]
    ),
)
def asof_status(t):
    polls = status(t)
    # Every poll also stands for activity, so that the devices polled form the spine.
    active = polls.select(
        F.col("serial_number").alias("robot_serial_number"),
        F.col("poll_ts").alias("start_time"),
        *[F.lit(None).cast("double").alias(c) for c in ("actual_area_m2", "completion_percentage")],
        *[
            F.lit(None).cast("int").alias(c)
            for c in (
                "battery_delta_pct", "brush_residual_pct", "filter_residual_pct",
                "suction_blade_residual_pct",
            )
        ],
    )
    rows = asof_features(Inputs(active, None, polls), ASOF_STATUS)
    return rounded(rows.select(*KEYS, *STATUS_FEATURES))


@query("asof_features", ASOF_SQL)
def asof_all(t):
    return rounded(asof_features(all_inputs(t), ASOF))


@query(
    "weekly_usage_features",
    _expected(_MONDAYS, USAGE_FEATURES, 1, False, USAGE, kinds=[_WORK]),
)
def weekly_usage(t):
    return weekly_features(Inputs(usage(t)), FIRST, LAST)


@query(
    "weekly_maintenance",
    _expected(_MONDAYS, MAINTENANCE_FEATURES, 1, False, USAGE, MAINTENANCE, kinds=[_WORK, _SERVICE]),
)
def weekly_maintenance(t):
    rows = weekly_features(Inputs(usage(t), maintenance(t)), FIRST, LAST)
    return rows.select(*KEYS, *MAINTENANCE_FEATURES)


@query(
    "weekly_status",
    _expected(_MONDAYS, STATUS_FEATURES, 1, False, USAGE, status_sql(True), kinds=[_WORK, _POLL]),
)
def weekly_status(t):
    rows = weekly_features(Inputs(usage(t), None, status(t, shifted=True)), FIRST, LAST)
    return rounded(rows.select(*KEYS, *STATUS_FEATURES))


@query("weekly_features", WEEKLY_SQL)
def weekly_all(t):
    return rounded(weekly_features(all_inputs(t), FIRST, LAST))


@query("features_backfill", BACKFILL_SQL)
def features_backfill(t):
    return rounded(features_range(all_inputs(t), FIRST, LAST))

