"""Device features as of one date, every Monday, or every day of a range.

All of them are one plan:

1. The raw rows are rolled up to one row per (device, day), with partial
   aggregation in the map tasks. Nothing after this depends on how many raw
   rows a device has, only on its number of days.
2. The days are shuffled once by device; all later steps keep that layout.
3. A day enters a window at one feature date and leaves it at a later one: a plus
   and a minus. They are summed by hash per device and feature date, beside the
   newest of the values that are carried, so that what is ordered has one row
   per device and date at which anything changes.
4. One ordered pass per device makes running totals of the changes, and carries
   the newest residuals, battery state and service days along, whatever the
   distance. The totals hold until the next row, so only then a row is repeated
   for every feature date that it stands for: nothing before the result grows
   with the length of the windows.

Whole numbers are exact. Of other measures a running total can be off in the last
bits; where a window holds no mission, its area is 0 all the same.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.functions import (
    codes,
    dated_int,
    dated_parts,
    latest_part,
    newest_int_of_day,
    newest_text,
    place_of,
    ratio,
    whole_days,
)

NEVER = 999  # fixed value: days since an event that never happened
LONGEST = 90
RECENT = 30
WEEK = 7
HORIZON = 30
KEYS = ("serial_number", "feature_date")

# Names and order of the feature table's columns.
USAGE_FEATURES = (
    "brush_residual_last", "filter_residual_last", "squeegee_residual_last",
    "missions_7d", "missions_30d", "area_30d", "area_90d",
    "avg_completion_7d", "avg_completion_30d", "avg_battery_drop_30d",
)
MAINTENANCE_FEATURES = (
    "days_since_last_maintenance", "days_since_last_failure",
    "maint_count_30d", "maint_count_90d", "downtime_30d",
    "failure_count_90d", "corrective_count_90d",
)
STATUS_FEATURES = ("battery_cycle_times_last", "battery_health_last", "avg_battery_soc_7d")
LABEL = "has_failure_next_30d"

_LATEST_USAGE = {
    "brush_residual_last": "brush_residual_pct",
    "filter_residual_last": "filter_residual_pct",
    "squeegee_residual_last": "suction_blade_residual_pct",
}


# ---------------------------------------------------------------- roll-ups


def usage_daily(usage: DataFrame, keep_null: bool = True) -> DataFrame:
    """(device, day) totals of the missions, and the newest residuals of the day."""
    done, drop = "completion_percentage", "battery_delta_pct"
    return usage.groupBy(
        F.col("robot_serial_number").alias("serial_number"),
        F.to_date("start_time").alias("day"),
    ).agg(
        F.count(F.lit(1)).alias("missions"),
        F.sum("actual_area_m2").cast("double").alias("area"),
        F.sum(done).cast("double").alias("done_sum"),
        F.count(done).alias("done_n"),
        F.sum(drop).cast("double").alias("drop_sum"),
        F.count(drop).alias("drop_n"),
        *[
            newest_int_of_day(F.col("start_time"), F.col(c), keep_null).alias(name)
            for name, c in _LATEST_USAGE.items()
        ],
    )


def maintenance_daily(maintenance: DataFrame) -> DataFrame:
    """(device, day) counts of the service events."""
    failed = F.coalesce(F.col("failure_detected"), F.lit(False))
    return maintenance.groupBy(
        F.col("robot_id").alias("serial_number"),
        F.to_date("completed_at").alias("day"),
    ).agg(
        F.count(F.lit(1)).alias("services"),
        F.sum(F.col("downtime_minutes").cast("long")).alias("downtime"),
        F.count_if(failed).alias("failures"),
        F.count_if(F.col("maintenance_type") == "corrective").alias("corrective"),
    )


def status_daily(status: DataFrame, keep_null: bool = True, texts: list[str] | None = None) -> DataFrame:
    """(device, day) mean charge and last cycle count and health; with ``texts`` health is its place among them, from 1."""
    at = F.col("poll_ts")
    soc = F.col("battery_soc")
    health = (
        newest_text(status, at, "battery_health", keep_null) if texts is None
        else newest_int_of_day(at, place_of(F.col("battery_health"), texts), keep_null)
    )
    return status.groupBy("serial_number", F.to_date("poll_ts").alias("day")).agg(
        ratio(F.sum(soc), F.count(soc)).alias("avg_battery_soc"),
        newest_int_of_day(at, F.col("battery_cycle_times"), keep_null).alias("battery_cycle_times"),
        health.alias("battery_health"),
    )


# ------------------------------------------------------------------ inputs

# Which table a daily row comes from.
MISSION, SERVICE, POLL = 1, 2, 3
_DAY = dt.timedelta(days=1)


@dataclass(frozen=True)
class Inputs:
    """The three Silver tables; features of an absent table are left out."""

    usage: DataFrame
    maintenance: DataFrame | None = None
    status: DataFrame | None = None

    def names(self) -> list[str]:
        names = [*KEYS, *USAGE_FEATURES]
        if self.maintenance is not None:
            names += MAINTENANCE_FEATURES
        if self.status is not None:
            names += STATUS_FEATURES
        if self.maintenance is not None:
            names.append(LABEL)
        return names


def _days(df: DataFrame, time_col: str, lo: dt.date, back: int | None, hi: dt.date) -> DataFrame:
    day = F.to_date(time_col)
    df = df.where(day <= F.lit(hi))
    return df if back is None else df.where(day >= F.lit(lo - _DAY * back))


def _daily(
    inputs: Inputs, lo: dt.date, hi: dt.date, lookback: int | None, keep_null: bool, texts: list[str] | None = None
) -> DataFrame:
    """Roll-ups of all days that can matter to the dates ``lo..hi``, by device."""
    rows = usage_daily(_days(inputs.usage, "start_time", lo, LONGEST, hi), keep_null)
    rows = rows.withColumn("kind", F.lit(MISSION))
    if inputs.maintenance is not None:
        reach = None if lookback is None else max(lookback, LONGEST)
        events = _days(inputs.maintenance, "completed_at", lo, reach, hi + _DAY * HORIZON)
        events = maintenance_daily(events).withColumn("kind", F.lit(SERVICE))
        rows = rows.unionByName(events, allowMissingColumns=True)
    if inputs.status is not None:
        polls = status_daily(_days(inputs.status, "poll_ts", lo, WEEK, hi), keep_null, texts)
        polls = polls.withColumns(
            {"kind": F.lit(POLL), "soc_n": F.col("avg_battery_soc").isNotNull().cast("int")}
        )
        rows = rows.unionByName(polls, allowMissingColumns=True)
    # A fixed number: the rows grow again after the shuffle, which the adaptive coalescing does not see.
    spark = inputs.usage.sparkSession
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "serial_number")


# ------------------------------------------------------------- feature plan


def _features(
    inputs: Inputs,
    lo: dt.date,
    hi: dt.date,
    step: int,
    near: int,
    ahead: int,
    active: Column,
    lookback: int | None,
    keep_null: bool,
    only: Callable[[str], Column] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Features on ``lo, lo + step .. hi``, of these only where ``only`` holds of the date.

    With ``columns`` only these are built: a table that none of them needs is not
    read, and a day is changed into rows for their windows only.

    ``near`` is 0 if the feature date itself belongs to the windows, else 1.
    A device must have missions in the 90 days back, and, if ``ahead`` is
    positive, an ``active`` day within the date and ``ahead`` days after it.
    """
    names = list(columns or inputs.names())
    inputs = _needed(inputs, names)
    texts = codes(inputs.status, "battery_health") if inputs.status is not None else None
    daily = _daily(inputs, lo, hi, lookback, keep_null, texts)
    daily = daily.withColumn("active", F.when(active, F.col("missions")))
    windows = _windows(inputs, near, ahead, step, names)
    steps = _steps(daily, windows, inputs, lo, hi, step, near, keep_null, texts is not None, names)
    rows = _running(steps, windows, lo, hi, step)
    if only is not None:
        rows = rows.where(only("feature_date"))
    return _read_off(rows, inputs, lookback, texts, names).select(*names)


def _needed(inputs: Inputs, names: Sequence[str]) -> Inputs:
    """The tables that the columns come from; the missions always tell the active devices."""
    served = {*MAINTENANCE_FEATURES, LABEL} & set(names)
    return Inputs(
        inputs.usage, inputs.maintenance if served else None, inputs.status if {*STATUS_FEATURES} & set(names) else None
    )


@dataclass(frozen=True)
class _Span:
    """A window: days of one kind from ``start`` to ``far`` days before the feature date, and what is summed in it.

    A ``whole`` window is as long as the distance of two feature dates: what enters
    at a date is all it holds there, and nothing needs to leave it.
    """

    kind: int
    start: int
    far: int
    parts: tuple[str, ...]
    whole: bool = False

    def total(self, part: str) -> str:
        return f"_{part}_{self.start}_{self.far}"


# Features that are read off the windows of each length.
_READ = {
    (MISSION, WEEK): ("missions_7d", "avg_completion_7d"),
    (MISSION, RECENT): ("missions_30d", "area_30d", "avg_completion_30d", "avg_battery_drop_30d"),
    (SERVICE, RECENT): ("maint_count_30d", "downtime_30d"),
    (SERVICE, LONGEST): ("maint_count_90d", "failure_count_90d", "corrective_count_90d"),
    (SERVICE, -1): (LABEL,),
    (POLL, WEEK): ("avg_battery_soc_7d",),
}


def _windows(inputs: Inputs, near: int, ahead: int, step: int, names: Sequence[str]) -> list[_Span]:
    found = [
        _Span(MISSION, near, WEEK, ("missions", "done_sum", "done_n")),
        _Span(MISSION, near, RECENT, ("missions", "area", "done_sum", "done_n", "drop_sum", "drop_n")),
        _Span(MISSION, near, LONGEST, ("missions", "area")),
    ]
    if ahead:
        found.append(_Span(MISSION, -ahead, 0, ("active",)))
    if inputs.maintenance is not None:
        found += [
            _Span(SERVICE, near, RECENT, ("services", "downtime")),
            _Span(SERVICE, near, LONGEST, ("services", "failures", "corrective")),
            _Span(SERVICE, -HORIZON, -1, ("failures",)),
        ]
    if inputs.status is not None:
        found.append(_Span(POLL, near, WEEK, ("avg_battery_soc", "soc_n")))
    if ahead + 1 == step:  # only dates with an active day of their own are asked for
        found = [replace(x, whole=x.far + 1 - x.start == step) for x in found]
    return [x for x in found if (x.kind, x.far) not in _READ or set(_READ[x.kind, x.far]) & set(names)]


def _carried(inputs: Inputs, coded: bool, names: Sequence[str]) -> dict[str, tuple[int, Column, Column, bool]]:
    """What is carried along: kind, day and value (null for the day itself) of each name, and whether it is a number."""
    found = {f"_{name}": (MISSION, F.col("day"), F.col(name), True) for name in _LATEST_USAGE if name in names}
    if inputs.status is not None:
        found["_cycles"] = (POLL, F.col("day"), F.col("battery_cycle_times"), True)
        found["_health"] = (POLL, F.col("day"), F.col("battery_health"), coded)
    if inputs.maintenance is not None:
        if "days_since_last_maintenance" in names:
            found["_service"] = (SERVICE, F.col("day"), None, True)
        if "days_since_last_failure" in names:
            found["_failure"] = (SERVICE, F.when(F.col("failures") > 0, F.col("day")), None, True)
    return found


def _steps(
    daily: DataFrame, windows: list[_Span], inputs: Inputs, lo: dt.date, hi: dt.date, step: int, near: int,
    keep_null: bool, coded: bool, names: Sequence[str],
) -> DataFrame:
    """One row per device and feature date i at which a window gains or loses a day: the changes, and the newest values."""
    offset = F.date_diff(F.col("day"), F.lit(lo))
    last_i = (hi - lo).days // step
    kind, shift = F.col("kind"), F.col("shift")

    def index(days: int) -> Column:
        return F.ceil((offset + days) / F.lit(step)).cast("int")

    carried = _carried(inputs, coded, names)
    # Windows that begin or end at the same distance share a row of the day.
    kinds: dict[int, set[int]] = {}
    for span in windows:
        kinds.setdefault(span.kind, set()).update((span.start,) if span.whole else (span.start, span.far + 1))
    for of, *_ in carried.values():
        kinds.setdefault(of, set()).add(near)

    def at(days: int) -> Column:
        i = F.greatest(index(days), F.lit(0))
        return F.struct(F.when(i <= last_i, i).alias("i"), F.lit(days).alias("shift"))

    # An array of its own for each kind, and a plain filter: with a higher-order function Spark would not compile this step.
    ends = F.coalesce(*[F.when(kind == k, F.array(*map(at, sorted(kinds[k])))) for k in sorted(kinds)])
    rows = daily.select("*", F.inline(ends)).where(F.col("i").isNotNull())

    def change(span: _Span, part: str) -> Column:
        held = (kind == span.kind) & (F.greatest(index(span.start), F.lit(0)) < index(span.far + 1))
        came = F.when(held & (shift == span.start), F.col(part))
        if not span.whole:
            came = came.when(held & (shift == span.far + 1), -F.col(part))
        return F.sum(came).alias(span.total(part))

    def newest(of: int, day: Column, value: Column | None, number: bool) -> Column:
        day = F.when((kind == of) & (shift == near), day)
        if value is None:
            return F.max(day)
        return F.max(dated_int(day, value, keep_null) if number else latest_part(day, value, keep_null))

    newest_values = [newest(*parts).alias(name) for name, parts in carried.items()]
    return rows.groupBy("serial_number", "i").agg(*[change(x, part) for x in windows for part in x.parts], *newest_values)


def _running(steps: DataFrame, windows: list[_Span], lo: dt.date, hi: dt.date, step: int) -> DataFrame:
    """Totals of every window and the newest carried values, at each feature date of a device with missions."""
    order = Window.partitionBy("serial_number").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def held(x: _Span, part: str) -> Column:
        return F.coalesce(F.col(x.total(part)) if x.whole else F.sum(x.total(part)).over(so_far), F.lit(0))

    totals = {x.total(part): held(x, part) for x in windows for part in x.parts}
    carried = {c: F.max(c).over(so_far) for c in steps.columns if c not in ("serial_number", "i", *totals)}
    once = any(x.whole for x in windows)  # a date has a row of its own or is not asked for
    rows = steps.select(
        "serial_number", "i", *([] if once else [F.lead("i").over(order).alias("next")]),
        *[c.alias(name) for name, c in (totals | carried).items()],
    )
    seen = [F.col(x.total(p)) > 0 for x in windows for p in x.parts if p == "active" or p == "missions" and x.far == LONGEST]
    if once:
        return rows.where(seen[0] & seen[-1]).withColumn("feature_date", F.date_add(F.lit(lo), F.col("i") * step))
    until = F.coalesce(F.col("next") - 1, F.lit((hi - lo).days // step))
    rows = rows.where((F.col("i") <= until) & seen[0] & seen[-1])
    rows = rows.withColumn("i", F.explode(F.sequence(F.col("i"), until)))
    return rows.withColumn("feature_date", F.date_add(F.lit(lo), F.col("i") * step))


def _read_off(
    rows: DataFrame, inputs: Inputs, lookback: int | None, texts: list[str] | None, names: Sequence[str]
) -> DataFrame:
    """The named features of a date from its totals and carried values."""
    date = F.col("feature_date")

    def total(part: str, far: int) -> Column:
        return F.col(next(c for c in rows.columns if c.startswith(f"_{part}_") and c.endswith(f"_{far}")))

    def count(part: str, far: int) -> Column:
        return total(part, far).cast("long")

    def area(far: int) -> Column:
        return F.when(total("missions", far) > 0, total("area", far)).otherwise(0.0)

    def mean(part: str, n: str, far: int) -> Column:
        return ratio(total(part, far), total(n, far))

    def within(name: str, far: int) -> Column:
        at, value = dated_parts(F.col(name))
        return F.when(whole_days(date, at) <= far, value)

    def health() -> Column:
        if texts is not None:
            return F.get(F.array(*map(F.lit, texts)).cast("array<string>"), within("_health", WEEK) - 1)
        return F.when(whole_days(date, F.col("_health")["at"]) <= WEEK, F.col("_health")["value"])

    def age(name: str) -> Column:
        days = whole_days(date, F.col(name))
        if lookback is not None:
            days = F.when(days <= lookback, days)
        return F.coalesce(days, F.lit(NEVER))

    found = {
        **{name: lambda name=name: within(f"_{name}", LONGEST) for name in _LATEST_USAGE},
        "missions_7d": lambda: count("missions", WEEK),
        "missions_30d": lambda: count("missions", RECENT),
        "area_30d": lambda: area(RECENT),
        "area_90d": lambda: area(LONGEST),
        "avg_completion_7d": lambda: mean("done_sum", "done_n", WEEK),
        "avg_completion_30d": lambda: mean("done_sum", "done_n", RECENT),
        "avg_battery_drop_30d": lambda: mean("drop_sum", "drop_n", RECENT),
        "days_since_last_maintenance": lambda: age("_service"),
        "days_since_last_failure": lambda: age("_failure"),
        "maint_count_30d": lambda: count("services", RECENT),
        "maint_count_90d": lambda: count("services", LONGEST),
        "downtime_30d": lambda: count("downtime", RECENT),
        "failure_count_90d": lambda: count("failures", LONGEST),
        "corrective_count_90d": lambda: count("corrective", LONGEST),
        LABEL: lambda: (total("failures", -1) > 0).cast("int"),
        "battery_cycle_times_last": lambda: within("_cycles", WEEK),
        "battery_health_last": health,
        "avg_battery_soc_7d": lambda: mean("avg_battery_soc", "soc_n", WEEK),
    }
    return rows.withColumns({name: found[name]() for name in names if name not in KEYS})


# ------------------------------------------------------------ entry points


def spine_asof(usage: DataFrame, day: dt.date, lookback: int = LONGEST) -> DataFrame:
    """Devices with a mission in ``[day - lookback, day]``."""
    seen = _days(usage, "start_time", day, lookback, day)
    return seen.select(
        F.col("robot_serial_number").alias("serial_number"), F.lit(day).alias("feature_date")
    ).distinct()


def spine_weekly(usage: DataFrame, lo: dt.date, hi: dt.date) -> DataFrame:
    """(device, Monday) of every week with a mission dated ``lo..hi``."""
    day = F.to_date("start_time")
    return (
        usage.where(day.between(F.lit(lo), F.lit(hi)))
        .select(
            F.col("robot_serial_number").alias("serial_number"),
            F.trunc(day, "week").alias("feature_date"),
        )
        .distinct()
    )


def features_range(
    inputs: Inputs,
    lo: dt.date,
    hi: dt.date,
    lookback: int | None = None,
    closed_end: bool = True,
    keep_null: bool = True,
    only: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Features for each date of ``lo..hi`` of the devices active in the 90
    days up to it. With ``closed_end`` the date itself belongs to the windows.
    ``only`` makes a condition of a date column: other dates are not built."""
    near = 0 if closed_end else 1
    return _features(inputs, lo, hi, 1, near, 0, F.lit(True), lookback, keep_null, only)


def asof_features(inputs: Inputs, day: dt.date, lookback: int | None = None, **flags: bool) -> DataFrame:
    """Features for one date."""
    return features_range(inputs, day, day, lookback, **flags)


def weekly_features(
    inputs: Inputs,
    lo: dt.date,
    hi: dt.date,
    lookback: int | None = None,
    keep_null: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Features on every Monday whose week has a mission dated ``lo..hi``; with ``columns`` only these.

    Windows end the day before the Monday; devices without a mission in the 90
    days before it are left out.
    """
    monday = lo - _DAY * lo.weekday()
    active = F.col("day").between(F.lit(lo), F.lit(hi))
    return _features(inputs, monday, hi, WEEK, 1, WEEK - 1, active, lookback, keep_null, columns=columns)
