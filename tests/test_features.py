"""Window, label and latest-value edges on literal rows."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from fleetwear import schemas
from fleetwear.plans.features import Inputs, asof_features, features_range, weekly_features

D = dt.date(2026, 3, 2)  # a Monday
DAY = dt.timedelta(days=1)

USAGE = schemas.table(
    "robot_serial_number string, start_time timestamp_ntz, actual_area_m2 double,"
    "completion_percentage double, battery_delta_pct int, brush_residual_pct int,"
    "filter_residual_pct int, suction_blade_residual_pct int"
)
MAINT = schemas.table(
    "robot_id string, completed_at timestamp_ntz, failure_detected boolean,"
    "maintenance_type string, downtime_minutes int"
)
STATUS = schemas.table(
    "serial_number string, poll_ts timestamp_ntz, battery_soc int, battery_cycle_times int, battery_health string"
)


def at(days, hour=12):
    return dt.datetime.combine(D + DAY * days, dt.time(hour))


def mission(days, robot="r", area=1.0, brush=50, hour=12, done=0.5, drop=-10):
    return (robot, at(days, hour), area, done, drop, brush, 60, 70)


def event(days, failed=True, robot="r", kind="corrective", minutes=60):
    return (robot, at(days), failed, kind, minutes)


def poll(days, soc, cycles=5, health="HEALTHY", robot="r", hour=12):
    return (robot, at(days, hour), soc, cycles, health)


@pytest.fixture
def inputs(spark):
    def make(missions, events=(), polls=()):
        return Inputs(
            spark.createDataFrame(list(missions), USAGE),
            spark.createDataFrame(list(events), MAINT),
            spark.createDataFrame(list(polls), STATUS),
        )

    return make


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


EDGES = [0, -7, -8, -30, -31, -90, -91]


def test_closed_windows(inputs):
    row = one(asof_features(inputs([mission(d, area=10.0 ** -d if d > -3 else 1.0) for d in EDGES]), D))
    assert (row.missions_7d, row.missions_30d) == (2, 4)
    assert (row.area_30d, row.area_90d) == (4.0, 6.0)


def test_half_open_windows(inputs):
    row = one(weekly_features(inputs([mission(d) for d in EDGES]), D, D))
    assert (row.missions_7d, row.missions_30d) == (1, 3)
    assert (row.area_30d, row.area_90d) == (3.0, 5.0)


@pytest.mark.parametrize(("days", "label"), [(0, 0), (1, 1), (30, 1), (31, 0)])
def test_label_edges(inputs, days, label):
    assert one(asof_features(inputs([mission(-1)], [event(days)]), D)).has_failure_next_30d == label


def test_label_needs_a_failure(inputs):
    assert one(asof_features(inputs([mission(-1)], [event(5, failed=False)]), D)).has_failure_next_30d == 0


def test_no_maintenance(inputs):
    row = one(asof_features(inputs([mission(-1)]), D))
    assert (row.days_since_last_maintenance, row.days_since_last_failure) == (999, 999)
    assert (row.maint_count_30d, row.maint_count_90d, row.downtime_30d) == (0, 0, 0)
    assert row.avg_battery_soc_7d is None and row.battery_health_last is None


def test_maintenance_only_robot_is_absent(inputs):
    df = asof_features(inputs([mission(-1)], [event(-1, robot="other")]), D)
    assert [r.serial_number for r in df.collect()] == ["r"]


def test_maintenance_counts(inputs):
    events = [event(0), event(-30, False, kind="preventive"), event(-31), event(-90), event(-91)]
    row = one(asof_features(inputs([mission(-1)], events), D))
    assert (row.maint_count_30d, row.maint_count_90d) == (2, 4)
    assert (row.failure_count_90d, row.corrective_count_90d, row.downtime_30d) == (3, 3, 120)
    assert row.days_since_last_maintenance == 0


@pytest.mark.parametrize(("lookback", "expected"), [(None, 200), (90, 999)])
def test_lookback(inputs, lookback, expected):
    data = inputs([mission(-1)], [event(-200)])
    assert one(asof_features(data, D, lookback)).days_since_last_failure == expected
    weekly = one(weekly_features(inputs([mission(-1), mission(1)], [event(-200)]), D, D + 6 * DAY, lookback))
    assert weekly.days_since_last_failure == expected


def test_latest_null_rules(inputs):
    data = inputs([mission(-3, brush=40), mission(-2, brush=None), mission(0)])
    assert one(asof_features(data, D - DAY, keep_null=True)).brush_residual_last is None
    assert one(asof_features(data, D - DAY, keep_null=False)).brush_residual_last == 40
    assert one(weekly_features(data, D, D)).brush_residual_last == 40


def test_latest_null_rule_within_a_day(inputs):
    data = inputs([mission(-1, brush=40, hour=8), mission(-1, brush=None, hour=9)])
    assert one(asof_features(data, D)).brush_residual_last is None
    assert one(asof_features(data, D, keep_null=False)).brush_residual_last == 40


def test_latest_tie_takes_the_larger(inputs):
    data = inputs([mission(-1, brush=40), mission(-1, brush=60)])
    assert one(asof_features(data, D)).brush_residual_last == 60


def test_charge_is_a_mean_of_daily_means(inputs):
    polls = [poll(-1, 10), poll(-1, 20, hour=13), poll(-2, 45), poll(-8, 99), poll(0, 0, cycles=9, health="AGING")]
    row = one(asof_features(inputs([mission(-1)], [], polls), D))
    assert row.avg_battery_soc_7d == (15 + 45 + 0) / 3
    assert (row.battery_cycle_times_last, row.battery_health_last) == (9, "AGING")


def test_weekly_spine_follows_the_week_of_the_mission(inputs):
    # A mission on Sunday belongs to the Monday before it.
    rows = weekly_features(inputs([mission(-20), mission(6)]), D, D + 6 * DAY).collect()
    assert [r.feature_date for r in rows] == [D]
    # The range bounds missions, not Mondays: here the Monday precedes the range.
    rows = weekly_features(inputs([mission(-20), mission(2)]), D + DAY, D + 3 * DAY).collect()
    assert [r.feature_date for r in rows] == [D]


def _random_inputs(inputs, seed=7):
    rnd = random.Random(seed)
    robots = ["a", "b", "c"]

    def days(n, lo=-160, hi=60):
        return [rnd.randint(lo, hi) for _ in range(n)]

    return inputs(
        [
            mission(d, rnd.choice(robots), float(rnd.randint(1, 9)), rnd.choice([None, 10, 20]), rnd.randint(6, 9), 0.25, -4)
            for d in days(90)
        ],
        [event(d, rnd.random() < 0.5, rnd.choice(robots)) for d in days(40, -300)],
        [poll(d, rnd.randint(0, 9), rnd.choice([None, 1, 2]), rnd.choice("HA"), rnd.choice(robots), rnd.randint(0, 23)) for d in days(150)],
    )


@pytest.mark.parametrize("lookback", [None, 90])
def test_range_equals_single_dates(inputs, lookback):
    data = _random_inputs(inputs)
    lo, hi = D - 2 * DAY, D + 2 * DAY
    together = {tuple(r) for r in features_range(data, lo, hi, lookback).collect()}
    single = itertools.chain.from_iterable(
        asof_features(data, lo + DAY * i, lookback).collect() for i in range((hi - lo).days + 1)
    )
    assert together == {tuple(r) for r in single}


@pytest.mark.parametrize("lookback", [None, 90])
def test_weekly_equals_half_open_single_dates(inputs, lookback):
    data = _random_inputs(inputs, 8)
    lo, hi = D - 14 * DAY, D + 9 * DAY
    weekly = {tuple(r) for r in weekly_features(data, lo, hi, lookback).collect()}
    single = set()
    for i in range(0, (hi - lo).days + 1, 7):
        monday = lo + DAY * i
        week = data.usage.where(F.to_date("start_time").between(F.lit(monday), F.lit(min(monday + 6 * DAY, hi))))
        active = {r[0] for r in week.select("robot_serial_number").distinct().collect()}
        rows = asof_features(data, monday, lookback, closed_end=False, keep_null=False).collect()
        single |= {tuple(r) for r in rows if r.serial_number in active}
    assert weekly and weekly == single


def test_newest_int(spark):
    from fleetwear.functions import newest_int

    t = dt.datetime
    rows = [
        (1, t(2026, 1, 1), 5), (1, t(2026, 1, 2), None), (2, t(1950, 1, 1, 0, 0, 0, 1), -(2**31)), (2, t(1950, 1, 1), 7),
        (3, t(2026, 1, 1), -3), (3, t(2026, 1, 1), 2**31 - 1), (4, None, 9), (5, t(2026, 1, 1), None), (5, t(2026, 1, 1), 0),
    ]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz, v int")
    for keep, first in ((True, None), (False, 5)):
        got = dict(df.groupBy("k").agg(newest_int(F.col("at"), F.col("v"), keep).alias("v")).collect())
        assert got == {1: first, 2: -(2**31), 3: 2**31 - 1, 4: None, 5: 0}


def test_changes_are_summed_by_hash_before_they_are_ordered(inputs):
    """What is ordered has a row per device and date of a change, not one per day, window and end."""
    rows = weekly_features(inputs([mission(-3), mission(-2)], [event(-2)], [poll(-2, 50)]), D, D + DAY * 20)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("Window"):plan.index("Generate inline")]
    assert "HashAggregate(keys=[serial_number" in above.replace("ObjectHashAggregate", "")
    assert "SortAggregate" not in plan


def test_newest_int_of_day_equals_newest_int(spark):
    from fleetwear.functions import newest_int, newest_int_of_day

    values = [None, 0, -1, 7, (1 << 25) - 1, 1 << 25, -(1 << 25), 1 - (1 << 25), 2**31 - 1, -(2**31)]
    times = ["00:00:00", "00:00:00.000001", "12:30:00", "23:59:59.999999"]
    rows = [
        (i, f"{day} {at}", v) for i, (a, b, c) in enumerate((a, b, c) for a in values for b in values for c in values)
        for day in (("1969-12-30", "2024-02-29")[i % 2],)
        for at, v in ((times[i % 4], a), (times[i % 4], b), (times[i // 4 % 4], c))
    ]
    df = spark.createDataFrame(rows, "k int, at string, v int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    for keep in (True, False):
        both = df.groupBy("k").agg(
            newest_int(F.col("at"), F.col("v"), keep).alias("a"), newest_int_of_day(F.col("at"), F.col("v"), keep).alias("b")
        )
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def test_changes_are_made_in_compiled_code(inputs):
    rows = weekly_features(inputs([mission(-3), mission(-2)], [event(-2)], [poll(-2, 50)]), D, D + DAY * 20)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" in plan and "lambda" not in plan
