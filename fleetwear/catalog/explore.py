"""Exploratory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwear.catalog.registry import query
from fleetwear.catalog.roles import (
    FIRST,
    LAST,
    MAINTENANCE,
    STATUS,
    USAGE,
    maintenance,
    status,
    usage,
)
from fleetwear.functions import positive_zero, short_id
from fleetwear.operators import correlation, distribution, profile
from fleetwear.plans import explore

STATES = ("click", "error", "purchase", "signup", "view")
MONTHS = {
    f"{y}-{m:02}-01": f"m_{y}_{m:02}" for y in range(FIRST.year, LAST.year + 1) for m in range(1, 13)
}


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _corr_sql(a: str, b: str) -> str:
    return f"coalesce(round(corr({a}, {b}), 6), 0)"


# ------------------------------------------------------------------- fleet

_SERIAL = "case when l_suppkey % 3 = 0 then 'CB300-' else 'CB500-' end || l_suppkey::varchar"


@query(
    "fleet_summary",
    _with(USAGE.replace("l_suppkey as robot", f"{_SERIAL} as robot"))
    + """select robot_serial_number, count(*) as missions,
  round(sum(actual_area_m2) / 1e6, 3) as area_km2,
  round(avg(completion_percentage) * 100, 1) as avg_compl_pct,
  round(avg(battery_delta_pct), 1) as avg_batt_drop,
  case when robot_serial_number like 'CB300%' then 'W50H' else 'W1' end as model
from usage group by 1 order by missions desc, 1""",
)
def fleet_summary(t):
    key = F.col("robot_serial_number")
    prefix = F.when(key % 3 == 0, "CB300-").otherwise("CB500-")
    named = usage(t).withColumn("robot_serial_number", F.concat(prefix, key.cast("string")))
    return explore.fleet_summary(named)


@query(
    "short_id",
    """select o_orderkey, string_split(o_orderpriority, '-')[-1] as short_id,
  starts_with(o_orderpriority, '1-') as is_urgent from orders""",
)
def short_ids(t):
    priority = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", short_id(priority).alias("short_id"), priority.startswith("1-").alias("is_urgent")
    )


@query(
    "dataset_facts",
    _with(USAGE)
    + """select count(*) as n_rows, min(start_time::date) as first_date,
  max(start_time::date) as last_date, count(distinct robot_serial_number) as n_entities from usage""",
)
def dataset_facts(t):
    return profile.facts(usage(t), F.to_date("start_time"), "robot_serial_number")


_PROFILE_SQL = _with(USAGE, MAINTENANCE, """rows as (
  select robot_serial_number, count(*) as missions_total, sum(actual_area_m2) as area_total_m2,
    avg(completion_percentage) as avg_completion, avg(battery_delta_pct) as avg_battery_drop,
    avg(brush_residual_pct) as avg_brush_residual, avg(filter_residual_pct) as avg_filter_residual,
    avg(suction_blade_residual_pct) as avg_squeegee_residual,
    avg(efficiency_m2_per_hour) as avg_efficiency, avg(water_consumption_l) as avg_water
  from usage group by 1)""", """events as (
  select robot_id, count(*) as n, count(*) filter (where failure_detected) as f,
    sum(downtime_minutes)::bigint as d from maint group by 1)""", """robot_profile as (
  select r.*, coalesce(n, 0) as maint_events, coalesce(f, 0) as failure_count,
    coalesce(d, 0) as total_downtime
  from rows r left join events on robot_id = robot_serial_number)""")


@query("robot_profile", _PROFILE_SQL + "select * from robot_profile")
def robot_profile(t):
    return explore.robot_profile(usage(t), maintenance(t))


# ----------------------------------------------------------------- service

_FREQ = " union all ".join(
    f"select '{c}' as column_name, {c} as value, count(*) as n from maint group by {c}"
    for c in ("maintenance_type", "component", "maintenance_category")
)


@query("maint_frequency", _with(MAINTENANCE) + _FREQ)
def maint_frequency(t):
    cols = ["maintenance_type", "component", "maintenance_category"]
    return profile.frequency(maintenance(t), cols)


@query(
    "severity_counts",
    _with(MAINTENANCE)
    + """select (i - 1)::int as position, list_extract(d, i) as severity,
  (select count(*) from maint m where m.severity = list_extract(d, i)) as n
from (select ['low', 'medium', 'high', 'critical'] as d), (select unnest([1, 2, 3, 4]) as i)""",
)
def severity_counts(t):
    return profile.frequency_in(maintenance(t), "severity", explore.SEVERITIES)


@query(
    "crosstab_type_failure",
    _with(MAINTENANCE)
    + """select maintenance_type, count(*) filter (where failure_detected) as failed,
  count(*) filter (where not failure_detected) as not_failed,
  count(*) filter (where failure_detected is null) as other from maint group by 1""",
)
def crosstab_type_failure(t):
    values = {True: "failed", False: "not_failed"}
    return profile.crosstab(maintenance(t), ["maintenance_type"], "failure_detected", values)


@query(
    "crosstab_robot_month",
    _with(MAINTENANCE)
    + "select robot_id, "
    + ", ".join(
        f"count(*) filter (where date_trunc('month', completed_at)::date = date '{m}') as {n}"
        for m, n in MONTHS.items()
    )
    + f", count(*) filter (where completed_at is null or completed_at::date not between date '{FIRST}' and date '{LAST}')"
    + " as other from maint group by 1",
)
def crosstab_robot_month(t):
    return explore.services_by_month(maintenance(t), MONTHS)


@query(
    "crosstab_robot_health",
    _with(STATUS)
    + """select serial_number, count(*) filter (where battery_health = 'AGING') as aging,
  count(*) filter (where battery_health = 'HEALTHY') as healthy,
  count(*) filter (where battery_health is null or battery_health not in ('AGING', 'HEALTHY')) as other
from status group by 1""",
)
def crosstab_robot_health(t):
    values = {"AGING": "aging", "HEALTHY": "healthy"}
    return profile.crosstab(status(t), ["serial_number"], "battery_health", values)


@query(
    "failure_rate",
    _with(MAINTENANCE)
    + """select count(*) as n_events, count(*) filter (where failure_detected) as n_failures,
  count(*) filter (where failure_detected) * 100::double / count(*) as failure_pct from maint""",
)
def failure_rate(t):
    return explore.failure_rate(maintenance(t))


@query(
    "downtime_by_type",
    _with(MAINTENANCE)
    + """select maintenance_type, avg(downtime_minutes) as mean_downtime,
  sum(downtime_minutes)::bigint as total_downtime from maint group by 1""",
)
def downtime_by_type(t):
    return explore.downtime_by_type(maintenance(t))


@query(
    "downtime_box",
    _with(MAINTENANCE, """q as (
  select severity, count(*) as n, quantile_cont(downtime_minutes, 0.25) as q1,
    quantile_cont(downtime_minutes, 0.5) as median, quantile_cont(downtime_minutes, 0.75) as q3
  from maint where downtime_minutes > 0 group by 1)""")
    + """select q.severity, n, q1, median, q3,
  least(min(downtime_minutes)::double, any_value(q1)) as whisker_lo,
  greatest(max(downtime_minutes)::double, any_value(q3)) as whisker_hi
from q join maint m on m.severity = q.severity
where downtime_minutes > 0 and downtime_minutes between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)
group by q.severity, n, q1, median, q3""",
)
def downtime_box(t):
    stopped = maintenance(t).where("downtime_minutes > 0")
    return distribution.box_summary(stopped, F.col("downtime_minutes"), "severity")


@query(
    "downtime_box_unknown",
    _with(MAINTENANCE, """known as (select nullif(severity, 'low') as severity, downtime_minutes from maint where downtime_minutes > 0)""",
          """q as (select severity, count(*) as n, quantile_cont(downtime_minutes, 0.25) as q1,
    quantile_cont(downtime_minutes, 0.5) as median, quantile_cont(downtime_minutes, 0.75) as q3 from known group by 1)""")
    + """select q.severity, n, q1, median, q3,
  least(min(downtime_minutes)::double, any_value(q1)) as whisker_lo,
  greatest(max(downtime_minutes)::double, any_value(q3)) as whisker_hi
from q join known k on k.severity is not distinct from q.severity
where downtime_minutes between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)
group by q.severity, n, q1, median, q3""",
)
def downtime_box_unknown(t):
    """Events of unknown severity are a group of their own."""
    stopped = maintenance(t).where("downtime_minutes > 0").withColumn("severity", F.nullif("severity", F.lit("low")))
    return distribution.box_summary(stopped, F.col("downtime_minutes"), "severity")


# ---------------------------------------------------------------- missions


@query(
    "daily_activity",
    _with(USAGE, MAINTENANCE)
    + """select u.*, coalesce(maint_count, 0) as maint_count from (
  select start_time::date as day, count(*) as missions, sum(actual_area_m2) as area_m2
  from usage group by 1) u
left join (select completed_at::date as day, count(*) as maint_count from maint group by 1) m
  on m.day = u.day""",
)
def daily_activity(t):
    return explore.daily_activity(usage(t), maintenance(t))


_DESCRIBED = ("completion_percentage", "battery_delta_pct", "actual_area_m2", "efficiency_m2_per_hour")


@query(
    "describe_missions",
    _with(USAGE)
    + " union all ".join(
        f"select '{c}' as column_name, min({c})::double as min, median({c})::double as median, "
        f"avg({c}) as mean, max({c})::double as max from usage"
        for c in _DESCRIBED
    ),
)
def describe_missions(t):
    return distribution.describe(usage(t), _DESCRIBED)


@query(
    "histogram",
    _with(USAGE, """r as (
  select min(efficiency_m2_per_hour) as lo, max(efficiency_m2_per_hour) as hi from usage)""", """b as (
  select least(floor((efficiency_m2_per_hour - lo) / ((hi - lo) / 30))::int, 29) as bin,
    count(*) as n from usage, r group by 1)""")
    + """select i::int as bin, lo + (hi - lo) / 30 * i as bin_lo, lo + (hi - lo) / 30 * (i + 1) as bin_hi,
  coalesce(n, 0) as n
from range(30) d(i) cross join r left join b on b.bin = i""",
)
def histogram(t):
    return distribution.histogram(usage(t), F.col("efficiency_m2_per_hour"), 30)


_MEASURES = ("completion_percentage", "battery_delta_pct", "actual_area_m2", "water_consumption_l")


@query(
    "mission_histograms",
    _with(USAGE, "long as (" + " union all ".join(
        f"select '{c}' as column_name, {c}::double as v from usage" for c in _MEASURES
    ) + ")", """r as (
  select column_name, min(v) as lo, max(v) as hi from long group by 1)""", """b as (
  select column_name, least(floor((v - lo) / ((hi - lo) / 30))::int, 29) as bin, count(*) as n
  from long join r using (column_name) group by 1, 2)""")
    + """select r.column_name, i::int as bin, lo + (hi - lo) / 30 * i as bin_lo,
  lo + (hi - lo) / 30 * (i + 1) as bin_hi, coalesce(n, 0) as n
from r cross join range(30) d(i) left join b on b.bin = i and b.column_name = r.column_name""",
)
def mission_histograms(t):
    rows = distribution.long_form(usage(t), _MEASURES)
    return distribution.histogram_by(rows, F.col("value"), "column_name", _MEASURES, 30).drop("density")


@query(
    "wear_daily",
    _with(USAGE)
    + """select robot_serial_number, start_time::date as day, avg(brush_residual_pct) as brush_residual_pct,
  avg(filter_residual_pct) as filter_residual_pct,
  avg(suction_blade_residual_pct) as suction_blade_residual_pct from usage group by 1, 2""",
)
def wear_daily(t):
    return explore.wear_daily(usage(t))


@query(
    "completion_by_wear",
    _with(USAGE)
    + """select case when filter_residual_pct >= 20 then 'normal' else 'worn' end as band,
  count(*) as missions, avg(completion_percentage) as avg_completion from usage group by 1""",
)
def completion_by_wear(t):
    return explore.completion_by_wear(usage(t), "filter_residual_pct")


# --------------------------------------------------------------- telemetry


@query(
    "wear_fleet_daily",
    _with(STATUS)
    + "select poll_ts::date as day, avg(battery_temp1) as mean_battery_temp1 from status group by 1",
)
def wear_fleet_daily(t):
    return explore.fleet_daily_mean(status(t), "battery_temp1")


@query(
    "hourly_profile",
    _with(STATUS, "h as (select *, hour(poll_ts)::int as hour from status)")
    + """select serial_number, hour, avg(battery_soc) as mean_soc from h
group by grouping sets ((serial_number, hour), (hour))""",
)
def hourly_profile(t):
    return explore.hourly_profile(status(t))


@query(
    "state_share_hour",
    _with(STATUS)
    + "select hour(poll_ts)::int as hour, "
    + ", ".join(
        f"count(*) filter (where task_state = '{s}') * 100::double / count(*) as {s}" for s in STATES
    )
    + f", count(*) filter (where task_state is null or task_state not in {STATES}) * 100::double / count(*) as other"
    + " from status group by 1",
)
def state_share_hour(t):
    polls = status(t).withColumn("hour", F.hour("poll_ts"))
    return profile.shares_of(polls, ["hour"], "task_state", {s: s for s in STATES})


@query(
    "state_share",
    _with(STATUS)
    + """select task_state, count(*) as n,
  count(*) * 100::double / sum(count(*)) over () as pct from status group by 1""",
)
def state_share(t):
    return profile.share(status(t), ["task_state"])


@query(
    "health_share_by_state",
    _with(STATUS)
    + """select task_state, battery_health, count(*) as n,
  count(*) * 100::double / sum(count(*)) over (partition by task_state) as pct from status group by 1, 2""",
)
def health_share_by_state(t):
    return profile.share(status(t), ["battery_health"], within=["task_state"])


@query(
    "temp_mean_by_state",
    _with(STATUS) + "select task_state, avg(battery_temp1) as mean_temp from status group by 1",
)
def temp_mean_by_state(t):
    return profile.profile(status(t), ["task_state"], mean_temp=profile.mean("battery_temp1"))


@query(
    "temp_by_state",
    _with(STATUS, """r as (
  select task_state, min(battery_soc)::double as lo, max(battery_soc)::double as hi, count(*) as size
  from status where task_state in ('click', 'view') group by 1)""", """b as (
  select task_state, least(floor((battery_soc - lo) / ((hi - lo) / 20))::int, 19) as bin, count(*) as n
  from status join r using (task_state) group by 1, 2)""")
    + """select r.task_state, i::int as bin, lo + (hi - lo) / 20 * i as bin_lo,
  lo + (hi - lo) / 20 * (i + 1) as bin_hi, coalesce(n, 0) as n,
  round(coalesce(n, 0) / (size * ((hi - lo) / 20)), 12) as density
from r cross join range(20) d(i) left join b on b.bin = i and b.task_state = r.task_state""",
)
def temp_by_state(t):
    rows = distribution.histogram_by(
        status(t), F.col("battery_soc"), "task_state", ["click", "view"], 20
    )
    return rows.withColumn("density", F.round("density", 12))


# ------------------------------------------------- usage against maintenance

_WEEKLY_SQL = _with(USAGE, MAINTENANCE, """weekly as (
  select u.*, coalesce(n, 0) as maint_events, coalesce(n, 0) > 0 as has_maint from (
    select robot_serial_number, date_trunc('week', start_time::date)::date as week,
      count(*) as missions, sum(actual_area_m2) as area_m2 from usage group by 1, 2) u
  left join (
    select robot_id, date_trunc('week', completed_at::date)::date as week, count(*) as n
    from maint group by 1, 2) m on m.robot_id = u.robot_serial_number and m.week = u.week)""")


def _weekly(t):
    return explore.weekly_usage_vs_maintenance(usage(t), maintenance(t))


@query("weekly_usage_vs_maint", _WEEKLY_SQL + "select * from weekly")
def weekly_usage_vs_maint(t):
    return _weekly(t)


@query(
    "usage_by_maint_flag",
    _WEEKLY_SQL
    + "select has_maint, avg(missions) as missions, avg(area_m2) / 1e6 as area_km2 from weekly group by 1",
)
def usage_by_maint_flag(t):
    return explore.usage_by_maintenance_flag(_weekly(t))


@query(
    "corr_pair",
    _WEEKLY_SQL + f"select {_corr_sql('missions', 'maint_events')} as r from weekly",
)
def corr_pair(t):
    return correlation.corr_pair(_weekly(t), "missions", "maint_events").select(
        positive_zero(F.round("r", 6)).alias("r")
    )


@query(
    "corr_pair_area",
    _WEEKLY_SQL + f"select {_corr_sql('area_m2', 'maint_events')} as r from weekly",
)
def corr_pair_area(t):
    return correlation.corr_pair(_weekly(t), "area_m2", "maint_events").select(
        positive_zero(F.round("r", 6)).alias("r")
    )


@query(
    "corr_matrix",
    _PROFILE_SQL
    + " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, {_corr_sql(a, b)} as r from robot_profile"
        for a in explore.PROFILE_COLUMNS
        for b in explore.PROFILE_COLUMNS
    ),
)
def corr_matrix(t):
    rows = correlation.corr_matrix(
        explore.robot_profile(usage(t), maintenance(t)), explore.PROFILE_COLUMNS
    )
    return rows.withColumn("r", positive_zero(F.round("r", 6)))


_OTHERS = [c for c in explore.PROFILE_COLUMNS if c != "failure_count"]


@query(
    "corr_target",
    _PROFILE_SQL
    + ", c as ("
    + " union all ".join(
        f"select '{a}' as column_name, {_corr_sql(a, 'failure_count')} as r from robot_profile"
        for a in _OTHERS
    )
    + ") select * from c",
)
def corr_target(t):
    rows = correlation.corr_target(
        explore.robot_profile(usage(t), maintenance(t)), _OTHERS, "failure_count"
    )
    return rows.withColumn("r", positive_zero(F.round("r", 6)))
