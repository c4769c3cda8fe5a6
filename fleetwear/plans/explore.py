"""Exploratory tables over missions, service events and telemetry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.functions import model_line, ratio, share_pct
from fleetwear.operators.profile import crosstab, left_fill, mean, profile

# Severities in rising order; residual below which a part is worn.
SEVERITIES = ("low", "medium", "high", "critical")
WORN_BELOW = 20

# Names and order of the device profile's columns.
PROFILE_COLUMNS = (
    "missions_total", "area_total_m2", "avg_completion", "avg_battery_drop",
    "avg_brush_residual", "avg_filter_residual", "avg_squeegee_residual",
    "avg_efficiency", "maint_events", "failure_count", "total_downtime",
)


def _n() -> Column:
    return F.count(F.lit(1))


def fleet_summary(usage: DataFrame) -> DataFrame:
    """Missions, area, completion and battery change per device, busiest first."""
    rows = profile(
        usage, ["robot_serial_number"],
        missions=_n(),
        area_km2=F.round(F.sum("actual_area_m2") / 1e6, 3),
        avg_compl_pct=F.round(mean("completion_percentage") * 100, 1),
        avg_batt_drop=F.round(mean("battery_delta_pct"), 1),
    )
    rows = rows.withColumn("model", model_line(F.col("robot_serial_number")))
    return rows.orderBy(F.desc("missions"), "robot_serial_number")


def failure_rate(maintenance: DataFrame) -> DataFrame:
    failures = F.count_if("failure_detected")
    return maintenance.agg(
        _n().alias("n_events"),
        failures.alias("n_failures"),
        share_pct(failures, _n()).alias("failure_pct"),
    )


def daily_activity(usage: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Missions, area and service events per mission day."""
    days = profile(
        usage.withColumn("day", F.to_date("start_time")), ["day"],
        missions=_n(), area_m2=F.sum("actual_area_m2"),
    )
    events = profile(
        maintenance.withColumn("day", F.to_date("completed_at")), ["day"], maint_count=_n()
    )
    return left_fill(days, events, ["day"], ["maint_count"])


def wear_daily(usage: DataFrame) -> DataFrame:
    """Mean residuals per device and day."""
    return profile(
        usage.withColumn("day", F.to_date("start_time")), ["robot_serial_number", "day"],
        brush_residual_pct=mean("brush_residual_pct"),
        filter_residual_pct=mean("filter_residual_pct"),
        suction_blade_residual_pct=mean("suction_blade_residual_pct"),
    )


def fleet_daily_mean(status: DataFrame, measure: str) -> DataFrame:
    days = status.withColumn("day", F.to_date("poll_ts"))
    return profile(days, ["day"], **{f"mean_{measure}": mean(measure)})


def hourly_profile(status: DataFrame) -> DataFrame:
    """Mean charge per device and hour, and for the fleet (serial null).

    The fleet level is added on the hourly sums, not on the raw polls.
    """
    soc = F.col("battery_soc")
    hours = profile(
        status.withColumn("hour", F.hour("poll_ts")), ["serial_number", "hour"],
        total=F.sum(soc), n=F.count(soc),
    )
    serial, hour = F.col("serial_number"), F.col("hour")
    levels = hours.groupingSets([[serial, hour], [hour]], serial, hour)
    return levels.agg(ratio(F.sum("total"), F.sum("n")).alias("mean_soc"))


def weekly_usage_vs_maintenance(usage: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Usage and service events per device and week (Monday to Sunday)."""
    weeks = profile(
        usage.withColumn("week", F.trunc(F.to_date("start_time"), "week")),
        ["robot_serial_number", "week"],
        missions=_n(), area_m2=F.sum("actual_area_m2"),
    )
    events = profile(
        maintenance.select(
            F.col("robot_id").alias("robot_serial_number"),
            F.trunc(F.to_date("completed_at"), "week").alias("week"),
        ),
        ["robot_serial_number", "week"],
        maint_events=_n(),
    )
    rows = left_fill(weeks, events, ["robot_serial_number", "week"], ["maint_events"])
    return rows.withColumn("has_maint", F.col("maint_events") > 0)


def usage_by_maintenance_flag(weekly: DataFrame) -> DataFrame:
    return profile(
        weekly, ["has_maint"], missions=mean("missions"), area_km2=mean("area_m2") / 1e6
    )


def robot_profile(usage: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Totals and means per device, with its service totals (0 if none)."""
    rows = profile(
        usage, ["robot_serial_number"],
        missions_total=_n(),
        area_total_m2=F.sum("actual_area_m2"),
        avg_completion=mean("completion_percentage"),
        avg_battery_drop=mean("battery_delta_pct"),
        avg_brush_residual=mean("brush_residual_pct"),
        avg_filter_residual=mean("filter_residual_pct"),
        avg_squeegee_residual=mean("suction_blade_residual_pct"),
        avg_efficiency=mean("efficiency_m2_per_hour"),
        avg_water=mean("water_consumption_l"),
    )
    events = profile(
        maintenance.withColumnRenamed("robot_id", "robot_serial_number"), ["robot_serial_number"],
        maint_events=_n(),
        failure_count=F.count_if("failure_detected"),
        total_downtime=F.sum("downtime_minutes"),
    )
    return left_fill(
        rows, events, ["robot_serial_number"], ["maint_events", "failure_count", "total_downtime"]
    )


def services_by_month(maintenance: DataFrame, months: Mapping[object, str]) -> DataFrame:
    month = F.trunc(F.to_date("completed_at"), "month").cast("string")
    return crosstab(maintenance.withColumn("month", month), ["robot_id"], "month", months)


def completion_by_wear(usage: DataFrame, residual: str = "brush_residual_pct") -> DataFrame:
    band = F.when(F.col(residual) >= WORN_BELOW, "normal").when(F.col(residual) < WORN_BELOW, "worn")
    rows = usage.withColumn("band", band).where("band is not null")
    return profile(rows, ["band"], missions=_n(), avg_completion=mean("completion_percentage"))


def downtime_by_type(maintenance: DataFrame) -> DataFrame:
    return profile(
        maintenance, ["maintenance_type"],
        mean_downtime=mean("downtime_minutes"), total_downtime=F.sum("downtime_minutes"),
    )
