"""Bronze record to Silver row: rename, type, filter. One projection each."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.functions import narrow_int, parse_ts, to_bool, to_double

COMPLETED = "completed"

_CAST = {
    "string": lambda c: c.cast("string"),
    "int": narrow_int,
    "double": to_double,
    "boolean": to_bool,
    "timestamp_ntz": parse_ts,
    "array<string>": lambda c: c,
}


def _pick(fields: Iterable[tuple[str, str, str]]) -> list[Column]:
    """Columns from (source path, target name, target type)."""
    return [_CAST[kind](F.col(path)).alias(name) for path, name, kind in fields]


# Raw fields, the table columns they become, and their types.

_MAINTENANCE_FIELDS = [
    *[(c, c, "string") for c in (
        "maintenance_id", "robot_id", "service_ticket_id", "service_source",
        "maintenance_type", "maintenance_category", "maintenance_status",
    )],
    *[(c, c, "timestamp_ntz") for c in ("reported_at", "started_at", "completed_at")],
    ("severity", "severity", "string"),
    ("failure_detected", "failure_detected", "boolean"),
    *[(c, c, "string") for c in ("failure_code", "component", "action_taken")],
    ("parts_replaced", "parts_replaced", "array<string>"),
    ("downtime_minutes", "downtime_minutes", "int"),
    *[(c, c, "string") for c in ("technician_id", "comment")],
    *[(c, c, "timestamp_ntz") for c in ("created_at", "updated_at")],
]

_MISSION_FIELDS = [
    ("id", "report_id", "string"),
    ("robotSerialNumber", "robot_serial_number", "string"),
    ("robot", "robot_display_name", "string"),
    ("operator", "operator", "string"),
    ("areaNameList", "map_name", "string"),
    ("cleaningMode", "cleaning_mode", "string"),
    ("taskEndStatus", "task_end_status", "int"),
    ("completionPercentage", "completion_percentage", "double"),
    ("durationSeconds", "duration_seconds", "int"),
    ("plannedCleaningAreaSquareMeter", "planned_area_m2", "double"),
    ("actualCleaningAreaSquareMeter", "actual_area_m2", "double"),
    ("efficiencySquareMeterPerHour", "efficiency_m2_per_hour", "double"),
    ("waterConsumptionLiter", "water_consumption_l", "double"),
    ("startBatteryPercentage", "start_battery_pct", "int"),
    ("endBatteryPercentage", "end_battery_pct", "int"),
    ("consumablesResidualPercentage.brush", "brush_residual_pct", "int"),
    ("consumablesResidualPercentage.`filter`", "filter_residual_pct", "int"),
    ("consumablesResidualPercentage.suctionBlade", "suction_blade_residual_pct", "int"),
    ("startTime", "start_time", "timestamp_ntz"),
    ("endTime", "end_time", "timestamp_ntz"),
]

_STATUS_FIELDS = [
    ("serialNumber", "serial_number", "string"),
    ("_poll_ts", "poll_ts", "timestamp_ntz"),
    ("taskState", "task_state", "string"),
    ("online", "online", "boolean"),
    ("speedKilometerPerHour", "speed_kmh", "double"),
    ("battery.soc", "battery_soc", "int"),
    ("battery.charging", "battery_charging", "boolean"),
    ("battery.cycleTimes", "battery_cycle_times", "int"),
    ("battery.soh", "battery_health", "string"),
    ("battery.temperature1", "battery_temp1", "int"),
    ("battery.temperature2", "battery_temp2", "int"),
    ("battery.totalVoltage", "total_voltage_mv", "int"),
    ("localizationInfo.localizationState", "localization_state", "string"),
    ("localizationInfo.map.id", "map_id", "string"),
    ("localizationInfo.map.name", "map_name", "string"),
    ("localizationInfo.mapPosition.x", "pos_x", "int"),
    ("localizationInfo.mapPosition.y", "pos_y", "int"),
    ("navStatus", "nav_status", "string"),
    ("device.cleanWaterTank.level", "clean_water_tank_pct", "int"),
    ("device.recoveryWaterTank.level", "recovery_water_tank_pct", "int"),
    ("device.rollingBrush.usedLife", "rolling_brush_used_life_h", "double"),
    ("device.rollingBrush.lifeSpan", "rolling_brush_lifespan_h", "int"),
    ("device.rightSideBrush.usedLife", "right_side_brush_used_life_h", "double"),
    ("device.softSqueegee.usedLife", "soft_squeegee_used_life_h", "double"),
    ("device.cleanWaterFilter.usedLife", "clean_water_filter_used_life_h", "double"),
    ("device.hepaSensor.usedLife", "hepa_sensor_used_life_h", "double"),
]


def _dated(df: DataFrame, time_col: str) -> DataFrame:
    return df.withColumn("dt", F.to_date(time_col))


def flatten_maintenance(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Completed maintenance events with a completion time."""
    df = records.select(*keep, *_pick(_MAINTENANCE_FIELDS))
    df = df.where((F.col("maintenance_status") == COMPLETED) & F.col("completed_at").isNotNull())
    return _dated(df, "completed_at")


def flatten_missions(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Mission reports having an id and a start time."""
    df = records.select(*keep, *_pick(_MISSION_FIELDS))
    df = df.where(F.col("report_id").isNotNull() & F.col("start_time").isNotNull())
    delta = F.expr("try_subtract(end_battery_pct, start_battery_pct)")
    return _dated(df.withColumn("battery_delta_pct", delta), "start_time")


def flatten_status(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Telemetry polls having a serial number and a poll time."""
    df = records.select(*keep, *_pick(_STATUS_FIELDS))
    df = df.where(F.col("poll_ts").isNotNull() & F.col("serial_number").isNotNull())
    return _dated(df, "poll_ts")
