"""Declared schemas. Bronze leaves are text and get their type in Silver.

A declared numeric leaf would make the JSON reader reject a whole record for
one odd value; as text the record survives and only that value becomes null.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _record(*names: str, **nested: T.DataType) -> T.StructType:
    return T.StructType(_text(*names) + [T.StructField(k, v) for k, v in nested.items()])


def envelope(record: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("data", T.ArrayType(record))])


def paged(items: str, record: T.StructType) -> T.StructType:
    return envelope(_record(**{items: T.ArrayType(record)}))


MAINTENANCE_RECORD = _record(
    "maintenance_id", "robot_id", "service_ticket_id", "service_source",
    "maintenance_type", "maintenance_category", "maintenance_status",
    "reported_at", "started_at", "completed_at", "severity",
    "failure_detected", "failure_code", "component", "action_taken",
    "downtime_minutes", "technician_id", "comment", "created_at", "updated_at",
    parts_replaced=T.ArrayType(T.StringType()),
)

MISSION_RECORD = _record(
    "id", "robot", "robotSerialNumber", "operator", "areaNameList", "cleaningMode",
    "taskEndStatus", "completionPercentage", "durationSeconds",
    "plannedCleaningAreaSquareMeter", "actualCleaningAreaSquareMeter",
    "efficiencySquareMeterPerHour", "waterConsumptionLiter",
    "startBatteryPercentage", "endBatteryPercentage", "startTime", "endTime",
    consumablesResidualPercentage=_record("brush", "filter", "suctionBlade"),
)
MISSION_ITEMS = "robotTaskReports"

STATUS_RECORD = _record(
    "serialNumber", "_poll_ts", "taskState", "online", "speedKilometerPerHour", "navStatus",
    battery=_record("soc", "charging", "cycleTimes", "soh", "temperature1", "temperature2", "totalVoltage"),
    localizationInfo=_record(
        "localizationState", map=_record("id", "name"), mapPosition=_record("x", "y")
    ),
    device=_record(
        cleanWaterTank=_record("level"),
        recoveryWaterTank=_record("level"),
        rollingBrush=_record("usedLife", "lifeSpan"),
        rightSideBrush=_record("usedLife"),
        softSqueegee=_record("usedLife"),
        cleanWaterFilter=_record("usedLife"),
        hepaSensor=_record("usedLife"),
    ),
)

FLEET_RECORD = _record(
    "serialNumber", "name", "displayName", "modelFamilyCode", "modelTypeCode",
    "softwareVersion", "hardwareVersion", "online",
)
FLEET_ITEMS = "robots"


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def table(columns: str) -> T.StructType:
    """Schema from "name type, ..."; needs no running session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


MAINTENANCE = table(
    "maintenance_id string, robot_id string, service_ticket_id string, service_source string,"
    "maintenance_type string, maintenance_category string, maintenance_status string,"
    "reported_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz,"
    "severity string, failure_detected boolean, failure_code string, component string,"
    "action_taken string, parts_replaced array<string>, downtime_minutes int,"
    "technician_id string, comment string, created_at timestamp_ntz, updated_at timestamp_ntz,"
    "dt date"
)

MISSIONS = table(
    "report_id string, robot_serial_number string, robot_display_name string, operator string,"
    "map_name string, cleaning_mode string, task_end_status int, completion_percentage double,"
    "duration_seconds int, planned_area_m2 double, actual_area_m2 double,"
    "efficiency_m2_per_hour double, water_consumption_l double, start_battery_pct int,"
    "end_battery_pct int, battery_delta_pct int, brush_residual_pct int,"
    "filter_residual_pct int, suction_blade_residual_pct int,"
    "start_time timestamp_ntz, end_time timestamp_ntz, dt date"
)

STATUS = table(
    "serial_number string, poll_ts timestamp_ntz, task_state string, online boolean,"
    "speed_kmh double, battery_soc int, battery_charging boolean, battery_cycle_times int,"
    "battery_health string, battery_temp1 int, battery_temp2 int, total_voltage_mv int,"
    "localization_state string, map_id string, map_name string, pos_x int, pos_y int,"
    "nav_status string, clean_water_tank_pct int, recovery_water_tank_pct int,"
    "rolling_brush_used_life_h double, rolling_brush_lifespan_h int,"
    "right_side_brush_used_life_h double, soft_squeegee_used_life_h double,"
    "clean_water_filter_used_life_h double, hepa_sensor_used_life_h double, dt date"
)

FEATURES = table(
    "serial_number string, feature_date date, brush_residual_last int, filter_residual_last int,"
    "squeegee_residual_last int, missions_7d bigint, missions_30d bigint, area_30d double,"
    "area_90d double, avg_completion_7d double, avg_completion_30d double,"
    "avg_battery_drop_30d double, days_since_last_maintenance int, days_since_last_failure int,"
    "maint_count_30d bigint, maint_count_90d bigint, downtime_30d bigint,"
    "failure_count_90d bigint, corrective_count_90d bigint, battery_cycle_times_last int,"
    "battery_health_last string, avg_battery_soc_7d double, has_failure_next_30d int, dt date"
)

#: The ledger: what of Bronze has been loaded, as it was listed then.
LOADS = table("dataset string, load_dt date, files bigint, bytes bigint, newest bigint, noted_at timestamp_ntz")
