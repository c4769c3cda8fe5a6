"""The given tables in the roles of missions, service events and telemetry.

Each role is written twice, as a DataFrame and as the SQL text the oracle
queries start from. Measures become whole numbers, so that sums are exact in
any order on both engines.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Moves the telemetry month next to the as-of date used for the missions.
SHIFT_DAYS = 9369
ASOF = dt.date(1998, 6, 1)
ASOF_STATUS = dt.date(2024, 1, 25)
# Covers every ship date of the tables.
FIRST, LAST = dt.date(1995, 1, 1), dt.date(2001, 12, 31)


class Tables:
    """Lazy access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def usage(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("robot_serial_number"),
        F.col("l_shipdate").alias("start_time"),
        F.col("l_quantity").alias("actual_area_m2"),
        F.round(F.col("l_discount") * 100).cast("int").cast("double").alias("completion_percentage"),
        F.round(F.col("l_tax") * 100).cast("int").alias("battery_delta_pct"),
        F.col("l_linenumber").alias("brush_residual_pct"),
        F.col("l_quantity").cast("int").alias("filter_residual_pct"),
        (F.col("l_partkey") % 100).cast("int").alias("suction_blade_residual_pct"),
        F.round(F.col("l_extendedprice") * 100).alias("efficiency_m2_per_hour"),
        (F.col("l_orderkey") % 1000).cast("double").alias("water_consumption_l"),
    )


USAGE = """usage as (
  select l_orderkey as order_key, l_linenumber as line, l_suppkey as robot_serial_number,
    l_shipdate as start_time, l_quantity as actual_area_m2,
    round(l_discount * 100)::int::double as completion_percentage,
    round(l_tax * 100)::int as battery_delta_pct,
    l_linenumber as brush_residual_pct, l_quantity::int as filter_residual_pct,
    (l_partkey % 100)::int as suction_blade_residual_pct,
    round(l_extendedprice * 100) as efficiency_m2_per_hour,
    (l_orderkey % 1000)::double as water_consumption_l
  from lineitem)"""


def maintenance(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    return t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("maintenance_id"),
        F.col("l_suppkey").alias("robot_id"),
        F.col("l_shipdate").alias("completed_at"),
        (F.col("l_linestatus") == "F").alias("failure_detected"),
        F.when(line <= 3, "corrective").when(line <= 5, "preventive").otherwise("inspection").alias("maintenance_type"),
        F.when(line == 1, "low").when(line <= 4, "medium").otherwise("high").alias("severity"),
        F.concat(F.lit("part_"), (F.col("l_partkey") % 11).cast("string")).alias("component"),
        F.col("l_linestatus").alias("maintenance_category"),
        F.col("l_quantity").cast("int").alias("downtime_minutes"),
    )


MAINTENANCE = """maint as (
  select l_orderkey as maintenance_id, l_suppkey as robot_id, l_shipdate as completed_at,
    l_linestatus = 'F' as failure_detected,
    case when l_linenumber <= 3 then 'corrective' when l_linenumber <= 5 then 'preventive'
      else 'inspection' end as maintenance_type,
    case when l_linenumber = 1 then 'low' when l_linenumber <= 4 then 'medium'
      else 'high' end as severity,
    'part_' || (l_partkey % 11)::varchar as component,
    l_linestatus as maintenance_category, l_quantity::int as downtime_minutes
  from lineitem where l_returnflag = 'R')"""


def status(t: Tables, shifted: bool = False) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    at = F.col("ts")
    if shifted:
        at = at - F.expr(f"interval {SHIFT_DAYS} days")
    return t.events.select(
        F.col("user_id").alias("serial_number"),
        at.alias("poll_ts"),
        F.col("event_type").alias("task_state"),
        F.round("value").cast("int").alias("battery_soc"),
        F.when(F.col("event_type") != "signup", k).alias("battery_cycle_times"),
        F.when(k >= 85, "AGING").otherwise("HEALTHY").alias("battery_health"),
        k.alias("battery_temp1"),
    )


_K = r"regexp_extract(props, '\d+')::int"


def status_sql(shifted: bool = False) -> str:
    at = f"ts - interval {SHIFT_DAYS} day" if shifted else "ts"
    return f"""status as (
  select user_id as serial_number, {at} as poll_ts, event_type as task_state,
    round(value)::int as battery_soc,
    case when event_type <> 'signup' then {_K} end as battery_cycle_times,
    case when {_K} >= 85 then 'AGING' else 'HEALTHY' end as battery_health,
    {_K} as battery_temp1
  from events)"""


STATUS = status_sql()


def scored(t: Tables) -> DataFrame:
    """Scores in (0, 1) with a rare positive label."""
    return t.events.select(
        "event_id",
        (F.col("value") / (F.col("value") + 50.0)).alias("score"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


SCORED = """scored as (
  select event_id, value / (value + 50.0) as score,
    (event_type = 'error')::int as label
  from events)"""
