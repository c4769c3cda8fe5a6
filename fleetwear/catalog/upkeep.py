"""Queries of the runs over stored layers: what late rows make stale, what was never loaded."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwear import schemas
from fleetwear.catalog.features import backfill_sql, rounded
from fleetwear.catalog.registry import query
from fleetwear.catalog.roles import Tables, maintenance, status, usage
from fleetwear.plans.runs import Layout, build_gold, missed_loads, note_changes, refresh_gold
from fleetwear.plans.silver import MAINTENANCE, MISSIONS, STATUS, SilverTable
from fleetwear.plans.spans import reach, stale
from fleetwear.session import scratch_path, stage
from fleetwear.sinks import merge_changes, write_partitions
from fleetwear.sources import listing, read_window

FROM, TO = dt.date(1998, 5, 10), dt.date(1998, 6, 5)
#: Rows of these days that come a load later than the others.
LATE_FROM, LATE_TO = dt.date(1998, 5, 20), dt.date(1998, 5, 22)
_DAY = dt.timedelta(days=1)


def _stored(df: DataFrame, schema: T.StructType, **given: Column) -> DataFrame:
    """Rows in the shape of a table; columns that the role does not have are null."""
    return df.select(*[
        given.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def _tables(t: Tables) -> dict[SilverTable, DataFrame]:
    """The roles as stored tables, of the days that the feature dates can see."""
    rows = {
        MISSIONS: (_stored(
            usage(t), schemas.MISSIONS, dt=F.to_date("start_time"),
            report_id=F.concat_ws("-", *["order_key", "line", "robot_serial_number", "start_time", "efficiency_m2_per_hour", "actual_area_m2", "suction_blade_residual_pct"]),
        )),
        MAINTENANCE: _stored(
            maintenance(t), schemas.MAINTENANCE, dt=F.to_date("completed_at"),
            maintenance_id=F.xxhash64(*maintenance(t).columns), updated_at=F.col("completed_at"),
        ),
        STATUS: _stored(status(t, shifted=True), schemas.STATUS, dt=F.to_date("poll_ts")),
    }
    spans = {k: reach(k.name) for k in rows}
    return {k: df.where(F.col("dt").between(F.lit(FROM - _DAY * spans[k][1]), F.lit(TO + _DAY * spans[k][0]))) for k, df in rows.items()}


@query("features_refresh", backfill_sql(FROM, TO))
def features_refresh(t):
    """Features are built without the rows of three days; those come, and what they made stale is rebuilt."""
    path = scratch_path(t.spark, "layers")
    layout = Layout(f"{path}/bronze", f"{path}/silver", f"{path}/gold")
    late = F.col("dt").between(F.lit(LATE_FROM), F.lit(LATE_TO))
    rows = {k: df.persist() for k, df in _tables(t).items()}
    for table, df in rows.items():
        write_partitions(df.where(~late), layout.table(table.name), order=table.sort)
    build_gold(t.spark, layout, [(FROM, TO)])
    for table, df in rows.items():
        merge_changes(
            df.where(late), layout.table(table.name), table.schema, table.keys, table.order(), sort=table.sort,
            announce=lambda days, name=table.name: note_changes(t.spark, layout, name, days),
        )
        df.unpersist()
    refresh_gold(t.spark, layout)
    found = read_window(t.spark, layout.features, schemas.FEATURES).drop("dt")
    return rounded(found.withColumn("serial_number", F.col("serial_number").cast("long")))


@query("loads_missed", """select distinct 'robot_status' as dataset, ts::date as load_dt from events
where day(ts) % 3 = 0 or ts::date = (select max(ts::date) from events)""")
def loads_missed(t):
    """Every third day was never loaded, and the newest has got another file since."""
    root = scratch_path(t.spark, "arrived")
    day = F.to_date("ts")
    lines = t.events.select(F.lit("s").alias("source"), day.alias("load_dt"), F.to_json(F.struct("user_id", "ts")).alias("value"))
    write = lines.repartition("load_dt").write.partitionBy("source", "load_dt")
    write.text(root)
    found = listing(t.spark, root, "load_dt").withColumn("dataset", F.lit("robot_status"))
    ledger = stage(found.where(F.day("load_dt") % 3 != 0), "ledger")
    newest = lines.where(F.col("load_dt") == lines.agg(F.max("load_dt")).scalar())
    newest.coalesce(1).write.partitionBy("source", "load_dt").mode("append").text(root)
    again = listing(t.spark, root, "load_dt").withColumn("dataset", F.lit("robot_status"))
    return missed_loads(again, ledger).select("dataset", "load_dt")


_SPANS = """changed as (
  select 0 as back, 90 as ahead, l_shipdate::date as day from lineitem where l_shipdate >= date '1998-08-01' and l_quantity > 45
  union select 30, 90, l_shipdate::date from lineitem where l_shipdate >= date '1998-08-01' and l_returnflag = 'R'
  union select 0, 7, o_orderdate::date from orders where o_orderdate >= date '1996-02-01' and o_totalprice > 490000),
dates as (select distinct unnest(generate_series(day - back, day + ahead, interval 1 day))::date as feature_date from changed),
islands as (select feature_date, feature_date - row_number() over (order by feature_date)::int as island from dates)"""


@query("stale_spans", f"with {_SPANS} select min(feature_date) as first_date, max(feature_date) as last_date from islands group by island")
def stale_spans(t):
    """Feature dates that changed days of the tables reach, as spans without a gap."""
    ship, order = F.to_date("l_shipdate"), F.to_date("o_orderdate")
    lines = t.lineitem.where(ship >= "1998-08-01")
    changed = {
        MISSIONS.name: lines.where("l_quantity > 45").select(ship),
        MAINTENANCE.name: lines.where("l_returnflag = 'R'").select(ship),
        STATUS.name: t.orders.where((order >= "1996-02-01") & (F.col("o_totalprice") > 490000)).select(order),
    }
    days = {name: [r[0] for r in df.distinct().collect()] for name, df in changed.items()}  # bounded by the calendar
    return t.spark.createDataFrame(stale(days), "first_date date, last_date date")
