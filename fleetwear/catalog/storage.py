"""Source, Silver, deduplication and sink queries.

The raw documents are derived from the given tables, written to the shared
scratch folder, and read back through the scans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwear import schemas
from fleetwear.catalog.registry import query
from fleetwear.catalog.roles import Tables
from fleetwear.operators.dedup import dedup
from fleetwear.plans.silver import MAINTENANCE, MISSIONS, STATUS, silver
from fleetwear.session import scratch_path
from fleetwear.sinks import merge_partitions, report, table_report, write_partitions, write_reported
from fleetwear.sources import (
    date_window,
    read_envelope,
    read_jsonl,
    read_paged,
    read_partitions,
    read_window,
)

PAGE_ROWS = 1000
PAGES_PER_FILE = 100
CODEC = "lz4"  # of the documents written here


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


# --------------------------------------------------------- bronze documents


def _records(df: DataFrame, record: T.StructType, **given: Column) -> DataFrame:
    """Rows of a declared raw record; fields not given are null."""
    return df.select(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in record.fields
        ]
    )


def _iso(ts: str) -> Column:
    return F.concat(F.replace(F.col(ts).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def maintenance_records(t: Tables) -> DataFrame:
    """Service events: several versions per order, some not completed."""
    return _records(
        t.lineitem, schemas.MAINTENANCE_RECORD,
        maintenance_id=F.col("l_orderkey"),
        robot_id=F.col("l_suppkey"),
        maintenance_type=F.col("l_returnflag"),
        maintenance_status=F.when(F.col("l_linestatus") == "F", "completed").otherwise("planned"),
        completed_at=F.when(F.col("l_linenumber") > 1, _iso("l_shipdate")),
        failure_detected=F.when(F.col("l_returnflag") == "R", "true").otherwise("false"),
        downtime_minutes=F.when(F.col("l_linenumber") == 7, "unknown").otherwise(F.col("l_extendedprice").cast("string")),
        updated_at=_iso("l_shipdate"),
        parts_replaced=F.array(F.col("l_partkey").cast("string")),
        service_ticket_id=F.concat(F.lit("T"), F.col("l_partkey").cast("string")),
        service_source=F.col("l_linestatus"),
        maintenance_category=F.when(F.col("l_linenumber") <= 3, "near").otherwise("far"),
        reported_at=_iso("l_shipdate"),
        started_at=F.when(F.col("l_linenumber") != 2, _iso("l_shipdate")),
        severity=F.col("l_returnflag"),
        failure_code=F.when(F.col("l_returnflag") == "R", F.concat(F.lit("E"), F.col("l_linenumber").cast("string"))),
        component=F.concat(F.lit("part_"), (F.col("l_partkey") % 11).cast("string")),
        action_taken=F.lit("swap"),
        technician_id=F.col("l_suppkey"),
        comment=F.when(F.col("l_linenumber") == 3, "note"),
        created_at=_iso("l_shipdate"),
    )


def mission_records(t: Tables) -> DataFrame:
    """Mission reports: repeated ids, some ids and start times missing."""
    return _records(
        t.lineitem, schemas.MISSION_RECORD,
        id=F.when(F.col("l_quantity") < 50, F.concat_ws("-", "l_orderkey", "l_linenumber")),
        robotSerialNumber=F.col("l_suppkey"),
        completionPercentage=F.col("l_discount") + 0.0,
        actualCleaningAreaSquareMeter=F.col("l_quantity"),
        startBatteryPercentage=F.lit("90"),
        endBatteryPercentage=F.when(F.col("l_linenumber") < 7, F.col("l_quantity").cast("string")).otherwise("n/a"),
        taskEndStatus=F.col("l_extendedprice"),
        startTime=F.when(F.col("l_returnflag") != "N", _iso("l_shipdate")),
        consumablesResidualPercentage=F.struct(
            F.col("l_linenumber").cast("string").alias("brush"),
            F.col("l_tax").cast("string").alias("filter"),
            F.lit("3000000000").alias("suctionBlade"),
        ),
        robot=F.concat(F.lit("R"), F.col("l_suppkey").cast("string")),
        operator=F.concat(F.lit("op"), F.col("l_linenumber").cast("string")),
        areaNameList=F.lit("hall"),
        cleaningMode=F.col("l_linestatus"),
        durationSeconds=F.col("l_partkey"),
        plannedCleaningAreaSquareMeter=F.col("l_quantity") + 1,
        efficiencySquareMeterPerHour=F.col("l_extendedprice"),
        waterConsumptionLiter=F.col("l_tax"),
        endTime=F.when(F.col("l_linenumber") > 1, _iso("l_shipdate")),
    )


def status_records(t: Tables) -> DataFrame:
    """Polls with nested battery and map fields."""

    def filled(name: str, **given: Column) -> Column:
        fields = schemas.STATUS_RECORD[name].dataType.fields
        return F.struct(
            *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        )

    k = F.get_json_object("props", "$.k")
    place = F.struct(k.alias("x"), F.lit("x").alias("y"))
    area = F.struct(F.col("user_id").cast("string").alias("id"), F.lit("hall").alias("name"))
    value = F.col("value").cast("string")
    level, used = F.struct(k.alias("level")), F.struct(value.alias("usedLife"))
    return _records(
        t.events, schemas.STATUS_RECORD,
        serialNumber=F.col("user_id"),
        _poll_ts=F.when(F.col("event_type") != "view", _iso("ts")),
        taskState=F.col("event_type"),
        online=F.when(F.col("event_type") == "error", "false").otherwise("true"),
        speedKilometerPerHour=value,
        navStatus=F.concat(F.lit("n"), k),
        battery=filled(
            "battery", soc=value, cycleTimes=k, charging=F.when(F.col("event_type") == "purchase", "true"),
            soh=F.when(F.col("event_type") == "error", "AGING"), temperature1=k, temperature2=F.concat(F.lit("1"), k), totalVoltage=value,
        ),
        localizationInfo=filled("localizationInfo", localizationState=F.lit("ok"), map=area, mapPosition=place),
        device=filled(
            "device", cleanWaterTank=level, recoveryWaterTank=level, rollingBrush=F.struct(value.alias("usedLife"), k.alias("lifeSpan")),
            rightSideBrush=used, softSqueegee=used, cleanWaterFilter=used, hepaSensor=used,
        ),
    )


def _dealt(records: DataFrame, rows: int, name: str) -> DataFrame:
    """Records as ``rec``, ``rows`` consecutive ones under one number, and about as many tasks as numbers.

    Dealt out before they are gathered: a map task that gathered for itself
    would hold all of its records at once.
    """
    number = F.floor(F.monotonically_increasing_id() / PAGE_ROWS)
    tasks = max(1, -(-records.count() // rows))
    numbered = records.select(number.alias("page"), F.struct(*records.columns).alias("rec"))
    return numbered.withColumn(name, F.floor(F.col("page") / (rows // PAGE_ROWS))).repartition(tasks, name)


def _write_documents(docs: DataFrame, path: str) -> None:
    docs.write.option("maxRecordsPerFile", 1).option("compression", CODEC).json(path)


def write_envelopes(records: DataFrame, path: str) -> None:
    docs = _dealt(records, PAGE_ROWS * PAGES_PER_FILE, "file").groupBy("file").agg(F.collect_list("rec").alias("data"))
    _write_documents(docs.select(F.struct(F.lit("v1").alias("schema")).alias("_meta"), "data"), path)


def write_paged(records: DataFrame, path: str, items: str) -> None:
    dealt = _dealt(records, PAGE_ROWS * PAGES_PER_FILE, "file")
    pages = dealt.groupBy("file", "page").agg(F.collect_list("rec").alias(items))
    page = F.struct(items, F.col("page").alias("number")).alias("one")
    _write_documents(pages.select("file", page).groupBy("file").agg(F.collect_list("one").alias("data")).drop("file"), path)


# -------------------------------------------------------------- oracle texts



_MAINT_ROWS = """rows as (
  select l_orderkey::varchar as maintenance_id, l_suppkey::varchar as robot_id, 'T' || l_partkey::varchar as service_ticket_id,
    l_linestatus as service_source, l_returnflag as maintenance_type,
    case when l_linenumber <= 3 then 'near' else 'far' end as maintenance_category, 'completed' as maintenance_status,
    l_shipdate as reported_at, case when l_linenumber <> 2 then l_shipdate end as started_at, l_shipdate as completed_at,
    l_returnflag as severity, l_returnflag = 'R' as failure_detected,
    case when l_returnflag = 'R' then 'E' || l_linenumber::varchar end as failure_code,
    'part_' || (l_partkey % 11)::varchar as component, 'swap' as action_taken, [l_partkey::varchar] as parts_replaced,
    case when l_linenumber = 7 then null else trunc(l_extendedprice)::int end as downtime_minutes,
    l_suppkey::varchar as technician_id, case when l_linenumber = 3 then 'note' end as comment,
    l_shipdate as created_at, l_shipdate as updated_at, l_shipdate::date as dt
  from lineitem where l_linestatus = 'F' and l_linenumber > 1)"""

_MISSION_ROWS = """rows as (
  select l_orderkey::varchar || '-' || l_linenumber::varchar as report_id,
    l_suppkey::varchar as robot_serial_number, 'R' || l_suppkey::varchar as robot_display_name,
    'op' || l_linenumber::varchar as operator, 'hall' as map_name, l_linestatus as cleaning_mode,
    trunc(l_extendedprice)::int as task_end_status, l_discount + 0.0::double as completion_percentage,
    l_partkey::int as duration_seconds, l_quantity + 1 as planned_area_m2, l_quantity as actual_area_m2,
    l_extendedprice as efficiency_m2_per_hour, l_tax as water_consumption_l, 90 as start_battery_pct,
    case when l_linenumber < 7 then l_quantity::int end as end_battery_pct,
    case when l_linenumber < 7 then l_quantity::int - 90 end as battery_delta_pct,
    l_linenumber as brush_residual_pct, 0 as filter_residual_pct,
    null::int as suction_blade_residual_pct, l_shipdate as start_time,
    case when l_linenumber > 1 then l_shipdate end as end_time, l_shipdate::date as dt
  from lineitem where l_quantity < 50 and l_returnflag <> 'N')"""

_STATUS_ROWS = r"""rows as (
  select user_id::varchar as serial_number, ts as poll_ts, event_type as task_state,
    event_type <> 'error' as online, value as speed_kmh, trunc(value)::int as battery_soc,
    case when event_type = 'purchase' then true end as battery_charging, k as battery_cycle_times,
    case when event_type = 'error' then 'AGING' end as battery_health, k as battery_temp1, ('1' || k::varchar)::int as battery_temp2,
    trunc(value)::int as total_voltage_mv, 'ok' as localization_state, user_id::varchar as map_id, 'hall' as map_name,
    k as pos_x, null::int as pos_y, 'n' || k::varchar as nav_status, k as clean_water_tank_pct, k as recovery_water_tank_pct,
    value as rolling_brush_used_life_h, k as rolling_brush_lifespan_h, value as right_side_brush_used_life_h,
    value as soft_squeegee_used_life_h, value as clean_water_filter_used_life_h, value as hepa_sensor_used_life_h, ts::date as dt
  from (select *, regexp_extract(props, '\d+')::int as k from events) where event_type <> 'view')"""


def _first(rows: str, keys: str, order: str, columns: str = "*") -> str:
    return f"""select {columns} from (select *, row_number() over (partition by {keys} order by {order}) as _rank
  from {rows}) where _rank = 1"""


# All columns of the tables, in their order: it decides between rows of equal rank.
_MAINT_COLS, _MISSION_COLS, _STATUS_COLS = (
    tuple(x.fieldNames()) for x in (schemas.MAINTENANCE, schemas.MISSIONS, schemas.STATUS)
)


def _ties(cols: tuple[str, ...], keys: tuple[str, ...]) -> str:
    return ", ".join(f"{c} nulls first" for c in cols if c not in keys)


_MAINT_SQL = _with(_MAINT_ROWS) + _first(
    "rows", "maintenance_id", "updated_at desc, " + _ties(_MAINT_COLS, ("maintenance_id",)),
    "* exclude (_rank, parts_replaced), parts_replaced[1] as first_part",
)
_MISSION_SQL = _with(_MISSION_ROWS) + _first(
    "rows", "report_id", "start_time, " + _ties(_MISSION_COLS, ("report_id",)), "* exclude (_rank)"
)
_STATUS_SQL = _with(_STATUS_ROWS) + _first(
    "rows", "serial_number, poll_ts", _ties(_STATUS_COLS, ("serial_number", "poll_ts")),
    "* exclude (_rank)",
)


def _maintenance_out(df: DataFrame) -> DataFrame:
    first = F.col("parts_replaced")[0].alias("first_part")
    return df.select(*[c for c in _MAINT_COLS if c != "parts_replaced"], first)


# ------------------------------------------------------------------- scans


@query("scan_envelope", _MAINT_SQL)
def scan_envelope(t):
    path = scratch_path(t.spark, "envelope")
    write_envelopes(maintenance_records(t), path)
    records = read_envelope(t.spark, path, schemas.MAINTENANCE_RECORD)
    return _maintenance_out(silver(records, MAINTENANCE))


@query("scan_paged", _MISSION_SQL)
def scan_paged(t):
    path = scratch_path(t.spark, "paged")
    write_paged(mission_records(t), path, schemas.MISSION_ITEMS)
    records = read_paged(t.spark, path, schemas.MISSION_RECORD, schemas.MISSION_ITEMS)
    return silver(records, MISSIONS).select(*_MISSION_COLS)


@query("scan_jsonl_malformed", _STATUS_SQL)
def scan_jsonl_malformed(t):
    path = scratch_path(t.spark, "lines")
    records = status_records(t)
    line = F.to_json(F.struct(*records.columns))
    # A second, broken copy of each line ends after ten characters.
    broken = F.left(line, F.lit(10))
    records.select(F.explode(F.array(line, broken)).alias("value")).write.text(path)
    return silver(read_jsonl(t.spark, path, schemas.STATUS_RECORD), STATUS).select(*_STATUS_COLS)


@query("silver_maintenance", _MAINT_SQL)
def silver_maintenance(t):
    return _maintenance_out(silver(maintenance_records(t), MAINTENANCE))


@query("silver_missions", _MISSION_SQL)
def silver_missions(t):
    return silver(mission_records(t), MISSIONS).select(*_MISSION_COLS)


@query("silver_status", _STATUS_SQL)
def silver_status(t):
    return silver(status_records(t), STATUS).select(*_STATUS_COLS)


# ------------------------------------------------------------ deduplication

_LINE_COLS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select(*_LINE_COLS)


def _dedup_sql(keys: tuple[str, ...], order: str = "") -> str:
    return _first(
        f"(select {', '.join(_LINE_COLS)} from lineitem)", ", ".join(keys),
        order + _ties(_LINE_COLS, keys), "* exclude (_rank)",
    )


@query("dedup_latest", _dedup_sql(("l_orderkey",), "l_shipdate desc, "))
def dedup_latest(t):
    return dedup(_lines(t), ["l_orderkey"], [F.col("l_shipdate").desc_nulls_last()])


@query("dedup_first", _dedup_sql(("l_orderkey", "l_linenumber"), "l_shipdate, "))
def dedup_first(t):
    return dedup(_lines(t), ["l_orderkey", "l_linenumber"], [F.col("l_shipdate").asc()])


@query("dedup_composite", _dedup_sql(("l_suppkey", "l_shipdate")))
def dedup_composite(t):
    return dedup(_lines(t), ["l_suppkey", "l_shipdate"])


# ------------------------------------------------------------------- tables

CHANGE = dt.date(1998, 1, 1)
_STORED = schemas.table("id string, robot bigint, at timestamp_ntz, area double, version int, dt date")


def _stored(t: Tables, version: int = 1) -> DataFrame:
    """Lines by ship month; later versions hold only later months."""
    df = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("id"),
        F.col("l_suppkey").alias("robot"),
        F.col("l_shipdate").alias("at"),
        (F.col("l_quantity") * version).alias("area"),
        F.lit(version).alias("version"),
        F.trunc(F.to_date("l_shipdate"), "month").alias("dt"),
    )
    return df if version == 1 else df.where(F.col("at") >= F.lit(CHANGE))


def _totals(df: DataFrame) -> DataFrame:
    return df.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


_MONTH = "date_trunc('month', l_shipdate)::date"
_BY_MONTH = f"select {_MONTH} as dt, count(*) as n, sum(l_quantity) as area from lineitem"


@query("scan_partitions", f"{_BY_MONTH} where {_MONTH} in (date '1996-02-01', date '1998-06-01', date '1999-12-01') group by 1")
def scan_partitions(t):
    path = scratch_path(t.spark, "table")
    write_partitions(_stored(t), path)
    days = [dt.date(1996, 2, 1), dt.date(1998, 6, 1), dt.date(1999, 12, 1), dt.date(2050, 1, 1)]
    return _totals(read_partitions(t.spark, path, _STORED, days))


@query("scan_date_window", f"{_BY_MONTH} where {_MONTH} between date '1998-06-01' - 90 and date '1998-06-01' + 30 group by 1")
def scan_date_window(t):
    path = scratch_path(t.spark, "table")
    write_partitions(_stored(t), path)
    lo, hi = date_window(dt.date(1998, 6, 1), 90, 30)
    return _totals(read_window(t.spark, path, _STORED, lo, hi))


@query("sink_dynamic_overwrite", f"""select {_MONTH} as dt, count(*) as n,
  sum(case when l_shipdate >= date '{CHANGE}' then l_quantity * 2 else l_quantity end) as area
from lineitem group by 1""")
def sink_dynamic_overwrite(t):
    path = scratch_path(t.spark, "table")
    write_partitions(_stored(t), path)
    write_partitions(_stored(t, 2), path)
    return _totals(read_window(t.spark, path, _STORED))


@query("sink_rebuild", f"""select {_MONTH} as dt, count(*) as n, sum(l_quantity * 2) as area
from lineitem where l_shipdate >= date '{CHANGE}' group by 1""")
def sink_rebuild(t):
    path = scratch_path(t.spark, "table")
    write_partitions(_stored(t), path)
    write_partitions(_stored(t, 2), path, mode="rebuild")
    return _totals(read_window(t.spark, path, _STORED))


@query("sink_merge", f"""with one as (
  select {_MONTH} as dt, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey, max(l_quantity) as q
  from lineitem group by all)
select dt, count(*) as n, sum(case when l_shipdate >= date '{CHANGE}' then q * 2 else q end) as area
from one group by 1""")
def sink_merge(t):
    """Two loads of the same rows: the second version wins, nothing is lost."""
    path = scratch_path(t.spark, "table")
    newest = [F.col("version").desc(), F.col("area").desc()]
    for version in (1, 2):
        merge_partitions(_stored(t, version), path, _STORED, ["id", "at"], newest, sort=["robot", "at"])
    return _totals(read_window(t.spark, path, _STORED))


_MOVED = "l_shipdate + interval 40 day"


@query("sink_merge_moved", f"""with versions as (
  select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate::timestamp as moment, l_quantity as area, 1 as version
  from lineitem
  union all
  select l_orderkey, l_linenumber, l_suppkey, l_partkey, {_MOVED}, l_quantity * 2, 2
  from lineitem where l_shipdate >= date '{CHANGE}'),
newest as (
  select moment, area, row_number() over (
    partition by l_orderkey, l_linenumber, l_suppkey, l_partkey order by version desc, area desc, moment) as place
  from versions)
select date_trunc('month', moment)::date as dt, count(*) as n, sum(area) as area from newest where place = 1 group by 1""")
def sink_merge_moved(t):
    """The second load moves rows to later dates; their old rows go, wherever they stand."""
    path = scratch_path(t.spark, "table")
    newest = [F.col("version").desc(), F.col("area").desc(), F.col("at").asc()]
    later = _stored(t, 2).withColumn("at", F.col("at") + F.expr("interval 40 days"))
    later = later.withColumn("dt", F.trunc(F.to_date("at"), "month"))
    for rows in (_stored(t), later.select(*_STORED.fieldNames())):
        merge_partitions(rows, path, _STORED, ["id"], newest, sort=["robot", "at"], lasting=True)
    return _totals(read_window(t.spark, path, _STORED))


_REPORT = f"""tables as (
  select 1 as place, 'missions' as table_name, count(*) as rows, count(distinct {_MONTH}) as partitions from lineitem
  union all select 2, 'polls', count(*), count(distinct ts::date) from events),
lines as (select * from tables union all select 3, 'total', sum(rows)::bigint, sum(partitions)::bigint from tables)"""


@query("load_report", f"""with {_REPORT}
select table_name, rows, partitions, partitions as files, true as bytes_as_stored from lines""")
def load_report(t):
    """What two writes put down, told by the writes; the bytes are those that a scan of the tables finds."""
    paths = {name: scratch_path(t.spark, "table") for name in ("missions", "polls")}
    rows = {"missions": _stored(t), "polls": t.events.withColumn("dt", F.to_date("ts"))}
    told = report(t.spark, {name: write_reported(df, paths[name], order=df.columns[:1]) for name, df in rows.items()})
    found = [table_report(t.spark, path, name=name) for name, path in paths.items()]
    stored = found[0].unionByName(found[1]).rollup("table_name").agg(F.sum("bytes").alias("stored"))
    stored = stored.na.fill("total", ["table_name"])
    return told.join(stored, "table_name").select(
        "table_name", "rows", "partitions", "files", (F.col("bytes") == F.col("stored")).alias("bytes_as_stored")
    )


@query("lines_dropped", "select count(*) * 2 as lines, count(*) as dropped, count(*) as kept from events")
def lines_dropped(t):
    """Every line stands there whole and cut short; the scan counts both."""
    path = scratch_path(t.spark, "lines")
    records = status_records(t)
    line = F.to_json(F.struct(*records.columns))
    records.select(F.explode(F.array(line, F.left(line, F.lit(10)))).alias("value")).write.text(path)
    seen = Observation()
    kept = read_jsonl(t.spark, path, schemas.STATUS_RECORD, dropped=seen).agg(F.count("serialNumber")).first()[0]
    return t.spark.createDataFrame([(seen.get["lines"], seen.get["dropped"], kept)], "lines bigint, dropped bigint, kept bigint")
