"""Raw documents to features through the stored layers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fleetwear import schemas
from fleetwear.plans.runs import Layout, read_fleet, run_day, run_gold, run_range, run_silver
from fleetwear.sinks import table_report, write_partitions
from fleetwear.sources import MissingData, date_window, read_jsonl, read_partitions, read_window

D1 = dt.date(2026, 3, 1)
D2 = dt.date(2026, 3, 2)
D3 = dt.date(2026, 3, 3)


def maintenance(id_, completed, robot="r1", status="completed", updated="2026-03-01T00:00:00Z", **more):
    return {
        "maintenance_id": id_, "robot_id": robot, "maintenance_type": "corrective",
        "maintenance_status": status, "completed_at": completed, "failure_detected": True,
        "downtime_minutes": 60, "updated_at": updated, "parts_replaced": [], "comment": None, **more,
    }


def mission(id_, start, robot="r1", **more):
    return {
        "id": id_, "robotSerialNumber": robot, "completionPercentage": 0.5,
        "actualCleaningAreaSquareMeter": 10.5, "startBatteryPercentage": 90, "endBatteryPercentage": 70,
        "consumablesResidualPercentage": {"brush": 50, "filter": 60, "suctionBlade": 70},
        "startTime": start, **more,
    }


def poll(ts, soc=50, robot="r1", **more):
    return {
        "serialNumber": robot, "_poll_ts": ts, "taskState": "IDLE", "online": True,
        "battery": {"soc": soc, "cycleTimes": 3, "soh": "HEALTHY"},
        "localizationInfo": {"map": {"id": "m", "name": "hall"}, "mapPosition": {"x": 1, "y": 2, "angle": 0.5}},
        "_source": "s", "unknown": [1], **more,
    }


class Bronze:
    def __init__(self, root):
        self.root = root
        self.layout = Layout(f"{root}/bronze", f"{root}/silver", f"{root}/gold")

    def put(self, dataset, day, name, text):
        folder = self.root / "bronze" / dataset / "source=s" / f"load_dt={day}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    def envelope(self, dataset, day, data):
        self.put(dataset, day, "doc.json", json.dumps({"_meta": {"schema": "v1"}, "data": data}, indent=2))

    def day(self, day, missions=(), events=None, polls=(), lines=()):
        self.envelope("task_reports", day, [{"robotTaskReports": list(missions), "page": 1}, {"robotTaskReports": []}])
        if events is not None:
            self.envelope("maintenance_events", day, list(events))
        self.put("robot_status", day, "s.jsonl", "\n".join([*(json.dumps(p) for p in polls), *lines]) + "\n")


@pytest.fixture
def bronze(tmp_path):
    return Bronze(tmp_path)


def rows(spark, bronze, name):
    schema = {"maintenance_events": schemas.MAINTENANCE, "task_reports": schemas.MISSIONS, "robot_status": schemas.STATUS}
    return read_window(spark, bronze.layout.table(name), schema[name]).collect()


def test_silver_edges(spark, bronze):
    bronze.day(
        D1,
        missions=[
            mission("a", "2026-03-01T10:00:00Z"),
            mission("a", "2026-03-01T09:00:00Z", durationSeconds="x", taskEndStatus=3000000000, endBatteryPercentage=7.9),
            mission(None, "2026-03-01T10:00:00Z"),
            mission("b", None),
        ],
        events=[
            maintenance("m1", "2026-03-01T10:00:00Z", component="old"),
            maintenance("m1", "2026-03-01T10:00:00Z", component="new", updated="2026-03-02T00:00:00Z", downtime_minutes=7.9),
            maintenance("m2", "2026-03-01T10:00:00Z", status="planned"),
            maintenance("m3", None),
        ],
        polls=[
            poll("2026-03-01T10:00:00Z", "x"), poll("2026-03-01T11:00:00Z", 7.9), poll("2026-03-01T12:00:00Z", 3000000000),
            poll("2026-03-01T13:00:00Z", 5), poll("2026-03-01T13:00:00Z", 6), poll(None), poll("2026-03-01T14:00:00Z", robot=None),
        ],
        lines=['{"serialNumber": "r1", "_poll_ts": '],
    )
    assert run_silver(spark, bronze.layout, D1) == {"maintenance_events": 1, "task_reports": 1, "robot_status": 4}
    event = rows(spark, bronze, "maintenance_events")[0]
    assert (event.component, event.downtime_minutes, event.comment, event.parts_replaced) == ("new", 7, None, [])
    assert event.failure_detected is True and event.dt == D1
    done = rows(spark, bronze, "task_reports")[0]
    assert done.start_time == dt.datetime(2026, 3, 1, 9) and done.battery_delta_pct == 7 - 90
    assert done.duration_seconds is None and done.task_end_status is None and done.actual_area_m2 == 10.5
    polls = sorted(rows(spark, bronze, "robot_status"), key=lambda r: r.poll_ts)
    assert [p.battery_soc for p in polls] == [None, 7, None, 5]
    assert polls[0].map_name == "hall" and polls[0].pos_x == 1
    assert dict(read_window(spark, bronze.layout.table("maintenance_events"), schemas.MAINTENANCE).dtypes)["comment"] == "string"


def test_empty_arrays_give_no_rows(spark, bronze):
    bronze.day(D1, missions=[], events=[], polls=[poll("2026-03-01T10:00:00Z")])
    with pytest.raises(MissingData, match="task_reports"):
        run_silver(spark, bronze.layout, D1)
    assert rows(spark, bronze, "maintenance_events") == []


def test_missing_partitions(spark, bronze):
    with pytest.raises(MissingData, match="task_reports"):
        run_silver(spark, bronze.layout, D1)
    bronze.day(D1, [mission("a", "2026-03-01T10:00:00Z")], None, [poll("2026-03-01T10:00:00Z")])
    assert run_silver(spark, bronze.layout, D1)["maintenance_events"] == 0


def test_rows_past_midnight_survive_reruns(spark, bronze):
    bronze.day(D1, [mission("a", "2026-03-01T23:00:00Z"), mission("late", "2026-03-02T00:30:00Z")], [], [poll("2026-03-01T10:00:00Z")])
    bronze.day(D2, [mission("b", "2026-03-02T10:00:00Z")], [], [poll("2026-03-02T10:00:00Z")])
    for day in (D1, D2, D1):
        run_silver(spark, bronze.layout, day)
        reports = rows(spark, bronze, "task_reports")
    assert sorted((r.report_id, r.dt) for r in reports) == [("a", D1), ("b", D2), ("late", D2)]


def test_id_reuse_follows_the_key(spark, bronze):
    events = [maintenance("mnt_000001", "2026-03-01T10:00:00Z", robot=r) for r in ("r1", "r2")]
    bronze.day(D1, [mission("a", "2026-03-01T10:00:00Z")], events, [poll("2026-03-01T10:00:00Z")])
    run_silver(spark, bronze.layout, D1)
    assert len(rows(spark, bronze, "maintenance_events")) == 1
    wide = Layout(
        bronze.layout.bronze, f"{bronze.root}/wide", bronze.layout.gold,
        {"maintenance_events": ("maintenance_id", "robot_id")},
    )
    assert run_silver(spark, wide, D1)["maintenance_events"] == 2


@pytest.mark.parametrize("zone", ["UTC", "Europe/Moscow", "America/New_York"])
def test_dates_do_not_follow_the_session_zone(spark, bronze, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        bronze.day(D1, [mission("a", "2026-03-01T23:30:00Z")], [], [poll("2026-03-01T00:10:00Z")])
        run_silver(spark, bronze.layout, D1)
        assert [r.dt for r in rows(spark, bronze, "task_reports")] == [D1]
        assert [r.dt for r in rows(spark, bronze, "robot_status")] == [D1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def _three_days(bronze):
    for i, day in enumerate((D1, D2, D3)):
        bronze.day(
            day,
            [mission(f"a{i}", f"{day}T10:00:00Z"), mission(f"b{i}", f"{day}T11:00:00Z", robot="r2")],
            [maintenance(f"m{i}", f"{day}T12:00:00Z")],
            [poll(f"{day}T10:00:00Z", 40 + i), poll(f"{day}T20:00:00Z", 50)],
        )


def _gold(spark, layout):
    return {tuple(r) for r in read_window(spark, layout.features, schemas.FEATURES).collect()}


def test_range_equals_daily_runs(spark, bronze):
    _three_days(bronze)
    ranged = Layout(bronze.layout.bronze, f"{bronze.root}/silver2", f"{bronze.root}/gold2")
    assert run_range(spark, ranged, D1, D3)["robot_features"] == 6
    for day in (D1, D2, D3):
        run_silver(spark, bronze.layout, day)
    for day in (D1, D2, D3):
        assert run_gold(spark, bronze.layout, day) == 2
    assert _gold(spark, bronze.layout) == _gold(spark, ranged)
    files = list((bronze.root / "gold" / "robot_features").glob("dt=*/*.parquet"))
    assert len(files) == 3


def test_run_day_can_be_repeated(spark, bronze):
    _three_days(bronze)
    first = run_day(spark, bronze.layout, D1)
    once = _gold(spark, bronze.layout)
    assert run_day(spark, bronze.layout, D1) == first
    assert _gold(spark, bronze.layout) == once and len(once) == 2


def test_fleet_registry(spark, bronze):
    bronze.envelope("list_robots", D1, [{"robots": [{"serialNumber": "r1", "online": True}, {"serialNumber": "r2"}]}])
    assert read_fleet(spark, bronze.layout, D1).count() == 2
    assert read_fleet(spark, bronze.layout, D2) is None


def test_jsonl_drops_only_broken_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"serialNumber": "a"}\n{"serialNumber": \n{"serialNumber": "b"}\n')
    assert read_jsonl(spark, str(tmp_path), schemas.STATUS_RECORD).count() == 2


SCHEMA = schemas.table("k int, v int, dt date")


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    write_partitions(frame(spark, [(1, 1, D1), (2, 2, D2)]), path)
    write_partitions(frame(spark, [(3, 3, D2)]), path)
    assert sorted(r.k for r in read_window(spark, path, SCHEMA).collect()) == [1, 3]
    write_partitions(frame(spark, []), path)
    assert read_window(spark, path, SCHEMA).count() == 2
    write_partitions(frame(spark, [(4, 4, D3)]), path, mode="rebuild")
    assert [r.k for r in read_window(spark, path, SCHEMA).collect()] == [4]
    with pytest.raises(ValueError, match="append"):
        write_partitions(frame(spark, []), path, mode="append")


def test_small_partitions_are_one_file(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v"), F.lit(D1).alias("dt"))
    path = str(tmp_path / "t")
    write_partitions(df.repartition(8), path)
    report = table_report(spark, path).first()
    assert (report["rows"], report["partitions"], report["files"]) == (1000, 1, 1) and report["bytes"] > 0


def test_large_partitions_are_split(spark, tmp_path):
    df = spark.range(200_000).select(F.col("id").cast("int").alias("k"), (F.rand(1) * 1e9).cast("int").alias("v"), F.lit(D1).alias("dt"))
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "256k")
    try:
        path = str(tmp_path / "t")
        write_partitions(df.repartition(8), path)
        assert table_report(spark, path).first()["files"] > 1
    finally:
        spark.conf.set(setting, before)


def test_window_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_window(spark, path, SCHEMA).schema == SCHEMA
    assert read_partitions(spark, path, SCHEMA, [D1]).count() == 0
    write_partitions(frame(spark, [(1, 1, D1), (2, 2, D2), (3, 3, D3)]), path)
    assert [r.k for r in read_partitions(spark, path, SCHEMA, [D2, dt.date(2030, 1, 1)]).collect()] == [2]
    assert read_partitions(spark, path, SCHEMA, []).count() == 0
    lo, hi = date_window(D2, 0, 1)
    assert (lo, hi) == (D2, D3)
    assert sorted(r.k for r in read_window(spark, path, SCHEMA, lo, hi).collect()) == [2, 3]
    assert read_window(spark, path, SCHEMA, hi, lo).count() == 0


@pytest.mark.parametrize("ranged", [False, True])
def test_ids_used_again_on_other_days(spark, bronze, ranged):
    for day in (D1, D2, D3):
        bronze.day(day, [mission("a", f"{day}T10:00:00Z")], [maintenance("mnt_000001", f"{day}T12:00:00Z")], [poll(f"{day}T10:00:00Z")])
    if ranged:
        run_silver(spark, bronze.layout, D1, D3)
    else:
        for day in (D1, D2, D3):
            run_silver(spark, bronze.layout, day)
    assert sorted(r.dt for r in rows(spark, bronze, "maintenance_events")) == [D1, D2, D3]
    assert sorted(r.dt for r in rows(spark, bronze, "task_reports")) == [D1, D2, D3]


@pytest.mark.parametrize("ranged", [False, True])
@pytest.mark.parametrize("lasting", [False, True])
def test_event_moved_to_another_date(spark, bronze, lasting, ranged):
    kept = mission("a", f"{D1}T10:00:00Z"), poll(f"{D1}T10:00:00Z")
    bronze.day(D1, [kept[0]], [maintenance("m1", f"{D1}T12:00:00Z", updated=f"{D1}T12:00:00Z")], [kept[1]])
    bronze.day(D2, [mission("b", f"{D2}T10:00:00Z")], [maintenance("m1", f"{D2}T09:00:00Z", updated=f"{D2}T12:00:00Z")], [poll(f"{D2}T10:00:00Z")])
    layout = Layout(bronze.layout.bronze, bronze.layout.silver, bronze.layout.gold, lasting=frozenset({"maintenance_events"} if lasting else ()))
    for _ in range(2):  # repeated loads change nothing
        if ranged:
            run_silver(spark, layout, D1, D2)
        else:
            run_silver(spark, layout, D1)
            run_silver(spark, layout, D2)
        found = sorted(r.dt for r in rows(spark, bronze, "maintenance_events"))
        assert found == ([D2] if lasting else [D1, D2])
        assert sorted(r.dt for r in rows(spark, bronze, "task_reports")) == [D1, D2]


def test_offsets_become_utc(spark):
    from fleetwear.functions import parse_ts

    texts = ["2026-03-01T01:00:00+03:00", "2026-03-01T01:00:00.250-05:30", "2026-03-01T01:00:00Z", "2026-03-01 01:00:00", "2026-03-01", "x", None, "2026-03-29T02:30:00+00:00", "1969-12-31T23:00:00-01:00"]
    want = [
        dt.datetime(2026, 2, 28, 22), dt.datetime(2026, 3, 1, 6, 30, 0, 250000), dt.datetime(2026, 3, 1, 1), dt.datetime(2026, 3, 1, 1),
        dt.datetime(2026, 3, 1), None, None, dt.datetime(2026, 3, 29, 2, 30), dt.datetime(1970, 1, 1),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame([(t,) for t in texts], "t string")
            assert [r[0] for r in df.select(parse_ts(F.col("t"))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_no_staging_off_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from fleetwear.session import shared_folder

    elsewhere = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077")
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(elsewhere)
