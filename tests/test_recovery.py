"""Runs that break off, rows that come late, dates that were never loaded."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_runs import Bronze, maintenance, mission, poll

from fleetwear import files, schemas
from fleetwear.plans import runs, spans
from fleetwear.plans.runs import Layout, build_gold, catch_up, missed, refresh_gold, run_day, run_range, run_silver
from fleetwear.sinks import journal, merge_changes, merge_partitions, recover, replace_partitions, write_partitions
from fleetwear.sources import partition_dates, read_window

D1, D2, D3 = (dt.date(2026, 3, d) for d in (1, 2, 3))
SCHEMA = schemas.table("k int, v int, dt date")


class Lost(RuntimeError):
    """The driver is gone."""


@pytest.fixture
def breaks(monkeypatch):
    """``breaks(n)``: the n-th file operation from now on is not done any more."""

    def arm(n):
        left = {"n": n}
        for name in ("move", "delete", "write"):
            real = getattr(files.Folder, name)

            def call(self, *a, real=real):
                left["n"] -= 1
                if left["n"] < 0:
                    raise Lost
                return real(self, *a)

            monkeypatch.setattr(files.Folder, name, call)
        return left

    return arm


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def merge(spark, path, data, **more):
    return merge_changes(frame(spark, data), path, SCHEMA, ["k"], [F.col("v").desc()], **more)


def held(spark, path):
    return sorted(tuple(r) for r in read_window(spark, path, SCHEMA).collect())


OLD = [(1, 1, D1), (2, 1, D1), (3, 1, D2), (4, 1, D3)]
NEW = [(2, 2, D1), (3, 2, D2), (5, 2, D2)]


@pytest.mark.parametrize("lasting", [False, True])
def test_a_merge_broken_off_anywhere_loses_nothing(spark, tmp_path, breaks, monkeypatch, lasting):
    new = NEW + ([(4, 2, D1)] if lasting else [])  # a lasting key moves: its old date is left without rows
    whole = str(tmp_path / "whole")
    merge(spark, whole, OLD)
    merge(spark, whole, new, lasting=lasting)
    want = held(spark, whole)
    n, states = 0, set()
    while True:
        path = str(tmp_path / f"t{n}")
        merge(spark, path, OLD)
        breaks(n)
        try:
            merge(spark, path, new, lasting=lasting)
            done = True
        except Lost:
            done = False
        monkeypatch.undo()
        if done:
            break
        recover(spark, path)
        states.add(tuple(held(spark, path)))  # all of it or nothing of it
        merge(spark, path, new, lasting=lasting)
        assert held(spark, path) == want, n
        assert not list((tmp_path / f"t{n}" / "_pending").glob("*"))
        n += 1
    assert n >= 5 and states == {tuple(sorted(OLD)), tuple(want)}


def test_a_recovery_broken_off_can_be_repeated(spark, tmp_path, breaks, monkeypatch):
    path = str(tmp_path / "t")
    merge(spark, path, OLD)
    breaks(2)  # the intent is written, a file is moved
    with pytest.raises(Lost):
        merge(spark, path, NEW)
    monkeypatch.undo()
    for n in range(4):
        breaks(n)
        try:
            recover(spark, path)
        except Lost:
            pass
        monkeypatch.undo()
    recover(spark, path)
    assert held(spark, path) == [(1, 1, D1), (2, 2, D1), (3, 2, D2), (4, 1, D3), (5, 2, D2)]
    assert recover(spark, path) == 0


def test_plain_overwrite_would_lose_rows(spark, tmp_path):
    """What the journal is for: a partition replaced by a load's own rows alone."""
    path = str(tmp_path / "t")
    write_partitions(frame(spark, OLD), path)
    write_partitions(frame(spark, NEW), path)
    assert (1, 1, D1) not in held(spark, path)


def test_repeated_merge_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert merge(spark, path, OLD) == (4, {D1, D2, D3})
    before = sorted(p.name for p in tmp_path.glob("t/dt=*/*.parquet"))
    told = []
    assert merge(spark, path, OLD[:2], announce=told.append) == (2, set())
    assert sorted(p.name for p in tmp_path.glob("t/dt=*/*.parquet")) == before and not told
    assert merge(spark, path, [(1, 9, D1)], announce=told.append) == (1, {D1}) and told == [{D1}]
    assert merge_partitions(frame(spark, []), path, SCHEMA, ["k"], []) == 0


def test_null_partitions_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, [(1, 1, None), (2, 1, D1)])
    assert merge(spark, path, [(3, 2, None)]) == (1, {None})
    assert sorted(read_window(spark, path, SCHEMA).toPandas()["k"]) == [1, 2, 3]


def test_replaced_partitions_may_be_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, OLD)
    replace_partitions(frame(spark, [(7, 7, D1)]), path, [D1, D2])
    assert held(spark, path) == [(4, 1, D3), (7, 7, D1)]
    assert partition_dates(spark, path) == [D1, D3]


def test_undecided_changes_are_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, OLD)
    write_partitions(frame(spark, NEW), f"{path}/{journal.PENDING}/half", mode="rebuild")
    assert held(spark, path) == sorted(OLD)  # scans do not see it
    assert recover(spark, path) == 0
    assert not (tmp_path / "t" / "_pending" / "half").exists()


# ------------------------------------------------------------------ late rows


def days(first, n):
    return [first + dt.timedelta(days=i) for i in range(n)]


def fill(bronze, dates, robots=("r1", "r2")):
    for i, day in enumerate(dates):
        bronze.day(
            day,
            [mission(f"m{i}{r}", f"{day}T10:00:00Z", robot=r) for r in robots],
            [maintenance(f"s{i}", f"{day}T12:00:00Z", robot=robots[i % 2], failure_detected=i % 5 == 0)] if i % 3 == 0 else [],
            [poll(f"{day}T10:00:00Z", 40 + i, robot=r) for r in robots],
        )


def features(spark, layout):
    return sorted(map(tuple, read_window(spark, layout.features, schemas.FEATURES).collect()), key=str)


def rebuilt(spark, bronze, layout):
    """The feature table built anew from the Silver tables, over the dates it holds."""
    fresh = Layout(layout.bronze, layout.silver, f"{bronze.root}/fresh-{dt.datetime.now().timestamp()}")
    dates = partition_dates(spark, layout.features)
    build_gold(spark, fresh, [(dates[0], dates[-1])])
    return features(spark, fresh)


@pytest.fixture
def bronze(tmp_path):
    return Bronze(tmp_path)


def test_late_rows_rebuild_the_features_that_see_them(spark, bronze):
    layout, dates = bronze.layout, days(D1, 45)
    fill(bronze, dates)
    run_range(spark, layout, dates[0], dates[-1])
    before = features(spark, layout)
    assert before == rebuilt(spark, bronze, layout)
    # Of one day in the middle: a failure, a mission of a new device, a poll; all come a load later.
    late, day = dates[-1] + dt.timedelta(days=1), dates[33]
    bronze.day(
        late,
        [mission("late", f"{day}T09:00:00Z", robot="r3"), mission("now", f"{late}T09:00:00Z")],
        [maintenance("late", f"{day}T09:00:00Z", robot="r2", failure_detected=True)],
        [poll(f"{day}T23:00:00Z", 1), poll(f"{late}T10:00:00Z", 2)],
    )
    run_day(spark, layout, late)
    after = features(spark, layout)
    assert after == rebuilt(spark, bronze, layout) and after != before
    changed = {r[1] for r in set(after) ^ set(before)}
    assert min(changed) < day < max(changed)  # labels before it, windows after it
    assert all(day - dt.timedelta(days=30) <= d for d in changed)
    # A second run finds nothing changed and leaves the other dates' files alone.
    files_before = {p: p.stat().st_mtime_ns for p in bronze.root.glob("gold/robot_features/dt=*/*.parquet")}
    run_day(spark, layout, late)
    files_after = {p: p.stat().st_mtime_ns for p in bronze.root.glob("gold/robot_features/dt=*/*.parquet")}
    assert {p.parent.name for p in files_before.keys() ^ files_after.keys()} <= {f"dt={late}"}


def test_dates_that_lose_their_rows_lose_their_features(spark, bronze):
    layout = Layout(bronze.layout.bronze, bronze.layout.silver, bronze.layout.gold, lasting=frozenset({"task_reports"}))
    far = D1 + dt.timedelta(days=100)
    bronze.day(D1, [mission("a", f"{D1}T10:00:00Z")], [], [poll(f"{D1}T10:00:00Z")])
    bronze.day(far, [mission("b", f"{far}T10:00:00Z", robot="r2")], [], [poll(f"{far}T10:00:00Z")])
    run_range(spark, layout, D1, far)
    assert partition_dates(spark, layout.features)[:2] == [D1, D2]
    bronze.day(far + dt.timedelta(days=1), [mission("a", f"{D1 - dt.timedelta(days=200)}T08:00:00Z")], [], [poll(f"{far}T11:00:00Z")])
    run_silver(spark, layout, far + dt.timedelta(days=1))
    refresh_gold(spark, layout)
    assert partition_dates(spark, layout.features)[0] == far
    assert {r[0] for r in features(spark, layout)} == {"r2"}


def test_a_run_lost_before_the_features_leaves_none_stale(spark, bronze, monkeypatch):
    layout, dates = bronze.layout, days(D1, 20)
    fill(bronze, dates)
    run_range(spark, layout, dates[0], dates[-1])
    late = dates[-1] + dt.timedelta(days=1)
    bronze.day(late, [mission("x", f"{dates[9]}T09:00:00Z")], [maintenance("y", f"{dates[15]}T09:00:00Z")], [poll(f"{late}T10:00:00Z")])

    def lost(*a, **k):
        raise Lost

    monkeypatch.setattr(runs, "build_gold", lost)
    with pytest.raises(Lost):
        run_day(spark, layout, late)
    monkeypatch.undo()
    run_day(spark, layout, late)  # its merges find the rows in place already
    assert features(spark, layout) == rebuilt(spark, bronze, layout)
    assert refresh_gold(spark, layout) == []


def test_reach_of_changed_dates():
    day = dt.date(2026, 6, 15)
    ago = lambda n: day - dt.timedelta(days=n)
    assert spans.stale({"robot_status": [day]}) == [(day, ago(-7))]
    assert spans.stale({"task_reports": [day, ago(-91)]}) == [(day, ago(-181))]
    assert spans.stale({"task_reports": [day, ago(-92)]}) == [(day, ago(-90)), (ago(-92), ago(-182))]
    assert spans.stale({"maintenance_events": [day]}, 120) == [(ago(30), ago(-120))]
    assert spans.stale({"maintenance_events": [day]}, None) == [(ago(30), dt.date.max)]
    assert spans.stale({}) == [] and spans.merged([(D2, D1)]) == []
    assert spans.clipped([(D1, D3)], D2, D2) == [(D2, D2)] and spans.clipped([(D1, D1)], D2, D3) == []
    with pytest.raises(ValueError, match="table"):
        spans.stale({"x": [day]})


# --------------------------------------------------------------- missed dates


def test_catching_up_on_missed_dates(spark, bronze):
    layout, dates = bronze.layout, days(D1, 8)
    fill(bronze, dates)
    for day in (dates[0], dates[3]):
        run_day(spark, layout, day)
    want = [d for i, d in enumerate(dates) if i not in (0, 3)]
    assert sorted({r["load_dt"] for r in missed(spark, layout).collect()}) == want
    assert sorted({r["load_dt"] for r in missed(spark, layout, dates[4]).collect()}) == [dates[1], dates[2], dates[4]]
    assert catch_up(spark, layout, dates[5]) == [(dates[1], dates[2]), (dates[4], dates[5])]
    assert catch_up(spark, layout) == [(dates[6], dates[7])]
    assert catch_up(spark, layout) == [] and missed(spark, layout).count() == 0
    other = Layout(layout.bronze, f"{bronze.root}/silver2", f"{bronze.root}/gold2")
    run_range(spark, other, dates[0], dates[-1])
    assert features(spark, layout) == features(spark, other)


def test_late_files_count_as_missed(spark, bronze):
    layout = bronze.layout
    fill(bronze, [D1, D2])
    run_range(spark, layout, D1, D2)
    assert missed(spark, layout).count() == 0
    bronze.put("robot_status", D1, "more.jsonl", '{"serialNumber": "r9", "_poll_ts": "2026-03-01T05:00:00Z"}\n')
    assert [(r["dataset"], r["load_dt"]) for r in missed(spark, layout).collect()] == [("robot_status", D1)]
    assert catch_up(spark, layout) == [(D1, D1)]
    assert read_window(spark, layout.table("robot_status"), schemas.STATUS).where("serial_number = 'r9'").count() == 1


def test_dates_without_a_required_dataset_wait(spark, bronze):
    fill(bronze, [D1])
    bronze.put("robot_status", D2, "s.jsonl", '{"serialNumber": "r1", "_poll_ts": "2026-03-02T05:00:00Z"}\n')
    assert catch_up(spark, bronze.layout) == [(D1, D1)]
    assert [(r["dataset"], r["load_dt"]) for r in missed(spark, bronze.layout).collect()] == [("robot_status", D2)]
    assert missed(spark, Layout(f"{bronze.root}/none", f"{bronze.root}/x", f"{bronze.root}/y")).count() == 0


# ------------------------------------------------------------- empty loads


def test_empty_loads_are_an_answer_only_when_asked(spark, bronze):
    layout = bronze.layout
    fill(bronze, days(D1, 3))
    run_range(spark, layout, D1, D3)
    bronze.day(D2, [], [], [])
    with pytest.raises(Exception, match="task_reports"):
        run_silver(spark, layout, D2)
    assert partition_dates(spark, layout.table("task_reports")) == [D1, D2, D3]
    loaded = run_silver(spark, layout, D2, empties=True)
    assert loaded["task_reports"] == 0 and loaded.changed["task_reports"] == {D2}
    for name in ("task_reports", "robot_status"):
        assert partition_dates(spark, layout.table(name)) == [D1, D3]
    refresh_gold(spark, layout)
    assert features(spark, layout) == rebuilt(spark, bronze, layout)
    assert run_silver(spark, layout, D2, empties=True).changed["task_reports"] == set()
    # A date with rows, and one without files, are left alone.
    run_silver(spark, layout, D1, D3, empties=True)
    assert partition_dates(spark, layout.table("task_reports")) == [D1, D3]


# ------------------------------------------------------------------- reports


def test_reports_are_told_by_the_write(spark, tmp_path):
    from fleetwear.sinks import report, table_report, write_reported

    path = str(tmp_path / "t")
    written = write_reported(frame(spark, OLD), path)
    stored = table_report(spark, path).first()
    assert (written.rows, written.partitions, written.files, written.bytes) == tuple(stored)[1:]
    second = write_reported(frame(spark, NEW), path)  # only what this load wrote
    assert (second.rows, second.partitions, second.files) == (3, 2, 2)
    empty = write_reported(frame(spark, []), str(tmp_path / "none"))
    assert (empty.rows, empty.partitions, empty.files, empty.bytes) == (0, 0, 0, 0)
    lines = report(spark, {"a": written, "b": second, "c": empty}).collect()
    assert [r["table_name"] for r in lines] == ["a", "b", "c", "total"]
    assert lines[-1]["rows"] == 7 and lines[-1]["bytes"] == written.bytes + second.bytes


def test_dropped_lines_are_counted(spark, tmp_path):
    from pyspark.sql import Observation

    from fleetwear.sources import read_jsonl

    (tmp_path / "s.jsonl").write_text('{"serialNumber": "a"}\n{"serialNumber": \n\n{"serialNumber": "b", "battery": "x"}\n[1]\nnull\n')
    plain = sorted(map(str, read_jsonl(spark, str(tmp_path), schemas.STATUS_RECORD).collect()))
    seen = Observation()
    counted = sorted(map(str, read_jsonl(spark, str(tmp_path), schemas.STATUS_RECORD, dropped=seen).collect()))
    assert counted == plain
    assert seen.get["lines"] - seen.get["dropped"] == len(plain) and seen.get["dropped"] >= 1
