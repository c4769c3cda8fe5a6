"""Replacing partitions so that a broken-off run can be finished or undone.

New files are written beside the table, in ``<table>/_pending/<id>``; scans skip
names that begin with an underscore. When they are complete, an intent record
lists every file to bring in and every file to take away. From then on the
change will happen: ``recover`` finishes it, whatever step the driver was lost
at. Before that it has not happened: ``recover`` drops what was written.

Each step can be repeated. Names of data files are unique, so a new file is
either still pending or already in place; an old one is there or gone. Moves are
single files, which is what object stores can do. Between the first move and
the last deletion the table holds old and new rows; every writer of this
package, and every reader that begins a run, calls ``recover`` first.

One writer a table at a time: a second one would undo what the first has not
yet decided.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from fleetwear.files import Folder

PENDING, INTENT = "_pending", "intent.json"
#: Fixed value: the folder name of a null in a partition column.
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"


def folder_name(key: str, value: object) -> str:
    return f"{key}={NULL_NAME if value is None else value}"


def _data(names: Iterable[str]) -> list[str]:
    return [n for n in names if not n.startswith(("_", "."))]


def swap_partitions(
    spark: SparkSession, path: str, key: str, values: Iterable[object], write: Callable[[str], None]
) -> None:
    """Replace the partitions ``values`` by what ``write`` puts into the folder given to it.

    Partitions of ``values`` that ``write`` leaves out are removed; others that
    it makes are added to what stands there.
    """
    table = Folder(spark, path)
    work = f"{PENDING}/{uuid.uuid4().hex}"
    write(f"{path}/{work}")
    made = {d: _data(table.names(f"{work}/{d}")) for d in _data(table.names(work))}
    gone = {folder_name(key, v): _data(table.names(folder_name(key, v))) for v in values}
    table.write(f"{work}/{INTENT}", json.dumps({"in": made, "out": gone}))
    _carry_out(table, work)


def _carry_out(table: Folder, work: str) -> None:
    plan = json.loads(table.read(f"{work}/{INTENT}"))
    for folder, names in plan["in"].items():
        waiting = set(table.names(f"{work}/{folder}"))
        for name in names:
            if name in waiting:
                table.move(f"{work}/{folder}/{name}", f"{folder}/{name}")
    for folder, names in plan["out"].items():
        for name in names:
            table.delete(f"{folder}/{name}")
        if names and not _data(table.names(folder)):
            table.delete(folder)
    table.delete(work)


def recover(spark: SparkSession, path: str) -> int:
    """Finish decided changes of a table and drop undecided ones; how many were finished."""
    table = Folder(spark, path)
    finished = 0
    for name in table.names(PENDING):
        work = f"{PENDING}/{name}"
        if table.exists(f"{work}/{INTENT}"):
            _carry_out(table, work)
            finished += 1
        else:
            table.delete(work)
    return finished
