"""Positions of pattern matches as DataFrame expressions.

A span is ``struct<b, o, e, kind, w>``: start, order of the kind, end
(exclusive), kind and matched text, positions in code points. Sorting spans
sorts them by start, then by kind as listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<b:int,o:int,e:int,kind:string,w:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def find(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Leftmost non-overlapping matches; an empty array where there are none.

    The text between the matches and the matches themselves give the positions
    by a running sum. Patterns must not match the empty string.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.filter(
        F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("w"))),
        lambda x: x["w"].isNotNull(),
    )
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        b = acc["at"] + x["gap"]
        e = b + F.length(x["w"])
        span = F.struct(
            b.alias("b"), F.lit(order).alias("o"), e.alias("e"), F.lit(kind).alias("kind"), x["w"].alias("w")
        )
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(no_spans())


def keep(spans: Column, valid: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: F.coalesce(valid(s["w"]), F.lit(False)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["b"].cast("string"), s["e"].cast("string"))), ","
    )


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def apart_from(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``."""
    return F.filter(
        spans, lambda s: ~F.exists(base, lambda x: (x["b"] < s["e"]) & (s["b"] < x["e"]))
    )
