"""Closed spans of dates, and the feature dates that changed rows reach."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from fleetwear.plans.features import HORIZON, LONGEST, WEEK
from fleetwear.plans.silver import MAINTENANCE, MISSIONS, STATUS

Span = tuple[dt.date, dt.date]
DAY = dt.timedelta(days=1)


def shifted(day: dt.date, days: int | None, edge: dt.date) -> dt.date:
    """``day + days`` within the calendar; ``edge`` where there is no bound."""
    if days is None:
        return edge
    try:
        return day + DAY * days
    except OverflowError:
        return edge


def merged(spans: Iterable[Span]) -> list[Span]:
    """The same dates in as few spans as there can be, in order."""
    out: list[Span] = []
    for lo, hi in sorted(s for s in spans if s[0] <= s[1]):
        if out and (out[-1][1] == dt.date.max or lo <= out[-1][1] + DAY):
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def clipped(spans: Iterable[Span], lo: dt.date, hi: dt.date) -> list[Span]:
    return [(max(a, lo), min(b, hi)) for a, b in spans if max(a, lo) <= min(b, hi)]


def of_dates(dates: Iterable[dt.date]) -> list[Span]:
    return merged((d, d) for d in dates)


def reach(table: str, lookback: int | None = LONGEST) -> tuple[int, int | None]:
    """Feature dates that see a row of day t: ``t - back .. t + ahead``; None where nothing ends it.

    Missions count for 90 days, polls for 7. A service event is seen by the
    labels of the 30 days before it, and afterwards for as long as the counts of
    90 days or the days since it (``lookback``) reach.
    """
    if table == MISSIONS.name:
        return 0, LONGEST
    if table == STATUS.name:
        return 0, WEEK
    if table == MAINTENANCE.name:
        return HORIZON, None if lookback is None else max(lookback, LONGEST)
    raise ValueError(f"table: {table}")


def stale(changed: Mapping[str, Iterable[dt.date]], lookback: int | None = LONGEST) -> list[Span]:
    """Feature dates whose values may have changed with these dates of the tables."""
    spans = []
    for table, days in changed.items():
        back, ahead = reach(table, lookback)
        spans += [(shifted(d, -back, dt.date.min), shifted(d, ahead, dt.date.max)) for d in days]
    return merged(spans)
