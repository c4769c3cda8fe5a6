"""Column expressions shared by the operators. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Serial prefix of the second model line, and both line names.
MODEL_PREFIX = "CB300"
MODEL_WITH_PREFIX = "W50H"
MODEL_OTHER = "W1"


OFFSET = r"\d:\d\d.*[+-]\d{1,2}(:?\d{2})?\s*$"


def narrow_int(c: Column) -> Column:
    """Text or number to int: fractions truncate, bad or too large gives null.

    The range is tested first: an overflow caught by the cast costs an exception
    per value.
    """
    d = c.try_cast("double")
    return F.when((d > -2147483649.0) & (d < 2147483648.0), d.cast("int"))


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_bool(c: Column) -> Column:
    return c.try_cast("boolean")


def parse_ts(c: Column) -> Column:
    """ISO text to UTC wall time, whatever the session zone is.

    Text without an offset is UTC already. With one it names an instant, whose
    distance from the epoch does not depend on the session zone either.
    """
    instant = F.unix_micros(c.try_cast("timestamp"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    shifted = epoch + F.make_dt_interval(secs=(instant.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    return F.when(F.rlike(c, F.lit(OFFSET)), shifted).otherwise(c.try_cast("timestamp_ntz"))


def whole_days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def ratio(total: Column, n: Column) -> Column:
    """``total / n`` as double; null where ``n`` is zero or null."""
    return F.try_divide(total.cast("double"), n.cast("double"))


def share_pct(part: Column, whole: Column) -> Column:
    return ratio(part * F.lit(100.0), whole)


def positive_zero(c: Column) -> Column:
    """Turn -0.0 into 0.0."""
    return c + F.lit(0.0)


def short_id(c: Column) -> Column:
    """Last dash-separated token. Not unique over the fleet: show, do not group."""
    return F.element_at(F.split(c, "-"), -1)


def model_line(c: Column) -> Column:
    return F.when(c.startswith(MODEL_PREFIX), MODEL_WITH_PREFIX).otherwise(MODEL_OTHER)


def latest_part(at: Column, value: Column, keep_null: bool) -> Column:
    """Operand whose ``max`` holds the newest value; equal times: larger value.

    With ``keep_null`` a null at the newest time is the answer, without it the
    newest non-null value is.
    """
    pair = F.struct(at.alias("at"), value.alias("value"))
    return F.when(at.isNotNull() if keep_null else at.isNotNull() & value.isNotNull(), pair)


_SPAN = 1 << 33  # room for an int, shifted to be positive, and for null as 0


def newest_int(at: Column, value: Column, keep_null: bool) -> Column:
    """Aggregate: the int ``value`` at the newest ``at``, with the rules of ``latest_part``.

    Time and value share one decimal, so the buffer has a fixed width and the
    aggregation hashes; a struct in the buffer would make it sort all rows.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, at.cast("timestamp_ntz")).cast("decimal(20,0)")
    shifted = F.coalesce(value.cast("long") + F.lit((1 << 31) + 1), F.lit(0)).cast("decimal(11,0)")
    code = micros * F.lit(_SPAN).cast("decimal(11,0)") + shifted
    best = F.max(code if keep_null else F.when(value.isNotNull(), code))
    low = F.pmod(best, F.lit(_SPAN).cast("decimal(11,0)")).cast("long")
    return F.when(low > 0, low - F.lit((1 << 31) + 1)).cast("int")


_DAY_MICROS = 86_400_000_000
_NEAR = 1 << 26  # room beside the microseconds of a day in a long


def newest_int_of_day(at: Column, value: Column, keep_null: bool) -> Column:
    """Aggregate: ``newest_int`` where all rows of a group have the same date.

    Time of day and value share one long as long as the value has 25 bits; only
    larger values, which readings rarely are, take the decimal.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    since = F.pmod(F.timestamp_diff("MICROSECOND", epoch, at.cast("timestamp_ntz")), F.lit(_DAY_MICROS))
    number = value.cast("long")
    fits = number.between(1 - _NEAR // 2, _NEAR // 2 - 1)
    near = F.max(F.when(F.coalesce(fits, F.lit(keep_null)), since * F.lit(_NEAR) + F.coalesce(number + F.lit(_NEAR // 2), F.lit(0))))
    near_at, low = F.shiftright(near, 26), near.bitwiseAND(F.lit(_NEAR - 1))
    near_value = F.when(low > 0, low - F.lit(_NEAR // 2))
    span = F.lit(_SPAN).cast("decimal(11,0)")
    shifted = (number + F.lit((1 << 31) + 1)).cast("decimal(11,0)")
    far = F.max(F.when(~fits, since.cast("decimal(20,0)") * span + shifted))
    far_value = F.pmod(far, span).cast("long") - F.lit((1 << 31) + 1)
    far_at = F.floor(far / span).cast("long")
    later = near.isNull() | (far_at > near_at) | (far_at == near_at) & F.coalesce(far_value > near_value, F.lit(True))
    return F.when(far.isNull(), near_value).when(later, far_value).otherwise(near_value).cast("int")


def dated_int(day: Column, value: Column, keep_null: bool) -> Column:
    """``latest_part`` of a date and an int as one long, which aggregates by hash; ``dated_parts`` takes it apart."""
    code = F.unix_date(day).cast("long") * F.lit(_SPAN) + F.coalesce(value.cast("long") + F.lit((1 << 31) + 1), F.lit(0))
    return F.when(day.isNotNull() if keep_null else day.isNotNull() & value.isNotNull(), code)


def dated_parts(code: Column) -> tuple[Column, Column]:
    """(date, int) of a ``dated_int``."""
    low = code.bitwiseAND(F.lit(_SPAN - 1))
    value = F.when(low > 0, low - F.lit((1 << 31) + 1)).cast("int")
    return F.date_from_unix_date(F.shiftright(code, 33).cast("int")), value


CODES = 1024  # distinct texts that get a code


def codes(df: DataFrame, column: str, most: int = CODES) -> list[str] | None:
    """The distinct texts of a column in byte order; None if there are more than ``most``. One pass over that column."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    return None if len(found) > most else sorted((r[0] for r in found), key=lambda v: v.encode())


def place_of(text: Column, known: list[str]) -> Column:
    """Place of a text in the list, from 1; null for null."""
    return F.array_position(F.array(*map(F.lit, known)).cast("array<string>"), text).cast("int")


def newest_text(df: DataFrame, at: Column, column: str, keep_null: bool) -> Column:
    """Aggregate: the text at the newest ``at``, with the rules of ``latest_part``.

    Texts travel as numbers in their order, so that the buffer has a fixed
    width. A column of very many texts has no such table and is sorted instead.
    """
    known = codes(df, column)
    if known is None:
        return F.max(latest_part(at, F.col(column), keep_null))["value"]
    table = F.array(*map(F.lit, known)).cast("array<string>")
    return F.get(table, newest_int(at, place_of(F.col(column), known), keep_null) - 1)
