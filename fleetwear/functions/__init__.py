from fleetwear.functions.columns import (
    codes,
    dated_int,
    dated_parts,
    latest_part,
    model_line,
    narrow_int,
    newest_int,
    newest_int_of_day,
    newest_text,
    parse_ts,
    place_of,
    positive_zero,
    ratio,
    share_pct,
    short_id,
    to_bool,
    to_double,
    whole_days,
)

__all__ = [
    "codes",
    "dated_int",
    "dated_parts",
    "latest_part",
    "model_line",
    "narrow_int",
    "newest_int",
    "newest_int_of_day",
    "newest_text",
    "parse_ts",
    "place_of",
    "positive_zero",
    "ratio",
    "share_pct",
    "short_id",
    "to_bool",
    "to_double",
    "whole_days",
]
