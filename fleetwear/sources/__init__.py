from fleetwear.sources.bronze import (
    MissingData,
    day_paths,
    path_exists,
    read_envelope,
    read_jsonl,
    read_load_dates,
    read_or_none,
    read_paged,
    require_rows,
)
from fleetwear.sources.tables import (
    date_window,
    listing,
    partition_dates,
    read_partitions,
    read_spans,
    read_window,
)

__all__ = [
    "MissingData",
    "date_window",
    "day_paths",
    "listing",
    "partition_dates",
    "path_exists",
    "read_envelope",
    "read_jsonl",
    "read_load_dates",
    "read_or_none",
    "read_paged",
    "read_partitions",
    "read_spans",
    "read_window",
    "require_rows",
]
