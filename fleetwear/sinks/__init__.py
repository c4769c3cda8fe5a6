from fleetwear.sinks.journal import recover
from fleetwear.sinks.partitions import (
    Written,
    drop_partitions,
    merge_changes,
    merge_partitions,
    replace_partitions,
    report,
    table_report,
    write_partitions,
    write_reported,
)

__all__ = [
    "Written",
    "drop_partitions",
    "merge_changes",
    "merge_partitions",
    "recover",
    "replace_partitions",
    "report",
    "table_report",
    "write_partitions",
    "write_reported",
]
