"""Table writes: declared tables, full refresh, partition overwrite, append, upsert, compaction."""

from stopwise.sinks.compact import compact
from stopwise.sinks.table import (
    Partition,
    Table,
    day_partition,
    ensure_namespace,
    ensure_table,
    hour_partition,
    prefix_partition,
    with_partitions,
)
from stopwise.sinks.upsert import merge_into, upsert
from stopwise.sinks.write import append, full_refresh, overwrite_partitions

__all__ = [
    "Partition",
    "Table",
    "append",
    "compact",
    "day_partition",
    "ensure_namespace",
    "ensure_table",
    "full_refresh",
    "hour_partition",
    "merge_into",
    "overwrite_partitions",
    "prefix_partition",
    "upsert",
    "with_partitions",
]
