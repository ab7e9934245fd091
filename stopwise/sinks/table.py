"""Declared parquet tables with derived partition columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stopwise.functions.clock import utc_date, utc_hour_key
from stopwise.sinks.storage import WRITE, Storage, Writes, at_once, partition_values

_PARTITIONS_PER_STATEMENT = 500
_FILTERED_TYPES = ("string", "bigint", "int", "date")


@dataclass(frozen=True)
class Partition:
    """A partition column computed from one stored column, by a function that no session setting changes.

    ``monotone`` transforms keep order, so a range on the source column also prunes partitions.
    """

    name: str
    data_type: str
    source: str
    transform: Callable[[Column], Column]
    monotone: bool = True


def day_partition(source: str, name: str = "event_date") -> Partition:
    """The UTC date of an instant."""
    return Partition(name, "date", source, utc_date)


def hour_partition(source: str, name: str = "event_hour_key") -> Partition:
    """The UTC hour of an instant."""
    return Partition(name, "string", source, utc_hour_key)


def prefix_partition(source: str, length: int, name: str) -> Partition:
    # Empty text would be stored as the null partition, so it is null from the start.
    return Partition(
        name, "string", source, lambda c: F.nullif(F.substring(c, 1, length), F.lit("")), monotone=False
    )


@dataclass(frozen=True)
class Table:
    """Name (``database.table``), location, columns in order, key, and partition columns."""

    name: str
    location: str
    columns: Mapping[str, str]
    keys: Sequence[str] = ()
    partitions: Sequence[Partition] = field(default=())

    @property
    def partition_names(self) -> list[str]:
        return [p.name for p in self.partitions]

    @property
    def filtered_keys(self) -> list[str]:
        """Key columns whose row groups carry Bloom filters, see ``upsert``."""
        return [k for k in self.keys if self.columns[k] in _FILTERED_TYPES]

    @property
    def write_options(self) -> dict[str, str]:
        """Bloom filters on the keys, sized by the values a row group holds."""
        filters = {f"parquet.bloom.filter.enabled#{k}": "true" for k in self.filtered_keys}
        return filters | {"parquet.bloom.filter.adaptive.enabled": "true"} if filters else {}

    @property
    def stored_schema(self) -> str:
        stored = {**self.columns, **{p.name: p.data_type for p in self.partitions}}
        return ", ".join(f"`{name}` {kind}" for name, kind in stored.items())


def ensure_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name}{place}")


def ensure_namespace_of(spark: SparkSession, table_name: str, table_location: str) -> None:
    """The database of ``database.table``, next to the table's folder."""
    if "." in table_name:
        database = table_name.rsplit(".", 1)[0]
        ensure_namespace(spark, database, table_location.rstrip("/").rsplit("/", 1)[0])


def ensure_table(spark: SparkSession, table: Table) -> bool:
    """Create the table if it is absent; an existing one is left as it is. True if created.

    Data already at the location (from an earlier session without a shared catalog) is picked up. Catalog
    changes of a write that was committed by an earlier run and not ended are made first.
    """
    store = Storage(spark, table.location)
    if spark.catalog.tableExists(table.name):
        settle(spark, table, Writes(store))
        return False
    ensure_namespace_of(spark, table.name, table.location)
    store.make("")
    writes = Writes(store)
    folders = store.leaves("", len(table.partitions))
    found = {f: c for f, c in zip(folders, at_once(writes.current, folders)) if c is not None}
    whole = store.root
    if not table.partitions:  # never the root itself, below which a write that has not been committed may lie
        whole = f"{store.root}/{found.get('', f'{WRITE}=0')}".rstrip("/")
        Storage(spark, whole).make("")
    layout = f"PARTITIONED BY ({', '.join(table.partition_names)})" if table.partitions else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table.name} ({table.stored_schema}) USING parquet {layout} LOCATION '{whole}'"
    )
    if table.partitions:
        add_partitions(spark, table, found)
    if writes.pending():
        writes.settled()
    spark.catalog.refreshTable(table.name)
    return True


def partition_spec(folder: str) -> str:
    """``name = 'value', ...`` of one partition folder, for DDL statements."""

    def literal(value: str | None) -> str:
        if value is None:
            return "null"
        text = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{text}'"

    return ", ".join(f"{n} = {literal(v)}" for n, v in partition_values(folder).items())


def _literal(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def add_partitions(spark: SparkSession, table: Table, places: Mapping[str, str]) -> None:
    """Partition folders, and what holds their content, that the catalog may not know yet."""
    root, items = table.location.rstrip("/"), list(places.items())
    for start in range(0, len(items), _PARTITIONS_PER_STATEMENT):
        few = items[start : start + _PARTITIONS_PER_STATEMENT]
        specs = " ".join(f"PARTITION ({partition_spec(f)}) LOCATION {_literal(f'{root}/{c}')}" for f, c in few)
        spark.sql(f"ALTER TABLE {table.name} ADD IF NOT EXISTS {specs}")


def publish(spark: SparkSession, table: Table, filled: Sequence[str]) -> None:
    """Partition folders that were written without a number of their own."""
    if table.partitions:
        add_partitions(spark, table, {f: f for f in filled})
    spark.catalog.refreshTable(table.name)


def settle(spark: SparkSession, table: Table, writes: Writes) -> None:
    """Make the catalog follow the last committed write. Safe to repeat.

    Every partition changes from its old to its new folder in one statement.
    """
    pending = writes.pending()
    if pending is None:
        return
    root, own = table.location.rstrip("/"), f"{WRITE}={pending['number']}"
    if table.partitions:
        new = set(pending["new"])
        add_partitions(spark, table, {f: f"{f}/{own}" for f in pending["filled"]})

        def switch(folder: str) -> None:
            place = _literal(f"{root}/{folder}/{own}")
            spark.sql(f"ALTER TABLE {table.name} PARTITION ({partition_spec(folder)}) SET LOCATION {place}")

        at_once(switch, [f for f in pending["filled"] if f not in new])
        for start in range(0, len(pending["emptied"]), _PARTITIONS_PER_STATEMENT):
            few = pending["emptied"][start : start + _PARTITIONS_PER_STATEMENT]
            specs = ", ".join(f"PARTITION ({partition_spec(f)})" for f in few)
            spark.sql(f"ALTER TABLE {table.name} DROP IF EXISTS {specs}")
    elif pending["filled"]:
        spark.sql(f"ALTER TABLE {table.name} SET LOCATION {_literal(f'{root}/{own}')}")
    spark.catalog.refreshTable(table.name)
    writes.settled()


def with_partitions(df: DataFrame, partitions: Sequence[Partition]) -> DataFrame:
    return df.withColumns({p.name: p.transform(F.col(p.source)) for p in partitions})


class MissingColumns(ValueError):
    """The source of an upsert lacks columns of the table."""


def as_stored(spark: SparkSession, table: Table) -> Table:
    """``table`` with the columns and types the catalog has by now: an append may have added or widened some."""
    stored = {n: k for n, k in spark.table(table.name).dtypes if n not in table.partition_names}
    return replace(table, columns=stored)


def conform(df: DataFrame, table: Table, required: Sequence[str] = ()) -> DataFrame:
    """Exactly the stored columns, in order. Names match in any case; extra columns go.

    Missing columns become null, or are an error if they are ``required``.
    """
    present = {name.lower(): name for name in df.columns}
    missing = [name for name in table.columns if name.lower() not in present]
    if lacking := [name for name in required if name.lower() not in present]:
        raise MissingColumns(f"{table.name}: the source has no {', '.join(lacking)}")
    columns = [
        (F.lit(None) if name in missing else F.col(f"`{present[name.lower()]}`")).cast(kind).alias(name)
        for name, kind in table.columns.items()
    ]
    return with_partitions(df.select(*columns), table.partitions)


def scan(
    spark: SparkSession,
    table: Table,
    columns: Sequence[str] | None = None,
    between: tuple[str, object, object] | None = None,
) -> DataFrame:
    """Projected scan. ``between=(column, from, to)`` (inclusive, either may be None) also bounds the
    partition columns derived from that column, which Spark does not infer on its own."""
    df = spark.table(table.name)
    if between is not None:
        column, start, stop = between
        pruned = [p for p in table.partitions if p.source == column and p.monotone]
        for bound, keep in ((start, Column.__ge__), (stop, Column.__le__)):
            if bound is None:
                continue
            literal = F.lit(bound).cast(table.columns[column])
            df = df.where(keep(F.col(column), literal))
            for p in pruned:
                df = df.where(keep(F.col(p.name), p.transform(literal)))
    return df.select(*(columns or table.columns))
