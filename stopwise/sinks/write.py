"""Plain writes. Rows are rebalanced by partition first, so files come out neither tiny nor huge and
a partition that holds most of the rows is written by many tasks.

Files are written where they stay, into a folder of the write's own in every partition, and become visible when
the catalog is switched to it; see ``stopwise.sinks.storage``.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from stopwise.session import scratch_dir
from stopwise.sinks.drift import changed_types, reject_losses, widen
from stopwise.sinks.storage import WRITE, Storage, Writes, at_once, partition_folder
from stopwise.sinks.table import Table, as_stored, conform, ensure_namespace_of, ensure_table, settle


def rebalanced(df: DataFrame, table: Table) -> DataFrame:
    return df.hint("rebalance", *table.partition_names)


def put(df: DataFrame, table: Table, path: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*table.partition_names) if table.partitions else writer).parquet(path)


def put_in_place(df: DataFrame, table: Table, number: int) -> list[str]:
    """Write into the folders of write ``number``, or of the one in column ``WRITE``; returns the partition folders."""
    seen = Observation()
    df = df if WRITE in df.columns else df.withColumn(WRITE, F.lit(number))
    names = table.partition_names
    if names:  # counted while the rows pass, one entry per partition
        df = df.observe(seen, F.collect_set(F.to_json(F.array(*[F.col(n).cast("string") for n in names]))).alias("found"))
    writer = df.write.mode("append").partitionBy(*names, WRITE)
    for option, value in table.write_options.items():
        writer = writer.option(option, value)
    writer.parquet(table.location)
    if not names:
        return [""]
    return sorted({partition_folder(dict(zip(names, json.loads(x)))) for x in seen.get["found"]})


def stage(spark: SparkSession, df: DataFrame, table: Table) -> DataFrame:
    """Write to shared scratch storage and read back: cuts the lineage, evaluates ``df`` once.

    :func:`discard` removes it again.
    """
    path = scratch_dir(spark, "staged")
    put(rebalanced(df, table), table, path)
    staged = spark.read.schema(table.stored_schema).parquet(path)
    staged._staged_at = path
    return staged


def discard(spark: SparkSession, staged: DataFrame) -> None:
    """Delete what :func:`stage` wrote; the frame can no longer be read."""
    Storage(spark, staged._staged_at).delete("")


def replace(spark: SparkSession, table: Table, df: DataFrame, touched: Sequence[str] = ()) -> None:
    """New content for the partitions ``df`` has rows for (for the whole table if it has no partitions).

    ``touched`` partition folders that ``df`` has no rows for are emptied.
    """
    writes = Writes(Storage(spark, table.location))
    number = writes.begin()
    filled = put_in_place(df, table, number)
    if not table.partitions:
        writes.store.make(f"{WRITE}={number}")
    writes.commit(number, filled, sorted(set(touched) - set(filled)) if table.partitions else [])
    settle(spark, table, writes)


def overwrite_partitions(spark: SparkSession, table: Table, df: DataFrame) -> None:
    """Dynamic partition overwrite: partitions without a row in ``df`` stay."""
    ensure_table(spark, table)
    table = as_stored(spark, table)
    replace(spark, table, rebalanced(conform(df, table), table))


def append(spark: SparkSession, table: Table, df: DataFrame) -> Table:
    """Append; columns the table lacks are added to it, columns ``df`` lacks are null.

    Names match in any case. Where types differ the stored type becomes the wider one (:mod:`stopwise.sinks.drift`);
    if neither holds the other, values that the stored type would change are a ``TypeDrift`` error and nothing
    is written. Returns the table with its grown column list.
    """
    ensure_table(spark, table)
    stored = spark.table(table.name).schema.fields
    grown = as_stored(spark, table)
    wide, doubtful = changed_types(df, grown, stored)
    if doubtful:
        reject_losses(df, grown, doubtful)
    if wide:
        grown = widen(spark, grown, wide)
    known = {f.name.lower() for f in stored}
    added = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name.lower() not in known}
    if added:
        columns = ", ".join(f"`{name}` {kind}" for name, kind in added.items())
        spark.sql(f"ALTER TABLE {table.name} ADD COLUMNS ({columns})")
        grown = dataclasses.replace(grown, columns={**grown.columns, **added})
    add_rows(spark, grown, conform(df, grown))
    return grown


def add_rows(spark: SparkSession, table: Table, rows: DataFrame) -> None:
    """Add files to the folders that hold the content of their partitions; new partitions get a folder of this write.

    The partitions are found first, by a scan of the partition columns alone, so ``rows`` must come out the
    same when it is read again. Spark's commit protocol decides when the files appear.
    """
    writes = Writes(Storage(spark, table.location))
    number, names = writes.begin(), table.partition_names
    folders = {"": None}
    if names:
        values = rows.select(*[F.col(n).cast("string") for n in names]).distinct().collect()  # one row per partition
        folders = {partition_folder(r.asDict()): r for r in values}
    held = dict(zip(folders, at_once(writes.current, folders)))
    own = f"{WRITE}={number}"
    at = {f: int(c.rsplit("=", 1)[1]) for f, c in held.items() if c is not None and c != f}
    if flat := [f for f, c in held.items() if c is not None and c == f]:
        raise ValueError(f"{table.name}: {flat[0] or 'its folder'} was not written by this library")
    if names:
        schema = ", ".join(f"`{n}` string" for n in names) + f", `{WRITE}` int"
        targets = spark.createDataFrame([(*r, at.get(f, number)) for f, r in folders.items()], schema)
        same = [F.col(f"l.{n}").cast("string").eqNullSafe(F.col(f"r.{n}")) for n in names]
        placed = rows.alias("l").join(F.broadcast(targets).alias("r"), reduce(and_, same), "left").select("l.*", WRITE)
        placed = placed.withColumn(WRITE, F.coalesce(WRITE, F.lit(number)))
    else:
        placed = rows.withColumn(WRITE, F.lit(at.get("", number)))
    filled = put_in_place(rebalanced(placed, table), table, number)
    fresh = [f for f in filled if f not in at]
    if not table.partitions and fresh:
        writes.store.make(own)
    writes.commit(number, fresh, [])
    settle(spark, table, writes)


def full_refresh(spark: SparkSession, name: str, location: str, df: DataFrame) -> None:
    """Create or replace the table with the result of a query; the schema is the query's."""
    ensure_namespace_of(spark, name, location)
    (
        df.hint("rebalance")
        .write.mode("overwrite")
        .format("parquet")
        .option("path", location)
        .saveAsTable(name)
    )
