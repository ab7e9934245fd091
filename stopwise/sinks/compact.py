"""Small-file compaction."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from stopwise.sinks.storage import WRITE, Storage, Writes, at_once
from stopwise.sinks.table import Table, as_stored, ensure_table, settle
from stopwise.sinks.write import put_in_place

TARGET_FILE_BYTES = 128 * 1024 * 1024


def data_files(spark: SparkSession, table: Table, small_bytes: int = 0) -> DataFrame:
    """``(folder, files, bytes, small)`` per partition folder, from the listing; no file is opened."""
    writes = Writes(Storage(spark, table.location))
    folders = writes.store.leaves("", len(table.partitions))
    held = {f: c for f, c in zip(folders, at_once(writes.current, folders)) if c is not None}
    if not held:
        return spark.createDataFrame([], "folder string, files long, bytes long, small long")
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .load([f"{writes.store.root}/{c}" for c in held.values()])
        .select(F.regexp_replace("path", f"(/{WRITE}=[0-9]+)?/[^/]*$", "").alias("folder"), "length")
    )
    return found.groupBy("folder").agg(
        F.count("*").alias("files"),
        F.sum("length").alias("bytes"),
        F.count_if(F.col("length") < small_bytes).alias("small"),
    )


def compact(
    spark: SparkSession,
    table: Table,
    target_file_bytes: int = TARGET_FILE_BYTES,
    cluster_by: Sequence[str] = (),
    every: bool = False,
) -> int:
    """Rewrite the partitions that have two or more files below half the target; returns how many.

    A partition of ``b`` bytes gets ``ceil(b / target)`` files of like size, none of which is then below
    half the target unless it is the only one, so a compacted partition is not taken up again. Rows are
    unchanged. Partitions that are already compact are neither read nor written, unless ``every`` is set.

    With ``cluster_by`` the rows of a partition are also put in the order of these columns and cut into files by
    ranges of them, so statistics of files and row groups exclude most of a partition from a scan for a value.
    Ranges run over partitions: one may end in a short file and the next begin with one, so a clustered
    partition is taken up again from three short files on. Equal values are spread by a hash of the row.
    """
    ensure_table(spark, table)
    table = as_stored(spark, table)
    writes = Writes(Storage(spark, table.location))
    short = 2 if cluster_by else 1
    listed = data_files(spark, table, target_file_bytes // 2)
    listed = listed.where(F.lit(every) | (F.col("small") > short)).collect()  # one row per partition
    if not listed:
        return 0
    levels = len(table.partitions)
    plain = lambda path: "/".join(unquote(path).split("/")[-levels:]) if levels else ""
    files = {plain(r["folder"]): math.ceil(r["bytes"] / target_file_bytes) for r in listed}
    held = dict(zip(files, at_once(writes.current, files)))
    paths = [f"{writes.store.root}/{c}" for c in held.values()]
    rows = spark.read.schema(table.stored_schema).option("basePath", writes.store.root).parquet(*paths)
    first = dict(zip(files, itertools.accumulate([0, *files.values()])))
    sizes = spark.createDataFrame([(f, first[f], n) for f, n in files.items()], "__folder string, __first int, __files int")
    url = F.url_decode(F.regexp_replace(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")), f"(/{WRITE}=[0-9]+)?/[^/]*$", ""))
    folder = F.array_join(F.slice(F.split(url, "/"), -levels, levels), "/") if levels else F.lit("")
    placed = rows.select(*table.columns, *table.partition_names, folder.alias("__at"))
    spread, total = F.xxhash64(*table.columns), sum(files.values())
    if levels:
        placed = placed.join(F.broadcast(sizes), F.col("__at") == F.col("__folder"))
    else:  # one folder: its number of files is a constant
        placed = placed.withColumns({"__first": F.lit(0), "__files": F.lit(total)})
    if cluster_by:
        ranged = placed.repartitionByRange(total, "__first", *cluster_by, spread)
        keyed = ranged.sortWithinPartitions(*table.partition_names, *cluster_by)
    else:  # every file is a number, and every number a task of its own
        number = F.col("__first") + F.pmod(spread, "__files")
        keyed = placed.repartitionById(total, number.cast("int"))
    keyed = keyed.select(*table.columns, *table.partition_names)
    own = writes.begin()
    writes.commit(own, put_in_place(keyed, table, own), [])
    settle(spark, table, writes)
    return len(files)
