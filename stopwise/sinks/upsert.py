"""Keyed upsert on partitioned parquet tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stopwise.operators.rows import latest_per_key
from stopwise.sinks.storage import WRITE, Storage, Writes, at_once
from stopwise.sinks.table import Table, as_stored, conform, ensure_table
from stopwise.sinks.write import rebalanced, replace, stage


PROBED_KEYS = 500  # Spark pushes a list as nested alternatives, whose depth is bounded
_PUSHED_VALUES = "spark.sql.parquet.pushdown.inFilterThreshold"


class DuplicateKeys(ValueError):
    """The source of an upsert holds a key more than once."""


class _Key:
    """What makes two rows the same, and the steps of an upsert that depend on it."""

    def __init__(self, table: Table, null_safe: bool) -> None:
        self.table, self.keys, self.null_safe = table, list(table.keys), null_safe

    def known(self) -> Column:
        """Rows whose key can equal another; the others are inserted and never deduplicated."""
        return F.lit(True) if self.null_safe else reduce(and_, [F.col(k).isNotNull() for k in self.keys])

    def resolve(self, source: DataFrame, latest_by: Sequence[Column]) -> DataFrame:
        keyed = latest_per_key(source.where(self.known()), self.keys, latest_by)
        return keyed.unionByName(source.where(~self.known()))

    def reject_duplicates(self, staged: DataFrame) -> None:
        twice = staged.where(self.known()).groupBy(*self.keys).count().where("count > 1").take(3)
        if twice:
            raise DuplicateKeys(f"{self.table.name}: source repeats keys, e.g. {[tuple(r)[:-1] for r in twice]}")

    def kept(self, target: DataFrame, staged: DataFrame) -> DataFrame:
        """Target rows the source does not replace. Rows whose key equals nothing skip the join."""
        left, right = target.where(self.known()).alias("l"), staged.where(self.known()).select(*self.keys).alias("r")
        pairs = [(F.col(f"l.{k}"), F.col(f"r.{k}")) for k in self.keys]
        same = reduce(and_, [a.eqNullSafe(b) if self.null_safe else a == b for a, b in pairs])
        rest = left.join(right, same, "left_anti").select(*target.columns)
        return rest if self.null_safe else rest.unionByName(target.where(~self.known()))


def probe(spark: SparkSession, table: Table, keys: DataFrame, limit: int = PROBED_KEYS) -> DataFrame:
    """Rows of the table that may have one of ``keys``, with ``_metadata``; exact on the first filtered key.

    Up to ``limit`` different values of that key are pushed into the scan as a list, so that row groups whose
    statistics, dictionary or Bloom filter exclude all of them are not read. Beyond it nothing is pushed and the
    key columns are scanned: so many keys would hit every row group.
    """
    rows = spark.table(table.name)
    if not table.filtered_keys:
        return rows
    key = table.filtered_keys[0]
    values = [r[0] for r in keys.select(key).where(F.col(key).isNotNull()).distinct().limit(limit + 1).collect()]
    return rows if len(values) > limit else rows.where(F.col(key).isin(values))


def _touched(
    spark: SparkSession, staged: DataFrame, table: Table, stable_partitions: bool, known: Column, null_safe: bool
) -> list[str]:
    """Partition folders to rewrite: those of the source and, unless a key cannot move, of its matches."""
    found = set(Storage(spark, staged._staged_at).leaves("", len(table.partitions)))
    if not stable_partitions:
        keys = staged.where(known).select(*table.keys)
        old = spark.conf.get(_PUSHED_VALUES)
        spark.conf.set(_PUSHED_VALUES, str(PROBED_KEYS))
        try:
            target = spark.table(table.name) if null_safe else probe(spark, table, keys)
            folder = F.regexp_replace("_metadata.file_path", f"(/{WRITE}=[0-9]+)?/[^/]*$", "")
            place = target.select(*table.keys, folder.alias("__folder")).alias("l")
            pairs = [(F.col(f"l.{k}"), F.col(f"r.{k}")) for k in table.keys]
            same = reduce(and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])
            matches = place.join(keys.alias("r"), same, "left_semi").select("__folder").distinct().collect()
        finally:
            spark.conf.set(_PUSHED_VALUES, old)
        levels = len(table.partitions)
        found |= {"/".join(unquote(r[0]).split("/")[-levels:]) for r in matches}  # one per partition
    return sorted(found)


def upsert(
    spark: SparkSession,
    table: Table,
    source: DataFrame,
    on_duplicate: str = "error",
    latest_by: Sequence[Column] = (),
    stable_partitions: bool = False,
    null_safe: bool = False,
) -> DataFrame:
    """Replace target rows that share a key with the source, insert the others.

    Only the folders of touched partitions are read and rewritten, however many they are. The new content
    is complete in folders of its own before the catalog is switched to them, partition by partition; no file
    is moved. A run that dies at any point leaves a table that the next write to it puts right first.
    ``on_duplicate`` is ``"error"`` or ``"latest"`` (first row by ``latest_by``, which must be given).
    ``stable_partitions`` promises that a key never changes partition, which spares the search for keys in
    the other partitions (see :func:`probe`). A null in a key equals nothing, as in MERGE, unless ``null_safe`` is set. Keys missing from
    the source stay in the table; a source without one of the declared columns is an error, columns that were
    added by ``append`` may be missing and are null then.
    Returns the source as it was written, for further use without computing it again; ``discard`` it then.
    """
    if on_duplicate not in ("error", "latest"):
        raise ValueError(f"unknown duplicate rule {on_duplicate!r}")
    if on_duplicate == "latest" and not latest_by:
        raise ValueError("on_duplicate='latest' needs latest_by")
    ensure_table(spark, table)
    declared, table = table, as_stored(spark, table)
    rule = _Key(table, null_safe)
    incoming = conform(source, table, list(declared.columns))
    if on_duplicate == "latest":
        incoming = rule.resolve(incoming, latest_by)
    staged = stage(spark, incoming, table)
    if on_duplicate == "error":
        rule.reject_duplicates(staged)
    if not table.partitions:
        replace(spark, table, rule.kept(spark.table(table.name), staged).unionByName(staged))
        return staged
    touched = _touched(spark, staged, table, stable_partitions, rule.known(), null_safe)
    writes = Writes(Storage(spark, table.location))
    there = [f"{writes.store.root}/{c}" for c in at_once(writes.current, touched) if c is not None]
    fresh = staged
    if there:  # the folders themselves are read: a pruned scan without any test on partition values
        affected = spark.read.schema(table.stored_schema).option("basePath", writes.store.root).parquet(*there)
        affected = affected.select(*table.columns, *table.partition_names)
        fresh = rule.kept(affected, staged).unionByName(staged)
    replace(spark, table, rebalanced(fresh, table), touched)
    return staged


def merge_into(table_name: str, source: DataFrame, keys: Sequence[str]) -> None:
    """The same upsert as one atomic MERGE, for tables of a catalog with row-level operations."""
    condition = reduce(and_, [F.col(f"{table_name}.{k}") == F.col(f"source.{k}") for k in keys])
    (
        source.alias("source")
        .mergeInto(table_name, condition)
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )
