"""Live weather messages: parse, rename, type, and split off what cannot be read."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stopwise.functions import hash_key, utc_text
from stopwise.schemas import LIVE_FIELDS, METEOROLOGY_CURRENT
from stopwise.sinks.storage import NULL_PARTITION, Storage, at_once, partition_values
from stopwise.sinks.table import Partition, Table, conform, ensure_table, partition_spec, publish

# Every field is read as text: a value of another type is then no reason to lose the message.
_BLOCK = ", ".join(f"`{key}`:string" for key in LIVE_FIELDS)
_MESSAGE = f"struct<current:struct<{_BLOCK}>, {_BLOCK}>"

# Bound of a micro-batch of files, unless the caller gives another. It bounds admission: the rest is read next.
BATCH_BYTES = str(256 * 1024**2)
BATCH_OFFSETS = "1000000"

# Default flush interval, and parts of the air-quality and condition objects.
FLUSH_INTERVAL = "900 seconds"
_AIR_PARTS = {
    "air_co": "co",
    "air_no2": "no2",
    "air_o3": "o3",
    "air_so2": "so2",
    "air_pm2_5": "pm2_5",
    "air_pm10": "pm10",
    "air_us_epa_index": "us-epa-index",
    "air_gb_defra_index": "gb-defra-index",
}
_CONDITION_PARTS = {"condition_text": "text", "condition_icon": "icon", "condition_code": "code"}


def stream_messages(
    spark: SparkSession, path: str | None = None, source_format: str = "text", **options: str
) -> DataFrame:
    """Streaming ``(value, partition_key)``. Text files carry one message per line; for ``kafka``
    give the connection as options. A micro-batch is bounded by size (``maxBytesPerTrigger`` or
    ``maxOffsetsPerTrigger``, with defaults) and by the trigger's time. ``value`` holds the bytes as sent."""
    bound = {"maxOffsetsPerTrigger": BATCH_OFFSETS} if source_format == "kafka" else {"maxBytesPerTrigger": BATCH_BYTES}
    if "maxFilesPerTrigger" in options:
        bound = {}
    reader = spark.readStream.format(source_format).options(**{**bound, **options})
    stream = reader.load(path) if path else reader.load()
    key = F.col("key").cast("string") if "key" in stream.columns else F.lit(None).cast("string")
    return stream.select(F.col("value").cast("binary").alias("value"), key.alias("partition_key"))


def parse_messages(messages: DataFrame) -> DataFrame:
    """Adds ``message`` (null if unreadable) and ``reason`` (null if readable).

    The text is parsed as the only element of an array, so half messages, several messages run
    together, and JSON that is not an object are all told apart from good ones.
    """
    text = F.try_validate_utf8(F.col("value").cast("string"))
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    only = F.from_json(wrapped, f"array<{_MESSAGE}>")
    message = F.when((F.size(only) == 1) & F.trim(text).startswith("{"), F.get(only, F.lit(0)))
    reason = F.when(
        F.col("message").isNull(),
        F.when(text.isNull() & F.col("value").isNotNull(), "not utf-8")
        .when(F.coalesce(F.trim(text), F.lit("")) == "", "empty")
        .when(F.trim(text).startswith("{"), "invalid json")
        .otherwise("not an object"),
    )
    return messages.withColumn("message", message).withColumn("reason", reason)


def _typed(text: Column, kind: str) -> Column:
    if kind in ("int", "bigint"):
        return text.try_cast("double").try_cast(kind)
    return text.try_cast(kind)


def live_rows(parsed: DataFrame) -> DataFrame:
    """Renamed and typed columns of the readable messages, wrapped in ``current`` or bare."""
    fields = [
        _typed(F.coalesce(f"message.current.{key}", f"message.{key}"), kind).alias(name)
        for key, (name, kind) in LIVE_FIELDS.items()
    ]
    epoch = F.coalesce("message.current.last_updated_epoch", "message.last_updated_epoch")
    return parsed.where(F.col("message").isNotNull()).select(
        *fields,
        F.current_timestamp().alias("ingest_time"),
        F.coalesce("partition_key", epoch).alias("raw_partition_key"),
    )


def _batch_partitions() -> tuple[Partition, ...]:
    """The sink a row came through, and the number of its micro-batch there."""
    return (
        Partition("sink", "string", "sink_id", lambda c: c, monotone=False),
        Partition("batch", "bigint", "batch_id", lambda c: c),
    )


def by_batch(table: Table) -> Table:
    """The table with sink and batch number as last partition levels."""
    return Table(table.name, table.location, table.columns, table.keys, (*table.partitions, *_batch_partitions()))


def dead_letter_table(name: str, location: str) -> Table:
    """Failed messages with their bytes as sent."""
    columns = {
        "value": "binary",
        "reason": "string",
        "sink_id": "string",
        "batch_id": "bigint",
        "failed_at": "timestamp",
    }
    return Table(name, location, columns, partitions=_batch_partitions())


def sink_identity(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and dies with the checkpoint, as its batch numbers do."""
    store = Storage(spark, checkpoint)
    if (name := store.read("_sink_id")) is None:
        name = uuid.uuid4().hex
        store.write("_sink_id", name)
    return name


def _folder(table: Table, row: Row) -> str:
    value = lambda v: NULL_PARTITION if v is None else quote(str(v), safe="-")
    return "/".join(f"{n}={value(row[n])}" for n in table.partition_names)


def write_live(
    stream: DataFrame,
    good: Table,
    dead: Table,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the query: rows to ``good``, unreadable messages to ``dead``.

    Both tables are partitioned by sink and batch, and each batch overwrites its own partitions, so a batch
    that is replayed after a failure leaves every message exactly once in exactly one of them. The sink is
    named by a file in the checkpoint: several queries, and a query that begins anew, can share the tables.
    Batches are moved on into the observations, and dropped here, by ``jobs.fold_live``.
    """
    spark = stream.sparkSession
    good = by_batch(good)
    for table in (good, dead):
        ensure_table(spark, table)
    sink = sink_identity(spark, checkpoint)

    def write(rows: DataFrame, table: Table, batch_id: int) -> None:
        own = {"batch_id": F.lit(batch_id), "sink_id": F.lit(sink)}
        rows = conform(rows.withColumns(own), table)
        (
            rows.hint("rebalance", *table.partition_names)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*table.partition_names)
            .parquet(table.location)
        )
        filled = rows.select(*table.partition_names).distinct().collect()  # one row per day of the batch
        publish(rows.sparkSession, table, [_folder(table, r) for r in filled])

    def process(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_messages(batch).persist()
        try:
            write(live_rows(parsed), good, batch_id)
            failed = parsed.where(F.col("message").isNull()).select("value", "reason")
            write(failed.withColumn("failed_at", F.current_timestamp()), dead, batch_id)
        finally:
            parsed.unpersist()

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": FLUSH_INTERVAL}))
        .foreachBatch(process)
        .start()
    )


def ledger_table(name: str, location: str) -> Table:
    """Batches whose rows have been folded into the observations."""
    return Table(name, location, {"sink": "string", "batch": "bigint", "folded_at": "timestamp"})


def unfolded(spark: SparkSession, live: Table, ledger: Table) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of the batches that are not in the ledger, and those batches; None if there are none.

    Batches are found by the names of their partitions; no other file is read.
    """
    for table in (live, ledger):
        ensure_table(spark, table)
    named = "[^=/]*=([^/]*)/[^=/]*=([^/]*)$"
    parts = spark.sql(f"SHOW PARTITIONS {live.name}")
    there = parts.select(*[F.regexp_extract("partition", named, k + 1).alias(n) for k, n in enumerate(("sink", "batch"))])
    there = there.select("sink", F.col("batch").cast("bigint").alias("batch")).distinct()
    new = there.join(spark.table(ledger.name), ["sink", "batch"], "left_anti").collect()  # one row per batch
    if not new:
        return None, None
    batches = spark.createDataFrame(new, "sink string, batch bigint")
    sinks: dict[str, list[int]] = {}
    for sink, batch in new:
        sinks.setdefault(sink, []).append(batch)
    chosen = F.lit(False)
    for sink, numbers in sinks.items():  # on partition columns alone, so other partitions are not listed
        chosen |= (F.col("sink") == sink) & F.col("batch").isin(numbers)
    return spark.table(live.name).where(chosen), batches


def drop_folded(spark: SparkSession, live: Table, ledger: Table) -> int:
    """Remove the partitions of batches in the ledger; returns how many. Safe to repeat.

    The ledger stays: a batch that its stream replays after it was folded is dropped again, not folded twice.
    """
    done = {(r["sink"], r["batch"]) for r in spark.table(ledger.name).collect()}  # one row per batch
    store, folders = Storage(spark, live.location), []
    for (folder,) in spark.sql(f"SHOW PARTITIONS {live.name}").collect():
        values = partition_values(folder)
        if (values["sink"], int(values["batch"])) in done:
            folders.append(folder)
    for start in range(0, len(folders), 500):
        specs = ", ".join(f"PARTITION ({partition_spec(f)})" for f in folders[start : start + 500])
        spark.sql(f"ALTER TABLE {live.name} DROP IF EXISTS {specs}")
    at_once(store.delete, folders)
    spark.catalog.refreshTable(live.name)
    return len(folders)


def observations_from_live(live: DataFrame) -> DataFrame:
    """Live rows in the columns of the batch observations, ready to be upserted into that table.

    Rows without any time are left out: no arrival could ever be near them.
    """

    def parts(column: str, names: dict[str, str]) -> dict[str, Column]:
        return {
            name: F.get_json_object(column, f"$['{key}']") for name, key in names.items()
        }

    known: dict[str, Column] = {
        key: F.col(f"`{name}`") for key, (name, _) in LIVE_FIELDS.items() if key in METEOROLOGY_CURRENT
    }
    known["obs_ts"] = F.coalesce(F.col("`timestamp`"), F.timestamp_seconds("ts_epoch"))
    known |= parts("air_quality", _AIR_PARTS) | parts("weather_condition", _CONDITION_PARTS)
    # The message names no place and no run, which are empty parts of the key.
    known["id"] = hash_key([F.lit(None)] * 4 + [utc_text(known["obs_ts"]), F.lit(None)])
    known["ingest_ts"] = F.col("ingest_time")
    return live.select(
        *[
            known.get(name, F.lit(None)).try_cast(kind).alias(name)
            for name, kind in METEOROLOGY_CURRENT.items()
        ]
    ).where(F.col("obs_ts").isNotNull())
