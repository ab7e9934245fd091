"""The silver and gold tables below one warehouse folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.sinks.table import Partition, Table, day_partition, hour_partition, prefix_partition


def _table(warehouse: str, db: str, name: str, columns: dict[str, str], **layout) -> Table:
    return Table(f"{db}.{name}", f"{warehouse.rstrip('/')}/{db}/{name}", columns, **layout)


def arrivals_predictions(warehouse: str, db: str) -> Table:
    parts = (day_partition("event_ts"), prefix_partition("line", 2, "line_prefix"))
    return _table(
        warehouse, db, "arrivals_predictions", schemas.ARRIVALS_PREDICTIONS, keys=("id",), partitions=parts
    )


def stops(warehouse: str, db: str) -> Table:
    return _table(warehouse, db, "stops", schemas.STOPS, keys=("stop_id",))


def meteorology_current(warehouse: str, db: str) -> Table:
    parts = (hour_partition("obs_ts", "obs_hour"),)
    return _table(
        warehouse, db, "meteorology_current", schemas.METEOROLOGY_CURRENT, keys=("id",), partitions=parts
    )


def arrivals_weather(warehouse: str, db: str) -> Table:
    parts = (day_partition("event_ts"),)
    return _table(warehouse, db, "arrivals_weather", schemas.ARRIVALS_WEATHER, keys=("id",), partitions=parts)


def delay_weather_hourly(warehouse: str, db: str) -> Table:
    parts = (day_partition("event_hour"),)
    return _table(
        warehouse,
        db,
        "delay_weather_hourly",
        schemas.DELAY_WEATHER_HOURLY,
        keys=("event_hour", "line"),
        partitions=parts,
    )


def live_weather(warehouse: str, db: str) -> Table:
    columns = {
        **dict(schemas.LIVE_FIELDS.values()),
        "ingest_time": "timestamp",
        "raw_partition_key": "string",
        "sink_id": "string",
        "batch_id": "bigint",
    }
    parts = (day_partition("timestamp"),)
    return _table(warehouse, db, "live_weather", columns, keys=("ts_epoch",), partitions=parts)


def quarantined_documents(warehouse: str, db: str) -> Table:
    """Lines of documents that could not be read, by the folder of their file."""
    columns = {"file": "string", "line": "bigint", "reason": "string", "raw": "string", "seen_at": "timestamp"}
    folder = lambda c: F.nullif(F.regexp_extract(c, "([^/]*)/[^/]*$", 1), F.lit(""))
    parts = (Partition("folder", "string", "file", folder, monotone=False),)
    return _table(warehouse, db, "quarantined_documents", columns, keys=("file", "line"), partitions=parts)
