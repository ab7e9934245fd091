"""Arrival documents to predictions (one row per predicted bus) and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stopwise.functions import hash_key, naive_to_instant, utc_text
from stopwise.operators import latest_per_key, normalize_headers, optional_column, parse_json_array
from stopwise.plans.fields import declared, each, named
from stopwise.schemas import (
    ARRIVALS_PREDICTIONS,
    ARRIVE_FIELDS,
    ARRIVE_ITEM,
    INCIDENT_ITEM,
    STOP_INFO_FIELDS,
    STOP_INFO_ITEM,
    STOPS,
)

INCIDENTS = "incident_listaincident_data"


def parse_arrivals(raw: DataFrame, source_tz: str | None = None, repair_literals: bool = True) -> DataFrame:
    """Event time and the parsed arrays, with a ``*_bad`` flag beside each."""
    df = normalize_headers(raw, "basic")
    df = df.withColumns(
        {
            "event_ts": naive_to_instant(F.col("timestamp"), source_tz),
            "event_ts_bad": (F.trim("timestamp") != "") & naive_to_instant(F.col("timestamp"), source_tz).isNull(),
            INCIDENTS: optional_column(df, INCIDENTS, "string"),
        }
    ).drop("timestamp")
    cells = {"arrive": ARRIVE_ITEM, "stopinfo": STOP_INFO_ITEM, INCIDENTS: INCIDENT_ITEM}
    for column, items in cells.items():
        df = parse_json_array(df, column, items, f"{column}_json", repair_literals)
    return df


def predictions(parsed: DataFrame, keep_empty: bool = True, null_safe_key: bool = True) -> DataFrame:
    """One row per element of the arrivals array.

    With ``keep_empty`` a poll without arrivals leaves one row of nulls, which later counts.
    """
    fields = declared("bus", ARRIVE_FIELDS, own={"line": "line", "stop_id": "stopid"})
    polls = parsed.withColumn("__at", utc_text(F.col("event_ts")))  # once a poll, not once an item
    rows = each(polls, "arrive_json", "bus", keep_empty).select("event_ts", "__at", *named(fields))
    key = [F.col(c) for c in ("__at", "stop_id", "line", "bus", "estimate_arrive_sec")]
    return rows.withColumns(
        {"id": hash_key(key, null_safe_key), "ingest_ts": F.current_timestamp()}
    ).select(*ARRIVALS_PREDICTIONS)


def stops(parsed: DataFrame) -> DataFrame:
    """Latest description of each stop, from the first element of the stop array."""
    # The first element comes out of a generator, below which Spark does not copy the null filter
    # (and with it the whole JSON parse).
    first = each(parsed.select("event_ts", "stopinfo_json"), F.slice("stopinfo_json", 1, 1), "place")
    rows = first.select("event_ts", *named(declared("place", STOP_INFO_FIELDS))).where(F.col("stop_id").isNotNull())
    return (
        latest_per_key(rows, ["stop_id"], [F.col("event_ts").desc_nulls_last()])
        .withColumn("updated_ts", F.current_timestamp())
        .select(*STOPS)
    )


def ingest_arrivals(raw: DataFrame, source_tz: str | None = None) -> dict[str, DataFrame]:
    parsed = parse_arrivals(raw, source_tz)
    return {"arrivals_predictions": predictions(parsed), "stops": stops(parsed)}
