"""The jobs that write: raw documents to silver tables, silver tables to gold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stopwise.config import GoldConfig
from stopwise.functions import utc_date, utc_hour_key
from stopwise.operators import latest_per_key
from stopwise.plans import enrich, hourly_rollup, ingest_arrivals, ingest_lines, parse_weather, tables
from stopwise.sinks import Table, append, compact, full_refresh, merge_into, upsert
from stopwise.sinks.write import discard
from stopwise.sources.quarantine import split_documents
from stopwise.streaming.live import by_batch, drop_folded, ledger_table, observations_from_live, unfolded

METHODS = ("rewrite", "merge")


def _store(
    spark: SparkSession, table: Table, df: DataFrame, method: str, latest_by: Sequence[Column] = (), **rules: bool
) -> DataFrame:
    """Upsert by rewriting touched partitions, or by MERGE where the catalog has row-level operations.

    Returns the rows as written, to be discarded by the caller, or for a MERGE the rows themselves.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "merge":
        df = latest_per_key(df, list(table.keys), latest_by) if latest_by else df
        merge_into(table.name, df, table.keys)
        return df
    return upsert(spark, table, df, "latest" if latest_by else "error", latest_by, **rules)


def _store_and_discard(spark: SparkSession, table: Table, df: DataFrame, method: str, *args, **rules: bool) -> None:
    written = _store(spark, table, df, method, *args, **rules)
    if method == "rewrite":
        discard(spark, written)


def documents_or_quarantine(
    spark: SparkSession, path: str, columns: Sequence[str], warehouse: str, db: str, kind: str = "csv"
) -> DataFrame:
    """The good rows of documents; lines that cannot be read go to ``quarantined_documents``, once however often it runs."""
    good, bad = split_documents(spark, path, columns, kind)
    # a file stays in its folder, so a key never changes partition
    target = tables.quarantined_documents(warehouse, db)
    _store_and_discard(spark, target, bad.withColumn("seen_at", F.current_timestamp()), "rewrite", stable_partitions=True)
    return good


def load_arrivals(
    spark: SparkSession, raw: DataFrame, warehouse: str, db: str, source_tz: str | None = None, method: str = "rewrite"
) -> None:
    """Predictions and stops. Loading the same documents again changes nothing but the load time."""
    frames = ingest_arrivals(raw, source_tz)
    predictions = tables.arrivals_predictions(warehouse, db)
    # The key is made of the event time and the line, so a key never changes partition.
    latest = [F.col("ingest_ts").desc()]
    _store_and_discard(spark, predictions, frames["arrivals_predictions"], method, latest, stable_partitions=True)
    _store_and_discard(spark, tables.stops(warehouse, db), frames["stops"], method)


def load_lines(spark: SparkSession, raw: DataFrame, warehouse: str, db: str) -> None:
    """Line master, line stops and timetable, replaced as a whole."""
    for name, frame in ingest_lines(raw).items():
        full_refresh(spark, f"{db}.{name}", f"{warehouse.rstrip('/')}/{db}/{name}", frame)


def load_weather(
    spark: SparkSession, raw: DataFrame, warehouse: str, db: str, source_tz: str | None = None, method: str = "rewrite"
) -> None:
    target = tables.meteorology_current(warehouse, db)
    latest = [F.col("ingest_ts").desc()]
    _store_and_discard(spark, target, parse_weather(raw, source_tz), method, latest, stable_partitions=True)


def load_live(spark: SparkSession, live: DataFrame, warehouse: str, db: str, method: str = "rewrite") -> None:
    """Rows of the live table into the observations, where the gold build finds them."""
    target = tables.meteorology_current(warehouse, db)
    latest = [F.col("ingest_ts").desc()]
    _store_and_discard(spark, target, observations_from_live(live), method, latest, stable_partitions=True)


def fold_live(
    spark: SparkSession, live_warehouse: str, live_db: str, warehouse: str, db: str, method: str = "rewrite"
) -> int:
    """Move the batches of the live table that were not folded yet into the observations; returns how many.

    First the rows are upserted, then the batches are entered in the ledger, then their partitions are dropped:
    a run that dies in between is finished by the next one, and no row is lost or counted twice.
    """
    live = by_batch(tables.live_weather(live_warehouse, live_db))
    ledger = ledger_table(f"{live_db}.folded", f"{live_warehouse.rstrip('/')}/{live_db}/folded")
    rows, batches = unfolded(spark, live, ledger)
    if rows is None:
        drop_folded(spark, live, ledger)
        return 0
    load_live(spark, rows, warehouse, db, method)
    append(spark, ledger, batches.withColumn("folded_at", F.current_timestamp()))
    drop_folded(spark, live, ledger)
    return batches.count()


def build_gold(
    spark: SparkSession,
    arrivals: DataFrame,
    timetable: DataFrame,
    weather: DataFrame,
    warehouse: str,
    db: str,
    config: GoldConfig = GoldConfig(),
    unique_ids: bool = True,
    between: tuple[str, str] | None = None,
) -> tuple[Table, Table]:
    """Enriched arrivals and hourly roll-up, then compaction of both.

    The enrichment runs once: the roll-up reads what the first upsert has written to scratch. ``between``
    are two instants as text, from and before: only arrivals in that range are built, with the weather
    around it. Both should be full hours, since an hour of the roll-up is replaced as a whole.
    """
    facts, hourly = tables.arrivals_weather(warehouse, db), tables.delay_weather_hourly(warehouse, db)
    if between is not None:
        start, stop = (F.lit(x).cast("timestamp") for x in between)
        reach = F.make_interval(mins=F.lit(config.weather_window_minutes + 2 * config.slot_minutes))
        arrivals = arrivals.where((F.col("event_ts") >= start) & (F.col("event_ts") < stop))
        weather = weather.where(F.col("obs_ts").between(start - reach, stop + reach))
        arrivals = _bounded(arrivals, "event_date", utc_date(start), utc_date(stop))
        weather = _bounded(weather, "obs_hour", utc_hour_key(start - reach), utc_hour_key(stop + reach))
    enriched = enrich(arrivals, timetable, weather, config, unique_ids=unique_ids)
    written = upsert(spark, facts, enriched, stable_partitions=True)
    # a null line is a group of the roll-up like any other, and is replaced like any other
    rolled = upsert(spark, hourly, hourly_rollup(written, config), stable_partitions=True, null_safe=True)
    for staged in (written, rolled):
        discard(spark, staged)
    for table in (facts, hourly):
        compact(spark, table)
    return facts, hourly


def _bounded(df: DataFrame, partition: str, low: Column, high: Column) -> DataFrame:
    """Bounds on the partition column too, where the input is a table that has it."""
    return df.where(F.col(partition).between(low, high)) if partition in df.columns else df
