"""Gold builds of what changed since the last one."""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from stopwise.config import GoldConfig
from stopwise.functions import event_hour
from stopwise.jobs import build_gold
from stopwise.plans import tables
from stopwise.sinks.storage import Storage, Writes, at_once, partition_values
from stopwise.sinks.table import Table, ensure_table

MARK = "_built"
DAY, HOUR = timedelta(days=1), timedelta(hours=1)


def changed_since(spark: SparkSession, table: Table, number: int) -> tuple[int, list[dict[str, str | None]]]:
    """The number of the last write, and the values of the partitions that writes after ``number`` replaced.

    Taken from the names of folders; no file is opened. Rows that ``append`` adds to a partition that was
    there do not change its number and are not seen.
    """
    writes = Writes(Storage(spark, table.location))
    folders = writes.store.leaves("", len(table.partitions))
    return writes.record["last"], [
        partition_values(f) for f, n in zip(folders, at_once(writes.last_write, folders)) if n > number
    ]


def _spans(days: Iterable[str], hours: Iterable[str], reach: timedelta) -> list[tuple[datetime, datetime]]:
    """From and before, in UTC: the days of changed arrivals, and the times that changed observations can serve."""
    spans = [(start, start + DAY) for start in map(datetime.fromisoformat, sorted(days))]
    starts = [datetime.strptime(h, "%Y-%m-%d-%H") for h in sorted(hours)]
    return spans + [(start - reach, start + HOUR + reach) for start in starts]


def _fingerprint(df: DataFrame) -> str:
    """Equal for equal rows in any order."""
    total = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))
    return str(tuple(df.agg(F.count("*"), total).first()))


def refresh_gold(
    spark: SparkSession,
    arrivals: Table,
    weather: Table,
    timetable: DataFrame,
    warehouse: str,
    db: str,
    config: GoldConfig = GoldConfig(),
) -> int:
    """Bring the gold tables up to date with silver tables that are filled by ``upsert``; returns the hours built.

    What has changed is read off the numbers of writes in the partition folders: arrivals by their day, weather
    by its hour, which reaches the arrivals around it. All arrivals of every hour of the roll-up that is
    touched are built again. The numbers seen are stored once gold is written, so a run that dies is repeated;
    they are taken before the rows are read, so a load that comes meanwhile is built by the next run. Another
    configuration or timetable builds everything.
    """
    store = Storage(spark, f"{warehouse.rstrip('/')}/{db}")
    state = {"config": dataclasses.asdict(config), "timetable": _fingerprint(timetable)}
    text = store.read(MARK)
    mark = json.loads(text) if text else {}
    if {k: mark.get(k) for k in state} != state:
        mark = {"arrivals": -1, "weather": -1}
    for table in (arrivals, weather, tables.arrivals_weather(warehouse, db), tables.delay_weather_hourly(warehouse, db)):
        ensure_table(spark, table)
    seen_arrivals, events = changed_since(spark, arrivals, mark["arrivals"])
    seen_weather, observed = changed_since(spark, weather, mark["weather"])
    days = {v["event_date"] for v in events}
    hours = {v["obs_hour"] for v in observed} - {None}
    reach = timedelta(minutes=config.weather_window_minutes + 2 * config.slot_minutes)
    spans = _spans(days - {None}, hours, reach)
    if spans or None in days:
        built = _build(spark, arrivals, weather, timetable, warehouse, db, config, spans, reach, None in days)
    else:
        built = 0
    store.write(MARK, json.dumps({**state, "arrivals": seen_arrivals, "weather": seen_weather}))
    return built


def _build(
    spark: SparkSession,
    arrivals: Table,
    weather: Table,
    timetable: DataFrame,
    warehouse: str,
    db: str,
    config: GoldConfig,
    spans: list[tuple[datetime, datetime]],
    reach: timedelta,
    timeless: bool,
) -> int:
    epoch = datetime(1970, 1, 1)
    ranges = [((a - epoch) // HOUR, -((epoch - b) // HOUR) - 1) for a, b in spans]
    numbers = sorted({n for first, last in ranges for n in range(first, last + 1)})
    # an hour of the roll-up may begin within an hour of UTC
    ends = spark.createDataFrame([(n * 3600 + s,) for n in numbers for s in (0, 3599)], "second bigint")
    touched = ends.select(event_hour(F.timestamp_seconds("second"), config.bucket_tz).alias("hour")).distinct()
    if timeless:
        touched = touched.unionByName(spark.createDataFrame([(None,)], "hour timestamp"))
    pad = 1 + math.ceil(reach / DAY)
    near = {(epoch + n * HOUR).date() + k * DAY for n in numbers for k in range(-pad, pad + 1)}

    def within(column, known: set[date]):
        return column.isin(*[d.isoformat() for d in sorted(known)])

    rows = spark.table(arrivals.name)
    day = within(F.col("event_date").cast("string"), near)
    rows = rows.where(day | F.col("event_date").isNull() if timeless else day)
    same = event_hour(F.col("event_ts"), config.bucket_tz).eqNullSafe(F.col("hour"))
    rows = rows.join(F.broadcast(touched), same, "left_semi")  # an entry per hour, as many as partitions changed
    around = spark.table(weather.name).where(within(F.substring("obs_hour", 1, 10), near))
    build_gold(spark, rows, timetable, around, warehouse, db, config)
    return len(numbers) + timeless
