"""Live rows with state: hourly roll-up, deduplication, nearest observation. A watermark bounds each state.

The watermark follows the latest event time seen, less ``lateness``. A source that falls silent holds back what
waits for it, so a steady source of heartbeats is worth having; see :func:`nearest_in_streams`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from stopwise.config import GoldConfig
from stopwise.operators.nearest import reach_in_slots
from stopwise.plans.gold import rollup_measures
from stopwise.schemas import DELAY_WEATHER_HOURLY
from stopwise.sinks import Table, upsert
from stopwise.sinks.write import discard

CELL_SECONDS = 60  # of the cells in which events meet observations, a part of a slot


def roll_up_hours(facts: DataFrame, lateness: str = "2 hours", config: GoldConfig = GoldConfig()) -> DataFrame:
    """The hourly roll-up of a stream of enriched arrivals: one state row per hour and line.

    An hour stays open until the watermark has passed its end. Hours are those of UTC offsets in whole hours,
    which a state by event time needs; ``bucket_tz`` shifts their name as in the batch roll-up. Rows without a
    time are left out.
    """
    start = F.col("hour.start")
    if config.bucket_tz is not None:
        start = F.from_utc_timestamp(start, config.bucket_tz)
    hours = facts.withWatermark("event_ts", lateness).groupBy(F.window("event_ts", "1 hour").alias("hour"), "line")
    rolled = hours.agg(*rollup_measures()).withColumns({"event_hour": start, "build_ts": F.current_timestamp()})
    return rolled.select(*DELAY_WEATHER_HOURLY)


def write_rollup(rolled: DataFrame, table: Table, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Upsert the hours that each micro-batch has changed; a batch that is replayed changes nothing."""

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        discard(spark, upsert(spark, table, batch, stable_partitions=True, null_safe=True))

    return (
        rolled.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .foreachBatch(store)
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were left out, in the progress the query still remembers.

    Spark counts them where they meet the state: for a roll-up, after the rows of a task that fall into one
    hour and line have been added up.
    """
    return sum(int(state["numRowsDroppedByWatermark"]) for p in query.recentProgress for state in p["stateOperators"])


def deduplicated(stream: DataFrame, keys: Sequence[str], event_ts: str, within: str = "1 day") -> DataFrame:
    """The first row of every key. A repeat that comes up to ``within`` later in event time is left out; the
    state forgets a key after that, and rows later than the watermark are left out too."""
    return stream.withWatermark(event_ts, within).dropDuplicatesWithinWatermark(list(keys))


def nearest_in_streams(
    events: DataFrame,
    observations: DataFrame,
    event_ts: str,
    obs_ts: str,
    obs_id: str,
    keys: Sequence[str],
    lateness: str = "2 hours",
    window_minutes: int = 60,
    slot_minutes: int = 30,
    mode: str = "slot",
) -> DataFrame:
    """Each event of a stream with the nearest observation of another, by the rules of ``nearest_join``.

    No pair of event and observation is formed. Observations shrink to one per second and are gathered in sliding
    windows, one around every slot with an observation in reach: of the slot itself all seconds, of the others the
    last one before and the first one after it. A window is cut into cells of a minute, each with the seconds that
    can be nearest in it, at most 62, and an event is joined with the one row of its cell, within an interval that
    lets the state forget rows. An event comes out once, when the watermark of both streams has passed its window,
    without an observation if there is none. ``keys`` and ``event_ts`` tell events apart; equal ones are one.
    Columns: ``keys``, ``event_ts``, ``obs_ts`` and the other columns of ``observations``.
    """
    reach = reach_in_slots(window_minutes, slot_minutes, mode)
    cell = lambda c: F.floor(F.unix_seconds(c) / CELL_SECONDS)
    minutes = lambda n: F.expr(f"INTERVAL {n} MINUTES")
    left = events.select(*keys, F.col(event_ts).alias("__event")).withWatermark("__event", lateness)
    left = left.withColumn("__cell", cell(F.col("__event")))
    others = [c for c in observations.columns if c not in (obs_ts, obs_id)]
    right = observations.select(F.col(obs_ts).alias("__obs"), F.col(obs_id).alias("__id"), F.struct(*others).alias("__rest"))
    seconds = (
        right.withWatermark("__obs", lateness)
        .groupBy(F.window("__obs", "1 second").alias("__second"))
        .agg(F.min(F.struct("__obs", "__id", "__rest")).alias("found"))
        .select(F.window_time("__second").alias("__at"), "found")
    )
    around = F.window("__at", f"{(2 * reach + 1) * slot_minutes} minutes", f"{slot_minutes} minutes")
    first = F.col("around.start") + minutes(reach * slot_minutes)
    before, after = F.col("__at") < first, F.col("__at") >= first + minutes(slot_minutes)
    gathered = (
        seconds.withColumn("around", around)
        .groupBy("around")
        .agg(
            F.max_by(F.when(before, F.col("found")), F.when(before, F.col("__at"))).alias("before"),
            F.min_by(F.when(after, F.col("found")), F.when(after, F.col("__at"))).alias("after"),
            F.collect_list(F.when(~before & ~after, F.col("found"))).alias("within"),
        )
    )
    # in order of time; an entry that is not there is null
    known = F.concat(F.array("before"), F.sort_array("within"), F.array("after"))
    numbers = F.sequence(cell(first), cell(first) + slot_minutes * 60 // CELL_SECONDS - 1)
    cells = gathered.select(F.window_time("around").alias("__piece"), known.alias("known"), F.explode(numbers).alias("__place"))
    place = lambda o: cell(o["__obs"])
    earlier = F.filter("known", lambda o: place(o) < F.col("__place"))
    later = F.filter("known", lambda o: place(o) > F.col("__place"))
    here = F.filter("known", lambda o: place(o) == F.col("__place"))
    near = F.concat(F.slice(F.reverse(earlier), 1, 1), here, F.slice(later, 1, 1))
    cells = cells.select("__piece", "__place", near.alias("__near"))
    # a window ends ``reach`` slots after the end of its own slot, and its time is just before that
    timed = F.col("__piece").between(
        F.col("__event") + minutes(reach * slot_minutes), F.col("__event") + minutes((reach + 1) * slot_minutes)
    )
    joined = left.join(cells, (F.col("__cell") == F.col("__place")) & timed, "left_outer")
    apart = lambda o: F.abs(F.unix_seconds("__event") - F.unix_seconds(o["__obs"]))
    within = F.filter("__near", lambda o: apart(o) <= window_minutes * 60) if mode == "exact" else F.col("__near")
    found = F.array_min(F.transform(within, lambda o: F.struct(apart(o).alias("apart"), o["__obs"], o["__id"], o["__rest"])))
    best = joined.withColumn("__found", found).groupBy(*keys, "__event").agg(F.min("__found").alias("best"))
    return best.select(
        *keys,
        F.col("__event").alias(event_ts),
        F.col("best.__obs").alias(obs_ts),
        F.col("best.__id").alias(obs_id),
        *[F.col(f"best.__rest.{c}").alias(c) for c in others],
    )


def write_rows(stream: DataFrame, location: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append to parquet files, each row once."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start(location)
    )
