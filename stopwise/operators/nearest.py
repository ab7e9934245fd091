"""Nearest-in-time matching and band aggregates, linear in both inputs.

Time is compared in whole seconds. That bounds every group here: a slot of ``slot_minutes`` holds at
most ``60 * slot_minutes`` distinct seconds, however many observations fall into it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from stopwise.functions.clock import slot_number
from stopwise.operators.skew import field_bytes, fits, lookup_join

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
CELL_SECONDS = 300


def reach_in_slots(window_minutes: int, slot_minutes: int, mode: str) -> int:
    if mode == "slot":
        return window_minutes // slot_minutes
    if mode == "exact":
        return -(-window_minutes // slot_minutes)
    raise ValueError(f"unknown window mode {mode!r}")


def _one_per_second(observations: DataFrame, obs_ts: str, obs_id: str, slot_minutes: int) -> DataFrame:
    """``(sec, slot, obs)`` with the earliest observation of each second, ties by id."""
    return (
        observations.where(F.col(obs_ts).isNotNull())
        .groupBy(F.unix_seconds(F.col(obs_ts)).alias("sec"))
        .agg(F.min_by(F.struct("*"), F.struct(obs_ts, obs_id)).alias("obs"))
        .withColumn("slot", F.floor(F.col("sec") / (slot_minutes * 60)).cast("bigint"))
    )


def _measure(observations: DataFrame, obs_ts: str, slot_minutes: int) -> Row:
    """From one job: seconds with an observation, slots, widest row."""
    width = sum((field_bytes(f) for f in observations.schema.fields), F.lit(0))
    return (
        observations.where(F.col(obs_ts).isNotNull())
        .groupBy(F.unix_seconds(F.col(obs_ts)).alias("sec"))
        .agg(F.max(width).alias("width"))
        .groupBy(F.floor(F.col("sec") / (slot_minutes * 60)))
        .agg(F.count("*").alias("n"), F.max("width").alias("width"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count("*").alias("slots"),
            F.coalesce(F.max("width"), F.lit(0)).alias("widest"),
        )
        .first()
    )


def neighbour_pieces(seconds: DataFrame, reach: int, slot_minutes: int, cell_seconds: int) -> DataFrame:
    """Time cut into pieces with one previous and one next observation each.

    A piece ``[from_sec, to_sec)`` lies within one cell and starts at a cell border or at an
    observation. From outside its slot a piece can only need the last observation before the slot
    and the first one after it, so just those two are carried over from each neighbour.
    """
    slot_seconds = slot_minutes * 60
    extremes = seconds.groupBy("slot").agg(
        F.min_by(F.struct("sec", "obs"), "sec").alias("first"),
        F.max_by(F.struct("sec", "obs"), "sec").alias("last"),
    )

    def row(slot: Column, sec: Column, obs: Column) -> Column:
        return F.struct(slot.cast("bigint").alias("slot"), sec.alias("sec"), obs.alias("obs"))

    slot, offsets = F.col("slot"), range(1, reach + 1)
    no_obs = F.lit(None).cast(seconds.schema["obs"].dataType)
    carried = [row(slot + o, F.col("last.sec"), F.col("last.obs")) for o in offsets] + [
        row(slot - o, F.col("first.sec"), F.col("first.obs")) for o in offsets
    ]
    starts = F.sequence(
        (slot - reach) * slot_seconds,
        (slot + reach + 1) * slot_seconds - cell_seconds,
        F.lit(cell_seconds).cast("bigint"),
    )
    # A border can come from several slots; all but one of its pieces are empty and fall away.
    borders = F.transform(starts, lambda sec: row(F.floor(sec / slot_seconds), sec, no_obs))
    points = (
        extremes.select(F.inline(F.concat(F.array(*carried), borders) if carried else borders))
        .unionByName(seconds.select("slot", "sec", "obs"))
        .withColumn("match", F.when(F.col("obs").isNotNull(), F.struct("sec", "obs")))
    )
    # Observations sort after a cell border of the same second.
    up = Window.partitionBy("slot").orderBy("sec", F.col("obs").isNotNull())
    down = Window.partitionBy("slot").orderBy(F.desc("sec"), F.col("obs").isNotNull().desc())
    cell_end = (F.floor(F.col("sec") / cell_seconds).cast("bigint") + 1) * cell_seconds
    return (
        points.withColumns(
            {
                "previous": F.last("match", ignorenulls=True).over(up),
                "to_sec": F.least(F.lead("sec").over(up), cell_end),
            }
        )
        .withColumn(
            "following",
            F.last("match", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .where(F.floor(F.col("sec") / slot_seconds) == F.col("slot"))
        .where(F.col("to_sec") > F.col("sec"))
        .select(
            F.floor(F.col("sec") / cell_seconds).cast("bigint").alias("__cell"),
            F.col("sec").alias("__from"),
            F.col("to_sec").alias("__to"),
            F.col("previous").alias("__previous"),
            F.col("following").alias("__following"),
        )
    )


def nearest_join(
    events: DataFrame,
    observations: DataFrame,
    event_ts: str,
    obs_ts: str,
    obs_id: str,
    spread_by: Sequence[str],
    window_minutes: int = 60,
    slot_minutes: int = 30,
    mode: str = "slot",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    cell_seconds: int = CELL_SECONDS,
) -> DataFrame:
    """Each event with the nearest observation in its window; events without one keep nulls.

    ``mode="slot"``: the slots of both may lie up to ``window_minutes`` apart. ``mode="exact"``: the
    two instants may. Equally near observations are told apart by time, then by ``obs_id``. Every
    event row comes out exactly once. ``spread_by`` are columns that tell event rows apart; they are
    only used to split a hot second when the observations are too many to broadcast. Events are joined on
    cells of ``cell_seconds``, a part of a slot; in one cell an event meets at most that many pieces, and a
    smaller one costs more pieces. A Spark job measures the observations while the join is being built.
    """
    if (slot_minutes * 60) % cell_seconds:
        raise ValueError("a slot must be a whole number of cells")
    reach = reach_in_slots(window_minutes, slot_minutes, mode)
    seconds = _one_per_second(observations, obs_ts, obs_id, slot_minutes)
    size = _measure(observations, obs_ts, slot_minutes)
    borders = size["slots"] * (2 * reach + 1) * (slot_minutes * 60 // cell_seconds)
    piece_bytes = 64 + 2 * size["widest"]
    small = (size["rows"] + borders) * piece_bytes <= max_broadcast_bytes
    pieces = neighbour_pieces(seconds, reach, slot_minutes, cell_seconds)

    sec = F.unix_seconds(F.col(event_ts))
    placed = events.withColumns(
        {"__sec": sec, "__cell": F.floor(sec / cell_seconds).cast("bigint")}
    )
    inside = (F.col("l.__sec") >= F.col("r.__from")) & (F.col("l.__sec") < F.col("r.__to"))
    joined = lookup_join(placed, pieces, ["__cell"], spread_by, inside, small)

    back = F.col("__sec") - F.col("__previous.sec")
    ahead = F.col("__following.sec") - F.col("__sec")
    if mode == "exact":
        limit = F.lit(window_minutes * 60)
        back, ahead = F.when(back <= limit, back), F.when(ahead <= limit, ahead)
    take_previous = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    picked = F.when(take_previous, F.col("__previous.obs")).when(
        ahead.isNotNull(), F.col("__following.obs")
    )
    return (
        joined.withColumn("__picked", picked)
        .select(*events.columns, "__picked.*")
    )


_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def band_join(
    events: DataFrame,
    observations: DataFrame,
    event_ts: str,
    obs_ts: str,
    measures: Mapping[str, tuple[str, str]],
    spread_by: Sequence[str],
    window_minutes: int = 60,
    slot_minutes: int = 30,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Left band join on slots, collapsed to one row per event.

    ``measures`` maps an output name to ``(count|sum|min|max, observation column)``. All events of a
    slot see the same observations, so the aggregates are taken per slot, added up over the
    neighbouring slots, and looked up: the pairs of the join are never formed.
    """
    reach = reach_in_slots(window_minutes, slot_minutes, "slot")
    per_slot = (
        observations.where(F.col(obs_ts).isNotNull())
        .groupBy(slot_number(F.col(obs_ts), slot_minutes).alias("slot"))
        .agg(*[getattr(F, fn)(column).alias(name) for name, (fn, column) in measures.items()])
    )
    bands = (
        per_slot.withColumn("__slot", F.explode(F.sequence(F.col("slot") - reach, F.col("slot") + reach)))
        .groupBy("__slot")
        .agg(*[_MERGE[fn](name).alias(name) for name, (fn, _) in measures.items()])
    )
    placed = events.withColumn("__slot", slot_number(F.col(event_ts), slot_minutes))
    small = fits(bands, max_broadcast_bytes)
    joined = lookup_join(placed, bands, ["__slot"], spread_by, None, small)
    counts = {
        name: F.coalesce(F.col(name), F.lit(0)) for name, (fn, _) in measures.items() if fn == "count"
    }
    return joined.withColumns(counts).drop("__slot") if counts else joined.drop("__slot")
