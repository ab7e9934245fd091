"""Expected headway: timetable windows, and the lookup of the best one for a minute of the day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stopwise.functions.clock import MINUTES_PER_DAY, minute_of_day
from stopwise.operators.rows import not_null, unpivot_groups
from stopwise.operators.skew import lookup_join, measured_bytes


def headway_by_window(timetable: DataFrame, wrap_midnight: bool = False) -> DataFrame:
    """Best (smallest) frequency per line, day type and service window, over both directions.

    A window that ends before it starts never matches a minute; with ``wrap_midnight`` it is cut
    at midnight instead (both parts on the same day type).
    """
    direction = {
        tag: {
            "start_time": f"{tag.lower()}_start_time",
            "stop_time": f"{tag.lower()}_stop_time",
            "min_freq": f"{tag.lower()}_min_freq",
        }
        for tag in ("D1", "D2")
    }
    windows = (
        unpivot_groups(timetable, ["line", "day_type"], direction, tag="dir")
        .transform(not_null, "start_time", "stop_time")
        .select(
            "line",
            "day_type",
            minute_of_day(F.col("start_time")).alias("start_min"),
            minute_of_day(F.col("stop_time")).alias("stop_min"),
            "min_freq",
        )
    )
    if wrap_midnight:
        whole = F.array(F.struct("start_min", "stop_min"))
        halves = F.array(
            F.struct(F.col("start_min"), F.lit(MINUTES_PER_DAY).alias("stop_min")),
            F.struct(F.lit(0).alias("start_min"), F.col("stop_min")),
        )
        parts = F.when(F.col("stop_min") < F.col("start_min"), halves).otherwise(whole)
        windows = windows.select("line", "day_type", "min_freq", F.inline(parts))
    return windows.groupBy("line", "day_type", "start_min", "stop_min").agg(
        F.min("min_freq").alias("expected_min_freq")
    )


def best_segments(windows: DataFrame) -> DataFrame:
    """Windows cut into segments that do not overlap: ``(line, day_type, from_min, to_min, freq)``.

    Overlaps take the smallest frequency. Grouping is by minute first, so no group exceeds the 1,440
    minutes of a day, and ``n`` windows give fewer than ``2 * n`` segments.
    """
    start = F.greatest(F.col("start_min"), F.lit(0))
    last = F.least(F.col("stop_min"), F.lit(MINUTES_PER_DAY)) - 1
    by_minute = (
        windows.transform(not_null, "start_min", "stop_min", "expected_min_freq")
        .where(last >= start)
        .withColumn("minute", F.explode(F.sequence(start, last)))
        .groupBy("line", "day_type", "minute")
        .agg(F.min("expected_min_freq").alias("freq"))
    )
    # Minutes in a row with one frequency share the difference of minute and rank.
    run = F.row_number().over(Window.partitionBy("line", "day_type", "freq").orderBy("minute"))
    return (
        by_minute.withColumn("run", F.col("minute") - run)
        .groupBy("line", "day_type", "freq", "run")
        .agg(F.min("minute").alias("from_min"), (F.max("minute") + 1).alias("to_min"))
        .drop("run")
    )


def headway_lookup(
    facts: DataFrame,
    windows: DataFrame,
    minute: str,
    spread_by: Sequence[str],
    max_broadcast_bytes: int,
    into: str = "expected_headway_min",
) -> DataFrame:
    """Left lookup of the smallest frequency whose window covers ``minute`` (``start <= m < stop``).

    ``facts`` carry ``line`` and ``day_type``. A hash join on both with the range as residual: since
    segments do not overlap, a row has at most one partner and nothing is to be collapsed afterwards.
    """
    small = 2 * measured_bytes(windows) <= max_broadcast_bytes
    segments = best_segments(windows).withColumnsRenamed({"from_min": "__from", "to_min": "__to", "freq": into})
    inside = (F.col(f"l.{minute}") >= F.col("r.__from")) & (F.col(f"l.{minute}") < F.col("r.__to"))
    joined = lookup_join(facts, segments, ["line", "day_type"], spread_by, inside, small)
    return joined.drop("__from", "__to")
