"""Enriched arrivals and the hourly roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stopwise.config import GoldConfig
from stopwise.functions import (
    adverse,
    attributed,
    day_type,
    delay_ratio,
    delayed,
    event_hour,
    local_minute,
    severity,
)
from stopwise.operators import headway_by_window, headway_lookup, latest_per_key, nearest_join
from stopwise.schemas import ARRIVALS_PREDICTIONS, ARRIVALS_WEATHER, DELAY_WEATHER_HOURLY, NEARBY_WEATHER

_FACT = [c for c in ARRIVALS_WEATHER if c in ARRIVALS_PREDICTIONS]


def enrich(
    arrivals: DataFrame,
    timetable: DataFrame,
    weather: DataFrame,
    config: GoldConfig = GoldConfig(),
    unique_ids: bool = False,
) -> DataFrame:
    """One row per arrival id with its expected headway, nearest weather, and flags.

    ``unique_ids`` states that ``arrivals`` hold each id once, as a table filled by ``upsert`` does;
    the arrivals are then not shuffled at all while timetable and weather stay broadcastable.
    ``weather_matched`` tells mild weather from no observation in reach.
    """
    facts = arrivals.select(*_FACT)
    if not unique_ids:
        facts = latest_per_key(facts, ["id"], [])
    facts = facts.withColumns(
        {
            "day_type": day_type(F.col("event_ts"), config.tz),
            "event_min": local_minute(F.col("event_ts"), config.tz),
        }
    )
    facts = headway_lookup(
        facts,
        headway_by_window(timetable, config.wrap_midnight),
        minute="event_min",
        spread_by=["id"],
        max_broadcast_bytes=config.max_broadcast_bytes,
    )
    facts = nearest_join(
        facts,
        weather.select(F.col("id").alias("obs_id"), *NEARBY_WEATHER),
        event_ts="event_ts",
        obs_ts="obs_ts",
        obs_id="obs_id",
        spread_by=["id"],
        window_minutes=config.weather_window_minutes,
        slot_minutes=config.slot_minutes,
        mode=config.window_mode,
        max_broadcast_bytes=config.max_broadcast_bytes,
    )
    return facts.transform(flag_delays, config).select(*ARRIVALS_WEATHER)


def flag_delays(facts: DataFrame, config: GoldConfig = GoldConfig()) -> DataFrame:
    """Delay and severity columns from ``estimate_arrive_sec``, headway and weather measures."""
    eta, headway = F.col("estimate_arrive_sec"), F.col("expected_headway_min")
    return (
        facts.withColumns(
            {
                "delay_ratio": delay_ratio(eta, headway),
                "delayed": delayed(eta, headway, config.delay_ratio_threshold),
                "weather_severity": severity(F.col("precip_mm"), F.col("wind_kph"), F.col("vis_km")),
                "weather_matched": F.col("obs_ts").isNotNull(),
            }
        )
        .withColumn("weather_adverse", adverse(F.col("weather_severity")))
        .withColumns(
            {
                "delay_weather_attributed": attributed(F.col("delayed"), F.col("weather_adverse")),
                "build_ts": F.current_timestamp(),
            }
        )
    )


def rollup_measures() -> list[Column]:
    """Counts, rates and weather means of enriched arrivals."""
    flags = {
        ("delayed_preds", "delay_rate"): "delayed",
        ("adverse_preds", "adverse_rate"): "weather_adverse",
        ("weather_attrib_delays", "weather_attrib_rate"): "delay_weather_attributed",
    }
    total = F.count("*")
    measures = [total.alias("total_preds")]
    for (count_name, rate_name), flag in flags.items():
        hits = F.count_if(F.col(flag))
        measures += [hits.alias(count_name), F.try_divide(hits, total).alias(rate_name)]
    return measures + [F.avg(c).alias(f"avg_{c}") for c in ("temp_c", "wind_kph", "precip_mm")]


def hourly_rollup(enriched: DataFrame, config: GoldConfig = GoldConfig()) -> DataFrame:
    """Counts, rates and weather means per hour and line."""
    return (
        enriched.groupBy(event_hour(F.col("event_ts"), config.bucket_tz).alias("event_hour"), "line")
        .agg(*rollup_measures())
        .withColumn("build_ts", F.current_timestamp())
        .select(*DELAY_WEATHER_HOURLY)
    )
