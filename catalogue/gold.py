"""Headway, nearest weather, enrichment, roll-up and reports.

Arrivals are the events that are no errors, observations are the errors, and the timetable comes
from the suppliers: line, day type and two service windows out of their numbers. Measures that are
averaged are binary fractions, so their sums do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalogue.base import EVENTS_SQL, events, new_database, query, table
from stopwise.config import GoldConfig
from stopwise.functions import day_type, local_minute
from stopwise.incremental import refresh_gold
from stopwise.jobs import build_gold
from stopwise.operators import band_join, headway_by_window, headway_lookup, nearest_join
from stopwise.plans import enrich, hourly_rollup, latest_enriched, recent_delay_rates, tables
from stopwise.sinks import upsert
from stopwise.sinks.table import conform

CONFIG = GoldConfig()
AS_OF = "2024-01-20 12:00:00"


def _two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def timetable(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")

    def clock(hour: Column, minute: Column) -> Column:
        return F.concat_ws(":", _two_digits(hour), _two_digits(minute))

    days = F.when(key % 3 == 0, "SA").when(key % 3 == 1, "LA").otherwise("FE")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("L"), key % 50).alias("line"),
        days.alias("day_type"),
        clock(key % 12, key % 60).alias("d1_start_time"),
        clock(key % 12 + 6, key % 45).alias("d1_stop_time"),
        F.when(key % 7 != 0, key % 9).cast("int").alias("d1_min_freq"),
        F.when(key % 5 != 0, clock(key % 8 + 10, key % 50)).alias("d2_start_time"),
        clock(key % 20 + 5, key % 30).alias("d2_stop_time"),
        (key % 13 + 1).cast("int").alias("d2_min_freq"),
    )


WINDOWS_SQL = """
    (SELECT line, day_type, start_min, stop_min, min(freq) AS expected_min_freq FROM (
        SELECT 'L' || s_suppkey % 50 AS line,
               CASE s_suppkey % 3 WHEN 0 THEN 'SA' WHEN 1 THEN 'LA' ELSE 'FE' END AS day_type,
               CAST(s_suppkey % 12 * 60 + s_suppkey % 60 AS INTEGER) AS start_min,
               CAST((s_suppkey % 12 + 6) * 60 + s_suppkey % 45 AS INTEGER) AS stop_min,
               CAST(CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 9 END AS INTEGER) AS freq
        FROM supplier
        UNION ALL
        SELECT 'L' || s_suppkey % 50,
               CASE s_suppkey % 3 WHEN 0 THEN 'SA' WHEN 1 THEN 'LA' ELSE 'FE' END,
               CAST((s_suppkey % 8 + 10) * 60 + s_suppkey % 50 AS INTEGER),
               CAST((s_suppkey % 20 + 5) * 60 + s_suppkey % 30 AS INTEGER),
               CAST(s_suppkey % 13 + 1 AS INTEGER)
        FROM supplier WHERE s_suppkey % 5 <> 0) w
    GROUP BY line, day_type, start_min, stop_min)
"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .where(F.col("event_type") != "error")
        .select(
            F.col("event_id").cast("string").alias("id"),
            F.col("ts").alias("event_ts"),
            F.concat(F.lit("L"), F.col("user_id") % 60).alias("line"),
            F.concat(F.lit("S"), F.col("user_id")).alias("stop_id"),
            F.col("event_type").alias("destination"),
            F.floor(F.col("value") * 20).cast("int").alias("estimate_arrive_sec"),
            (F.col("k") * 10).alias("distance_bus_m"),
            F.col("k").alias("bus"),
        )
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, value = F.col("k"), F.col("value")
    return (
        events(spark, sf_dir)
        .where(F.col("event_type") == "error")
        .select(
            F.concat(F.lit("w"), F.col("event_id")).alias("id"),
            F.col("ts").alias("obs_ts"),
            (F.floor(value) / 8).alias("temp_c"),
            (F.floor(value) / 4).alias("wind_kph"),
            F.when(k >= 10, k * k / 4096).alias("precip_mm"),
            k.alias("humidity"),
            (F.lit(10) - k / 20).alias("vis_km"),
            (k / 10).alias("uv"),
            (value / 2).alias("air_pm10"),
            (value / 3).alias("air_pm2_5"),
            F.concat(F.lit("sky "), k).alias("condition_text"),
        )
    )


_ARRIVALS_SQL = f"""
    (SELECT CAST(event_id AS VARCHAR) AS id, ts AS event_ts, 'L' || user_id % 60 AS line, 'S' || user_id AS stop_id,
            event_type AS destination, CAST(floor(value * 20) AS INTEGER) AS estimate_arrive_sec, k AS bus,
            k * 10 AS distance_bus_m,
            CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS slot,
            ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Madrid' AS local
     FROM {EVENTS_SQL} e WHERE event_type <> 'error')
"""

WEATHER_SQL = f"""
    (SELECT 'w' || event_id AS obs_id, ts AS obs_ts, floor(value) / 8 AS temp_c, floor(value) / 4 AS wind_kph,
            CASE WHEN k >= 10 THEN k * k / 4096.0 END AS precip_mm, 10 - k / 20.0 AS vis_km,
            'sky ' || k AS condition_text, k, k AS humidity, k / 10.0 AS uv, value / 2 AS air_pm10,
            value / 3 AS air_pm2_5,
            CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS slot
     FROM {EVENTS_SQL} e WHERE event_type = 'error')
"""


@query(f"SELECT * FROM {WINDOWS_SQL} w", name="headway_by_window", nullable=("expected_min_freq",))
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headway_by_window(timetable(spark, sf_dir))


_HEADWAY_SQL = f"""
    (SELECT a.id, a.line, a.day_type, a.minute, min(w.expected_min_freq) AS headway
     FROM (SELECT *, CAST(hour(local) * 60 + minute(local) AS INTEGER) AS minute,
                  CASE dayofweek(local) WHEN 0 THEN 'FE' WHEN 6 THEN 'SA' ELSE 'LA' END AS day_type
           FROM {_ARRIVALS_SQL} x) a
     LEFT JOIN {WINDOWS_SQL} w
       ON a.line = w.line AND a.day_type = w.day_type AND a.minute >= w.start_min AND a.minute < w.stop_min
     GROUP BY a.id, a.line, a.day_type, a.minute)
"""


_HEADWAY_ROWS_SQL = f"SELECT id, line, day_type, minute, headway FROM {_HEADWAY_SQL} h"


def _headway(spark: SparkSession, sf_dir: str, max_broadcast_bytes: int) -> DataFrame:
    facts = arrivals(spark, sf_dir).select(
        "id",
        "line",
        day_type(F.col("event_ts"), CONFIG.tz).alias("day_type"),
        local_minute(F.col("event_ts"), CONFIG.tz).alias("minute"),
    )
    found = headway_by_window(timetable(spark, sf_dir))
    return headway_lookup(facts, found, "minute", ["id"], max_broadcast_bytes, into="headway")


@query(_HEADWAY_ROWS_SQL, nullable=("headway",))
def headway_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headway(spark, sf_dir, CONFIG.max_broadcast_bytes)


@query(_HEADWAY_ROWS_SQL, nullable=("headway",))
def headway_without_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headway(spark, sf_dir, 0)


@query(f"""
    SELECT line, day_type, start_min, stop_min, min(expected_min_freq) AS expected_min_freq FROM (
        SELECT line, day_type, start_min, stop_min, expected_min_freq FROM {WINDOWS_SQL} w
        WHERE stop_min >= start_min
        UNION ALL
        SELECT line, day_type, start_min, 1440, expected_min_freq FROM {WINDOWS_SQL} w WHERE stop_min < start_min
        UNION ALL
        SELECT line, day_type, 0, stop_min, expected_min_freq FROM {WINDOWS_SQL} w WHERE stop_min < start_min) u
    GROUP BY line, day_type, start_min, stop_min
""", nullable=("expected_min_freq",))
def headway_over_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headway_by_window(timetable(spark, sf_dir), wrap_midnight=True)


@query(f"""
    SELECT a.id, coalesce(sum(s.n), 0)::BIGINT AS observations, min(s.first_us) AS first_us,
           max(s.last_us) AS last_us, sum(s.total_k)::BIGINT AS total_k
    FROM {_ARRIVALS_SQL} a
    LEFT JOIN (SELECT slot, count(*) AS n, min(epoch_us(obs_ts)) AS first_us,
                      max(epoch_us(obs_ts)) AS last_us, sum(k) AS total_k
               FROM {WEATHER_SQL} o GROUP BY slot) s
      ON s.slot BETWEEN a.slot - 2 AND a.slot + 2
    GROUP BY a.id
""", name="band_join", nullable=("first_us", "last_us", "total_k"))
def weather_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = weather(spark, sf_dir).withColumn("obs_us", F.unix_micros("obs_ts"))
    measures = {
        "observations": ("count", "obs_us"),
        "first_us": ("min", "obs_us"),
        "last_us": ("max", "obs_us"),
        "total_k": ("sum", "humidity"),
    }
    facts = arrivals(spark, sf_dir).select("id", "event_ts")
    return band_join(facts, observations, "event_ts", "obs_ts", measures, ["id"]).drop("event_ts")


def nearest_sql(observations: str, within: str = "o.slot BETWEEN a.slot - 2 AND a.slot + 2") -> str:
    return f"""
        SELECT id, obs_id, round(temp_c, 4) AS temp_c FROM (
            SELECT a.id, o.obs_id, o.temp_c,
                   row_number() OVER (PARTITION BY a.id
                       ORDER BY abs(a.sec - o.sec) NULLS LAST, o.obs_ts, o.obs_id) AS rn
            FROM {_ARRIVALS_SQL} a LEFT JOIN {observations} o ON {within}) j
        WHERE rn = 1
    """


def _nearest(spark: SparkSession, sf_dir: str, observations: DataFrame, **options) -> DataFrame:
    return nearest_join(
        arrivals(spark, sf_dir).select("id", "event_ts"),
        observations.select(F.col("id").alias("obs_id"), "obs_ts", F.round("temp_c", 4).alias("temp_c")),
        "event_ts",
        "obs_ts",
        "obs_id",
        ["id"],
        **options,
    ).select("id", "obs_id", "temp_c")


@query(nearest_sql(WEATHER_SQL))
def nearest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, weather(spark, sf_dir))


@query(nearest_sql(WEATHER_SQL))
def nearest_without_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, weather(spark, sf_dir), max_broadcast_bytes=0)


@query(nearest_sql(f"(SELECT * FROM {WEATHER_SQL} q WHERE k < 20)"))
def nearest_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, weather(spark, sf_dir).where(F.col("humidity") < 20))


@query(nearest_sql(WEATHER_SQL, "abs(a.sec - o.sec) <= 3600"))
def nearest_exact_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, weather(spark, sf_dir), mode="exact")


_ENRICHED_SQL = f"""
    (SELECT *, delayed AND weather_adverse AS delay_weather_attributed FROM (
      SELECT *, weather_severity IN ('bad', 'severe') AS weather_adverse FROM (
        SELECT a.id, a.event_ts, a.line, a.stop_id, a.destination, a.estimate_arrive_sec, a.distance_bus_m, a.bus,
               o.humidity, o.vis_km, o.uv, o.air_pm10, o.air_pm2_5, o.obs_id IS NOT NULL AS weather_matched,
               h.headway AS expected_headway_min,
               CASE WHEN h.headway <> 0 THEN a.estimate_arrive_sec / (h.headway * 60.0) END AS delay_ratio,
               coalesce(a.estimate_arrive_sec > h.headway * 60 * CAST(1.3 AS DOUBLE), false) AS delayed,
               n.obs_id, o.obs_ts, o.temp_c, o.wind_kph, o.precip_mm, o.condition_text,
               CASE WHEN o.precip_mm >= 2 OR o.wind_kph >= 45 OR o.vis_km < 3 THEN 'severe'
                    WHEN o.precip_mm >= 0.5 OR o.wind_kph >= 30 OR o.vis_km < 6 THEN 'bad'
                    WHEN o.precip_mm >= 0.1 OR o.wind_kph >= 20 THEN 'moderate'
                    ELSE 'good' END AS weather_severity
        FROM {_ARRIVALS_SQL} a
        JOIN {_HEADWAY_SQL} h ON h.id = a.id
        JOIN ({nearest_sql(WEATHER_SQL)}) n ON n.id = a.id
        LEFT JOIN {WEATHER_SQL} o ON o.obs_id = n.obs_id) f) g)
"""


_PLAIN = (
    "id", "line", "stop_id", "destination", "estimate_arrive_sec", "distance_bus_m", "bus", "expected_headway_min",
    "delayed", "humidity", "condition_text", "weather_severity", "weather_adverse", "delay_weather_attributed",
    "weather_matched",
)
_MEASURED = ("delay_ratio", "temp_c", "wind_kph", "precip_mm", "vis_km", "uv", "air_pm10", "air_pm2_5")
_FACT_NULLS = ("expected_headway_min", "obs_us", "humidity")

_FACT_SQL = f"""
    SELECT {", ".join(_PLAIN)}, epoch_us(event_ts) AS event_us, epoch_us(obs_ts) AS obs_us,
           {", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in _MEASURED)}
    FROM {_ENRICHED_SQL} e
"""


def _shown_facts(facts: DataFrame) -> DataFrame:
    """Every column but the time of the build."""
    return facts.select(
        *_PLAIN,
        F.unix_micros("event_ts").alias("event_us"),
        F.unix_micros("obs_ts").alias("obs_us"),
        *[F.round(c, 4).alias(c) for c in _MEASURED],
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(
        arrivals(spark, sf_dir), timetable(spark, sf_dir), weather(spark, sf_dir), CONFIG, unique_ids=True
    )


@query(_FACT_SQL, nullable=_FACT_NULLS)
def enriched_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_facts(enriched(spark, sf_dir))


@query(_FACT_SQL, nullable=_FACT_NULLS)
def gold_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both gold tables are built twice; the second build must change nothing."""
    database, folder = new_database(spark, "gold")
    inputs = [f(spark, sf_dir) for f in (arrivals, timetable, weather)]
    for _ in range(2):
        facts, _ = build_gold(spark, *inputs, folder, database, CONFIG)
    return _shown_facts(spark.table(facts.name))


@query(f"{_FACT_SQL} WHERE event_ts >= TIMESTAMP '2024-01-05' AND event_ts < TIMESTAMP '2024-01-09'", nullable=_FACT_NULLS)
def gold_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days built alone are those days of a build of everything."""
    database, folder = new_database(spark, "range")
    inputs = [f(spark, sf_dir) for f in (arrivals, timetable, weather)]
    days = ("2024-01-05 00:00:00", "2024-01-09 00:00:00")
    facts, _ = build_gold(spark, *inputs, folder, database, CONFIG, unique_ids=False, between=days)
    return _shown_facts(spark.table(facts.name))


@query(_FACT_SQL, nullable=_FACT_NULLS)
def gold_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads, the last of observations that come late: what each has changed is built, and it adds up to all."""
    database, folder = new_database(spark, "changed")
    facts, measures, times = arrivals(spark, sf_dir), weather(spark, sf_dir), timetable(spark, sf_dir)
    early, even = F.col("event_ts") < "2024-01-12 00:00:00", F.col("humidity") % 2 == 0
    silver = tables.arrivals_predictions(folder, database), tables.meteorology_current(folder, database)
    for first, second in ((early, even), (~early, F.lit(False)), (F.lit(False), ~even)):
        for target, rows in zip(silver, (facts.where(first), measures.where(second))):
            upsert(spark, target, conform(rows, target), stable_partitions=True)
        refresh_gold(spark, *silver, times, folder, database, CONFIG)
    return _shown_facts(spark.table(tables.arrivals_weather(folder, database).name))


_HOURLY_SQL = f"""
    (SELECT date_trunc('hour', event_ts) AS event_hour, line, count(*) AS total_preds,
            count(*) FILTER (WHERE delayed) AS delayed_preds,
            count(*) FILTER (WHERE delayed) / count(*) AS delay_rate,
            count(*) FILTER (WHERE weather_adverse) AS adverse_preds,
            count(*) FILTER (WHERE weather_adverse) / count(*) AS adverse_rate,
            count(*) FILTER (WHERE delay_weather_attributed) AS weather_attrib_delays,
            count(*) FILTER (WHERE delay_weather_attributed) / count(*) AS weather_attrib_rate,
            avg(temp_c) AS avg_temp_c, avg(wind_kph) AS avg_wind_kph, avg(precip_mm) AS avg_precip_mm
     FROM {_ENRICHED_SQL} e GROUP BY 1, 2)
"""
_ROUNDED = ("delay_rate", "adverse_rate", "weather_attrib_rate", "avg_temp_c", "avg_wind_kph", "avg_precip_mm")
_COUNTS = ("total_preds", "delayed_preds", "adverse_preds", "weather_attrib_delays")


HOURLY_SQL = f"""
    SELECT epoch_us(event_hour) AS hour_us, line, {", ".join(_COUNTS)},
           {", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED)}
    FROM {_HOURLY_SQL} h
"""


@query(HOURLY_SQL, name="hourly_rollup")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_hours(hourly_rollup(enriched(spark, sf_dir), CONFIG))


def shown_hours(hourly: DataFrame) -> DataFrame:
    return hourly.select(
        F.unix_micros("event_hour").alias("hour_us"),
        "line",
        *_COUNTS,
        *[F.round(c, 6).alias(c) for c in _ROUNDED],
    )


_HOURLY_NULL_SQL = _HOURLY_SQL.replace("'L' || user_id % 60 AS line", "CASE WHEN k <> 7 THEN 'L' || user_id % 60 END AS line")


@query(f"""
    SELECT epoch_us(event_hour) AS hour_us, line, {", ".join(_COUNTS)},
           {", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED)}
    FROM {_HOURLY_NULL_SQL} h
""")
def gold_hourly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written roll-up after two builds, with arrivals of no line: a second build adds nothing."""
    database, folder = new_database(spark, "hourly")
    facts = arrivals(spark, sf_dir)
    lost = facts.withColumn("line", F.when(F.col("bus") != 7, F.col("line")))
    for _ in range(2):
        _, hourly = build_gold(spark, lost, timetable(spark, sf_dir), weather(spark, sf_dir), folder, database, CONFIG)
    return shown_hours(spark.table(hourly.name))


@query(f"""
    SELECT epoch_us(event_hour) AS hour_us, line, round(delay_rate, 6) AS delay_rate,
           round(weather_attrib_rate, 6) AS weather_attrib_rate
    FROM {_HOURLY_SQL} h WHERE event_hour >= TIMESTAMP '2024-01-19 00:00:00' ORDER BY event_hour, line
""")
def recent_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_delay_rates(hourly_rollup(enriched(spark, sf_dir), CONFIG), AS_OF).select(
        F.unix_micros("event_hour").alias("hour_us"),
        "line",
        F.round("delay_rate", 6).alias("delay_rate"),
        F.round("weather_attrib_rate", 6).alias("weather_attrib_rate"),
    )


@query(f"""
    SELECT id, epoch_us(event_ts) AS event_us, line, weather_severity, delayed
    FROM {_ENRICHED_SQL} e WHERE CAST(event_ts AS DATE) = DATE '2024-01-20'
""")
def today_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_enriched(enriched(spark, sf_dir), AS_OF).select(
        "id", F.unix_micros("event_ts").alias("event_us"), "line", "weather_severity", "delayed"
    )
