"""Streaming queries, run to completion over messages and files that Spark writes from the events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from catalogue.base import EVENTS_SQL, events, new_database, new_folder, query
from catalogue.gold import CONFIG, HOURLY_SQL, arrivals, enriched, nearest_sql, shown_hours, weather, WEATHER_SQL
from stopwise.jobs import fold_live
from stopwise.plans.tables import delay_weather_hourly, live_weather, meteorology_current
from stopwise.streaming import observations_from_live, stream_files, stream_messages, write_bronze, write_live
from stopwise.streaming.live import dead_letter_table
from stopwise.streaming.landing import DOMAINS
from stopwise.streaming.state import deduplicated, nearest_in_streams, roll_up_hours, write_rollup, write_rows

_ONCE = {"availableNow": True}


def _message() -> Column:
    """Bare for clicks, wrapped otherwise; cut short for k < 10, an array for k = 10."""
    block = F.struct(
        F.col("event_id").alias("last_updated_epoch"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("last_updated"),
        F.col("value").alias("temp_c"),
        F.col("k").cast("string").alias("humidity"),
        F.struct(F.col("event_type").alias("text"), F.col("k").alias("code")).alias("condition"),
    )
    bare = F.to_json(block)
    text = F.when(F.col("event_type") == "click", bare).otherwise(F.to_json(F.struct(block.alias("current"))))
    return (
        F.when(F.col("k") < 10, F.concat(F.lit('{"current": {"last_updated_epoch": '), F.col("event_id")))
        .when(F.col("k") == 10, F.concat(F.lit("["), text, F.lit("]")))
        .otherwise(text)
    )


def _run_live(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    database, folder = new_database(spark, "live")
    events(spark, sf_dir).select(_message().alias("value")).write.text(f"{folder}/in")
    good = live_weather(folder, database)
    dead = dead_letter_table(f"{database}.dead", f"{folder}/dead")
    messages = stream_messages(spark, f"{folder}/in")
    write_live(messages, good, dead, f"{folder}/checkpoint", _ONCE).awaitTermination()
    return good.name, dead.name


@query(f"""
    SELECT event_id AS ts_epoch, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS obs_sec,
           round(value, 2) AS temperature_celsius, k AS humidity,
           '{{"text":"' || event_type || '","code":' || k || '}}' AS weather_condition,
           CAST(event_id AS VARCHAR) AS raw_partition_key
    FROM {EVENTS_SQL} e WHERE k > 10
""")
def stream_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = _run_live(spark, sf_dir)
    return spark.table(good).select(
        "ts_epoch",
        F.unix_seconds("timestamp").alias("obs_sec"),
        F.round("temperature_celsius", 2).alias("temperature_celsius"),
        "humidity",
        "weather_condition",
        "raw_partition_key",
    )


@query(f"""
    SELECT reason, count(*) AS messages, sum(length)::BIGINT AS characters FROM (
        SELECT CASE WHEN k < 10 THEN 'invalid json' ELSE 'not an object' END AS reason,
               CASE WHEN k < 10 THEN 35 + length(CAST(event_id AS VARCHAR))
                    ELSE length('[{{"last_updated_epoch":,"last_updated":"2024-01-01 00:00","temp_c":,')
                         + length('"humidity":"10","condition":{{"text":"","code":10}}}}]')
                         + length(CAST(event_id AS VARCHAR)) + length(CAST(value AS VARCHAR)) + length(event_type)
                         + CASE WHEN event_type <> 'click' THEN length('{{"current":}}') ELSE 0 END END AS length
        FROM {EVENTS_SQL} e WHERE k <= 10) d
    GROUP BY reason
""")
def stream_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dead = _run_live(spark, sf_dir)
    return spark.table(dead).groupBy("reason").agg(
        F.count("*").alias("messages"), F.sum(F.length(F.col("value").cast("string"))).alias("characters")
    )


@query(f"""
    SELECT sha256(concat_ws('||', '', '', '', '', strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S'), '')) AS id,
           CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS obs_sec, round(value, 2) AS temp_c, k AS humidity,
           event_type AS condition_text, k AS condition_code
    FROM {EVENTS_SQL} e WHERE k > 10
""")
def live_as_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = _run_live(spark, sf_dir)
    return observations_from_live(spark.table(good)).select(
        "id",
        F.unix_seconds("obs_ts").alias("obs_sec"),
        F.round("temp_c", 2).alias("temp_c"),
        "humidity",
        "condition_text",
        "condition_code",
    )


@query(f"""
    SELECT count(*) AS rows, count(DISTINCT event_id) AS messages, 2 AS sinks FROM {EVENTS_SQL} e WHERE k > 10
""")
def stream_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries with checkpoints of their own fill one pair of tables; neither loses a row."""
    database, folder = new_database(spark, "two")
    good, dead = live_weather(folder, database), dead_letter_table(f"{database}.dead", f"{folder}/dead")
    for part in (0, 1):
        rows = events(spark, sf_dir).where(F.pmod("event_id", F.lit(2)) == part)
        rows.select(_message().alias("value")).write.text(f"{folder}/in{part}")
        messages = stream_messages(spark, f"{folder}/in{part}")
        write_live(messages, good, dead, f"{folder}/checkpoint{part}", _ONCE).awaitTermination()
    return spark.table(good.name).agg(
        F.count("*").alias("rows"),
        F.countDistinct("ts_epoch").alias("messages"),
        F.countDistinct("sink").cast("int").alias("sinks"),
    )


_FOLDERS = {"click": "arrivals/2024", "view": "lines/a b+c", "error": "meteorology", "signup": "unknown"}


def _land(spark: SparkSession, sf_dir: str) -> str:
    folder = new_folder(spark, "landing")
    rows = events(spark, sf_dir)
    for kind, place in _FOLDERS.items():
        chosen = rows.where(F.col("event_type") == kind) if kind != "signup" else rows.where(
            ~F.col("event_type").isin("click", "view", "error")
        )
        text = F.concat_ws(",", "event_id", "event_type")
        chosen.select(text.alias("value")).write.text(f"{folder}/raw/{place}")
    return folder


def _run_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _land(spark, sf_dir)
    files = stream_files(spark, f"{folder}/raw")
    write_bronze(files, f"{folder}/out", f"{folder}/checkpoint", DOMAINS, _ONCE).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


_DOMAIN_SQL = "CASE event_type WHEN 'click' THEN 'arrivals' WHEN 'view' THEN 'lines' WHEN 'error' THEN 'meteorology' END"


@query(f"SELECT {_DOMAIN_SQL} AS domain, count(*) AS lines FROM events GROUP BY 1")
def route_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_bronze(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("lines"))


@query(f"""
    SELECT event_id || ',' || event_type AS value, {_DOMAIN_SQL} AS domain,
           CASE event_type WHEN 'click' THEN 'bronze/arrivals/2024' WHEN 'view' THEN 'bronze/lines/a b+c'
                WHEN 'error' THEN 'bronze/meteorology' ELSE 'bronze/unknown' END AS place
    FROM events
""")
def bronze_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.regexp_extract("bronze_path", "(bronze/.*)/[^/]*$", 1)
    return _run_bronze(spark, sf_dir).select("value", "domain", place.alias("place"))


def _landed(df: DataFrame, folder: str, times: int = 1) -> DataFrame:
    """A stream of files that each hold the events of a quarter of the ids, read one after the other."""
    quarter = F.pmod(F.col("__part"), F.lit(4))
    for part in range(4):
        for _ in range(times):
            df.where(quarter == part).drop("__part").coalesce(1).write.mode("append").parquet(folder)
    spark, schema = df.sparkSession, df.drop("__part").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)


def _in_quarters(df: DataFrame, folder: str) -> list[DataFrame]:
    """The rows of each quarter of the ids in ``__part``, computed once and by many tasks."""
    quarter = F.pmod(F.col("__part"), F.lit(4)).cast("int")
    df.withColumn("__part", quarter).write.partitionBy("__part").parquet(f"{folder}/quarters")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop("__part").schema)
    rows = df.sparkSession.read.schema(f"{schema}, __part int").parquet(f"{folder}/quarters")
    return [rows.where(F.col("__part") == part).drop("__part") for part in range(4)]


def _run_landing(df: DataFrame, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """A stream that gets a quarter of the rows in each micro-batch: a quarter lands, in as many files as it takes,
    and the query is started on it and ends."""
    spark, quarters = df.sparkSession, _in_quarters(df, folder)
    for rows in quarters:
        rows.write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).awaitTermination()


@query(HOURLY_SQL)
def stream_hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour gets rows in each of four micro-batches and is replaced each time."""
    database, folder = new_database(spark, "rolling")
    facts = enriched(spark, sf_dir).withColumn("__part", F.col("id").cast("bigint"))
    hourly = delay_weather_hourly(folder, database)

    def start(stream: DataFrame) -> StreamingQuery:
        return write_rollup(roll_up_hours(stream, "60 days", CONFIG), hourly, f"{folder}/checkpoint", _ONCE)

    _run_landing(facts, folder, start)
    return shown_hours(spark.table(hourly.name))


@query("SELECT event_id, epoch_us(ts) AS ts_us, event_type, round(value, 2) AS value FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file comes three times."""
    folder = new_folder(spark, "repeated")
    rows = events(spark, sf_dir).select("event_id", "ts", "event_type", "value", F.col("event_id").alias("__part"))
    found = deduplicated(_landed(rows, f"{folder}/in", 3), ["event_id"], "ts", "60 days")
    write_rows(found, f"{folder}/out", f"{folder}/checkpoint", _ONCE).awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{folder}/out")
    return out.select("event_id", F.unix_micros("ts").alias("ts_us"), "event_type", F.round("value", 2).alias("value"))


@query(nearest_sql(WEATHER_SQL))
def stream_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals and weather as two streams; a heartbeat on each moves the watermark past the last window."""
    folder = new_folder(spark, "near")
    beat = F.lit("2034-01-01 00:00:00").cast("timestamp")
    sides = {
        "events": arrivals(spark, sf_dir).select("id", "event_ts"),
        "weather": weather(spark, sf_dir).select(
            F.col("id").alias("obs_id"), "obs_ts", F.round("temp_c", 4).alias("temp_c")
        ),
    }
    streams = []
    for name, rows in sides.items():
        beats = rows.limit(1).select(*[
            beat.alias(c) if kind == "timestamp" else F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes
        ])
        rows.unionByName(beats).write.parquet(f"{folder}/{name}")
        streams.append(spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}"))
    found = nearest_in_streams(*streams, "event_ts", "obs_ts", "obs_id", ["id"])
    write_rows(found, f"{folder}/out", f"{folder}/checkpoint", _ONCE).awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{folder}/out")
    return out.where(F.col("id").isNotNull()).select("id", "obs_id", "temp_c")


@query(f"""
    SELECT CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS obs_sec, 0::BIGINT AS live_rows
    FROM {EVENTS_SQL} e WHERE k > 10 GROUP BY 1
""")
def live_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of messages, each folded and dropped; a third fold finds nothing."""
    database, folder = new_database(spark, "fold")
    good, dead = live_weather(folder, database), dead_letter_table(f"{database}.dead", f"{folder}/dead")
    for part in (0, 1):
        rows = events(spark, sf_dir).where(F.pmod("event_id", F.lit(2)) == part)
        rows.select(_message().alias("value")).write.mode("append").text(f"{folder}/in")
        messages = stream_messages(spark, f"{folder}/in")
        write_live(messages, good, dead, f"{folder}/checkpoint", _ONCE).awaitTermination()
        fold_live(spark, folder, database, folder, database)
    fold_live(spark, folder, database, folder, database)
    left = spark.table(good.name).agg(F.count("*").alias("live_rows"))
    observed = spark.table(meteorology_current(folder, database).name)
    return observed.select(F.unix_seconds("obs_ts").alias("obs_sec"), left.scalar().alias("live_rows"))
