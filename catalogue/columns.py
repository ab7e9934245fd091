"""Scans, filters and column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.base import EVENTS_SQL, events, new_folder, query, table
from stopwise import functions as fn
from stopwise.operators import not_null
from stopwise.sources import read_documents

MADRID = "Europe/Madrid"


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice >= 100000
""")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 100000))
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )


@query("""
    SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, nullif(o_orderstatus, 'P') AS status
    FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NOT NULL AND nullif(o_orderstatus, 'P') IS NOT NULL
""")
def not_null_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
    )
    return not_null(rows, "priority", "status")


@query("""
    SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal,
           c_mktsegment || ', "' || c_nationkey || '"' AS note
    FROM customer
""")
def all_string_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat("c_mktsegment", F.lit(', "'), "c_nationkey", F.lit('"'))
    path = new_folder(spark, "documents")
    rows = table(spark, sf_dir, "customer").withColumn("note", note)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return read_documents(spark, path).select(
        F.col("c_custkey").try_cast("bigint").alias("c_custkey"),
        "c_name",
        fn.strict_int(F.col("c_nationkey")).alias("c_nationkey"),
        F.round(fn.locale_double(F.col("c_acctbal")), 2).alias("c_acctbal"),
        "note",
    )


@query(f"""
    SELECT event_id,
           CASE user_id % 4 WHEN 0 THEN round(value, 2) WHEN 3 THEN 1500.0 END AS as_double,
           CAST(CASE user_id % 4 WHEN 0 THEN trunc(round(value, 2)) WHEN 3 THEN 1500 END AS INTEGER) AS as_int,
           CAST(CASE user_id % 4 WHEN 0 THEN trunc(round(value, 2)) WHEN 3 THEN 1500 END AS BIGINT) AS as_bigint
    FROM {EVENTS_SQL} e
""", nullable=("as_int", "as_bigint"))
def locale_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("value").cast("string")
    text = (
        F.when(F.col("user_id") % 4 == 0, F.translate(number, ".", ","))
        .when(F.col("user_id") % 4 == 1, F.concat(F.lit("1."), F.translate(number, ".", ",")))
        .when(F.col("user_id") % 4 == 2, F.lit(""))
        .otherwise(F.lit("1,5E+03"))
    )
    return events(spark, sf_dir).select(
        "event_id",
        F.round(fn.locale_double(text), 2).alias("as_double"),
        fn.locale_int(text).alias("as_int"),
        fn.locale_bigint(text).alias("as_bigint"),
    )


@query(f"""
    SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN k END AS number
    FROM {EVENTS_SQL} e
""", nullable=("number",))
def strict_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k").cast("string")
    text = (
        F.when(kind == "click", k)
        .when(kind == "view", F.concat(F.lit("0"), k))
        .when(kind == "error", F.concat(k, F.lit(".5")))
        .when(kind == "signup", F.lit(""))
    )
    return events(spark, sf_dir).select("event_id", fn.strict_int(text).alias("number"))


@query("SELECT event_id, event_type IN ('click', 'view') AS flag FROM events")
def bool_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", "True").when(kind == "view", "true").when(kind == "error", "yes").when(kind == "signup", "")
    )
    return events(spark, sf_dir).select("event_id", fn.bool_text(text).alias("flag"))


@query(f"""
    SELECT event_id,
           sha256(concat_ws('||', CAST(event_id AS VARCHAR),
                  coalesce(CAST(CASE WHEN event_type <> 'click' THEN user_id END AS VARCHAR), ''),
                  CAST(k AS VARCHAR))) AS safe_key,
           sha256(concat_ws('||', CAST(event_id AS VARCHAR),
                  CAST(CASE WHEN event_type <> 'click' THEN user_id END AS VARCHAR),
                  CAST(k AS VARCHAR))) AS plain_key
    FROM {EVENTS_SQL} e
""")
def hash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        F.col("event_id"),
        F.when(F.col("event_type") != "click", F.col("user_id")),
        F.col("k"),
    ]
    return events(spark, sf_dir).select(
        "event_id",
        fn.hash_key(parts).alias("safe_key"),
        fn.hash_key(parts, null_safe=False).alias("plain_key"),
    )


@query("""
    SELECT event_id,
           CASE dayofweek(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Madrid')
                WHEN 0 THEN 'FE' WHEN 6 THEN 'SA' ELSE 'LA' END AS day_type
    FROM events
""")
def day_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", fn.day_type(F.col("ts"), MADRID).alias("day_type"))


@query("""
    SELECT event_id, CAST(hour(l) * 60 + minute(l) AS INTEGER) AS local_minute,
           CAST(CASE WHEN event_type NOT IN ('error', 'signup') THEN hour(ts) * 60 + minute(ts) END AS INTEGER)
               AS text_minute
    FROM (SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Madrid' AS l FROM events) e
""", nullable=("text_minute",))
def minute_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("event_type") == "error", F.date_format("ts", "HH"))
        .when(F.col("event_type") == "signup", F.lit("late:00"))
        .otherwise(F.date_format("ts", "HH:mm"))
    )
    return events(spark, sf_dir).select(
        "event_id",
        fn.local_minute(F.col("ts"), MADRID).alias("local_minute"),
        fn.minute_of_day(text).alias("text_minute"),
    )


@query("""
    SELECT event_id,
           CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT) AS half_hour,
           CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS five_minutes
    FROM events
""")
def time_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id",
        F.unix_seconds(fn.time_slot(F.col("ts"))).alias("half_hour"),
        F.unix_seconds(fn.time_slot(F.col("ts"), 5)).alias("five_minutes"),
    )


_MEASURES_SQL = f"""
    (SELECT event_id, CASE WHEN k >= 10 THEN k / 40.0 END AS precip_mm, value AS wind_kph,
            CASE WHEN k < 90 THEN 10 - k / 12.0 END AS vis_km FROM {EVENTS_SQL} e)
"""


@query(f"""
    SELECT event_id, severity, severity IN ('bad', 'severe') AS is_adverse FROM (
        SELECT event_id,
               CASE WHEN precip_mm >= 2 OR wind_kph >= 45 OR vis_km < 3 THEN 'severe'
                    WHEN precip_mm >= 0.5 OR wind_kph >= 30 OR vis_km < 6 THEN 'bad'
                    WHEN precip_mm >= 0.1 OR wind_kph >= 20 THEN 'moderate'
                    ELSE 'good' END AS severity
        FROM {_MEASURES_SQL} m) s
""")
def severity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    severity = fn.severity(
        F.when(k >= 10, k / 40), F.col("value"), F.when(k < 90, F.lit(10) - k / 12)
    )
    return (
        events(spark, sf_dir)
        .select("event_id", severity.alias("severity"))
        .withColumn("is_adverse", fn.adverse(F.col("severity")))
    )


@query(f"""
    SELECT event_id, round(CASE WHEN headway > 0 THEN eta / (headway * 60.0) END, 6) AS ratio,
           coalesce(eta > headway * 60 * CAST(1.3 AS DOUBLE), false) AS is_delayed,
           coalesce(eta > headway * 60 * CAST(1.3 AS DOUBLE), false) AND k >= 50 AS is_attributed
    FROM (SELECT event_id, k, CAST(floor(value * 10) AS INTEGER) AS eta,
                 CASE WHEN k >= 5 THEN k % 12 END AS headway FROM {EVENTS_SQL} e) f
""")
def delay_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = events(spark, sf_dir).select(
        "event_id",
        "k",
        F.floor(F.col("value") * 10).cast("int").alias("eta"),
        F.when(F.col("k") >= 5, F.col("k") % 12).alias("headway"),
    )
    late = fn.delayed(F.col("eta"), F.col("headway"), 1.30)
    return facts.select(
        "event_id",
        F.round(fn.delay_ratio(F.col("eta"), F.col("headway")), 6).alias("ratio"),
        late.alias("is_delayed"),
        fn.attributed(late, F.col("k") >= 50).alias("is_attributed"),
    )
