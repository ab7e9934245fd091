"""Headers, nested documents, unions, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.base import EVENTS_SQL, events, query, table
from stopwise.operators import (
    flatten,
    latest_per_key,
    map_fields,
    normalize_headers,
    optional_column,
    union_with_missing,
    unpivot_groups,
)

_PART_SQL = "SELECT p_partkey AS part_key, p_name AS part_name, p_size AS size_in_cm, p_retailprice AS price FROM part"


def _messy(spark: SparkSession, sf_dir: str, *headers: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").toDF(*headers)


@query(_PART_SQL)
def normalize_headers_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_headers(_messy(spark, sf_dir, " Part.Key", "PART NAME", "size in.cm ", "Price"), "basic")


@query(_PART_SQL)
def normalize_headers_hyphen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_headers(_messy(spark, sf_dir, "Part-Key", "part.name", "Size-in cm", " price "), "hyphen")


@query(_PART_SQL)
def normalize_headers_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_headers(_messy(spark, sf_dir, "Part--Key", "Part%Name", "size (in.cm", "PRICE"), "strict")


@query("""
    SELECT c_custkey AS key, c_name AS profile_name, c_mktsegment AS profile_segment,
           c_nationkey AS profile_home_nation, round(c_acctbal, 2) AS balance
    FROM customer
""")
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = F.struct(F.col("c_nationkey").alias("nation"))
    profile = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), home.alias("home"))
    nested = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), profile.alias("profile"), F.round("c_acctbal", 2).alias("balance")
    )
    return flatten(nested, "_")


@query("SELECT p_partkey AS id, p_name AS title, p_brand AS maker, p_size AS size_cm FROM part")
def rename_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"p_partkey": "id", "p_name": "title", "p_colour": "colour", "p_brand": "maker", "p_size": "size_cm"}
    message = table(spark, sf_dir, "part").select(F.struct("*").alias("current"))
    return map_fields(message, names, block="current")


@query("""
    SELECT c_custkey, CAST(NULL AS VARCHAR) AS phone, c_mktsegment AS segment FROM customer
""", name="optional_column")
def optional_column_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return df.select(
        "c_custkey",
        optional_column(df, "c_phone", "string").alias("phone"),
        optional_column(df, "c_mktsegment", "string").alias("segment"),
    )


@query("""
    SELECT s_suppkey, 'D1' AS dir, s_nationkey AS place, round(s_acctbal, 2) AS amount FROM supplier
    UNION ALL
    SELECT s_suppkey, 'D2', 24 - s_nationkey, round(-s_acctbal, 2) FROM supplier
""")
def unpivot_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.col("s_nationkey").alias("d1_place"),
        F.round("s_acctbal", 2).alias("d1_amount"),
        (24 - F.col("s_nationkey")).alias("d2_place"),
        F.round(-F.col("s_acctbal"), 2).alias("d2_amount"),
    )
    groups = {tag: {c: f"{tag.lower()}_{c}" for c in ("place", "amount")} for tag in ("D1", "D2")}
    return unpivot_groups(wide, ["s_suppkey"], groups, tag="dir")


@query("""
    SELECT c_custkey AS key, c_name AS name, CAST(NULL AS VARCHAR) AS segment, c_nationkey AS nation FROM customer
    UNION ALL
    SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR), s_nationkey FROM supplier
    UNION ALL
    SELECT c_custkey, CAST(NULL AS VARCHAR), c_mktsegment, CAST(NULL AS INTEGER) FROM customer
""", nullable=("nation",))
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return union_with_missing(
        customer.selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nation"),
        supplier.selectExpr("s_nationkey AS nation", "s_suppkey AS key", "s_name AS name"),
        customer.selectExpr("c_custkey AS key", "c_mktsegment AS segment"),
    )


@query(f"""
    SELECT event_type, k, event_id, round(value, 2) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type, k ORDER BY event_id) AS rn
        FROM {EVENTS_SQL} e) r
    WHERE rn = 1
""")
def dedupe_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", "k", "event_id", F.round("value", 2).alias("value"))
    return latest_per_key(rows, ["event_type", "k"], [])


@query("""
    SELECT user_id, event_id, event_type, epoch_us(ts) AS ts_us, round(value, 2) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS rn FROM events) r
    WHERE rn = 1
""", name="latest_per_key")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        "user_id", "event_id", "event_type", "ts", F.round("value", 2).alias("value")
    )
    latest = latest_per_key(rows, ["user_id"], [F.col("ts").desc_nulls_last()])
    return latest.withColumn("ts_us", F.unix_micros("ts")).drop("ts")
