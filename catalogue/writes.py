"""Table writes: each query fills a table of its own below shared scratch storage and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.base import events, new_database, query, scratch, table
from stopwise.jobs import documents_or_quarantine
from stopwise.plans.tables import quarantined_documents
from stopwise.sinks import (
    Partition,
    Table,
    append,
    compact,
    day_partition,
    ensure_table,
    full_refresh,
    hour_partition,
    overwrite_partitions,
    prefix_partition,
    upsert,
    with_partitions,
)
from stopwise.sinks.table import scan

_EVENT_COLUMNS = {"event_id": "bigint", "ts": "timestamp", "event_type": "string", "value": "double"}


def _events_table(spark: SparkSession, label: str, *extra_partitions) -> Table:
    database, folder = new_database(spark, label)
    parts = (day_partition("ts"), *extra_partitions)
    return Table(f"{database}.events", f"{folder}/events", _EVENT_COLUMNS, ("event_id",), parts)


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", F.unix_micros("ts").alias("ts_us"), "event_type", F.round("value", 2).alias("value")
    )


_SHOWN_SQL = "SELECT event_id, epoch_us(ts) AS ts_us, event_type, round(value, 2) AS value FROM events"


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS total FROM orders WHERE o_orderstatus <> 'P'",
       name="full_refresh")
def refreshed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, folder = new_database(spark, "refresh")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("total")
    )
    full_refresh(spark, f"{database}.orders", f"{folder}/orders", orders.drop("total"))
    full_refresh(
        spark, f"{database}.orders", f"{folder}/orders", orders.where(F.col("o_orderstatus") != "P")
    )
    return spark.table(f"{database}.orders")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS total, CAST(NULL AS VARCHAR) AS note FROM orders",
       name="ensure_table")
def ensured_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, folder = new_database(spark, "ensure")
    columns = {"o_orderkey": "bigint", "total": "double", "note": "string"}
    target = Table(f"{database}.orders", f"{folder}/orders", columns)
    ensure_table(spark, target)
    append(spark, target, table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("total")))
    ensure_table(spark, target)  # must not touch what is there
    return spark.table(target.name)


@query("""
    SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, strftime(ts, '%Y-%m-%d-%H') AS hour_key,
           substring(event_type, 1, 2) AS kind FROM events
""")
def partition_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [day_partition("ts"), hour_partition("ts", "hour_key"), prefix_partition("event_type", 2, "kind")]
    return with_partitions(events(spark, sf_dir), parts).select(
        "event_id", F.col("event_date").cast("string").alias("event_date"), "hour_key", "kind"
    )


@query(f"{_SHOWN_SQL} WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _events_table(spark, "pruned", prefix_partition("event_type", 2, "kind"))
    overwrite_partitions(spark, target, events(spark, sf_dir))
    return _shown(scan(spark, target, between=("ts", "2024-01-10 06:00:00", "2024-01-12 18:00:00")))


@query(f"{_SHOWN_SQL} WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'")
def pruned_scan_other_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in one session zone, written again and scanned in another; keys, partitions and bounds are instants."""
    target = _events_table(spark, "zones")
    rows = scratch(events(spark, sf_dir).select(*_EVENT_COLUMNS))
    first, last = (F.lit(f"2024-01-{d}Z").cast("timestamp") for d in ("10 06:00:00", "12 18:00:00"))
    try:
        for zone in ("Europe/Madrid", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            upsert(spark, target, rows, stable_partitions=True)
        return scratch(_shown(scan(spark, target, between=("ts", first, last))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@query("""
    SELECT event_id, epoch_us(ts) AS ts_us, event_type,
           round(CASE WHEN event_type = 'click' THEN -value ELSE value END, 2) AS value
    FROM events
""")
def upsert_many_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of partitions are touched, one for each day and remainder of the id."""
    by_id = Partition("part", "bigint", "event_id", lambda c: F.pmod(c, F.lit(71)), monotone=False)
    target = _events_table(spark, "many", by_id)
    rows = events(spark, sf_dir).select(*_EVENT_COLUMNS)
    overwrite_partitions(spark, target, rows)
    changed = rows.where(F.col("event_type") == "click").withColumn("value", -F.col("value"))
    upsert(spark, target, changed)
    return _shown(spark.table(target.name))


@query("""
    SELECT event_id, epoch_us(ts) AS ts_us, event_type,
           round(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN -value ELSE value END, 2) AS value
    FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' OR event_type <> 'click'
""")
def dynamic_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _events_table(spark, "dynamic")
    rows = events(spark, sf_dir)
    overwrite_partitions(spark, target, rows)
    later = rows.where((F.col("ts") >= "2024-01-15 00:00:00") & (F.col("event_type") != "click"))
    overwrite_partitions(spark, target, later.withColumn("value", -F.col("value")))
    return _shown(spark.table(target.name))


@query(_SHOWN_SQL, name="compact_table")
def compacted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _events_table(spark, "compact")
    rows = events(spark, sf_dir)
    for kind in ("event_type = 'click'", "event_type = 'view'", "event_type NOT IN ('click', 'view')"):
        append(spark, target, rows.where(kind).select(*_EVENT_COLUMNS))
    compact(spark, target)
    return _shown(spark.table(target.name))


@query("""
    SELECT c_custkey AS key, c_name AS name, CAST(NULL AS VARCHAR) AS segment, CAST(NULL AS DOUBLE) AS balance
    FROM customer
    UNION ALL
    SELECT c_custkey, CAST(NULL AS VARCHAR), c_mktsegment, round(c_acctbal, 2) FROM customer
    UNION ALL
    SELECT c_custkey + 1000000000, c_name, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE) FROM customer
""")
def append_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, folder = new_database(spark, "drift")
    customer = table(spark, sf_dir, "customer")
    target = Table(f"{database}.customers", f"{folder}/customers", {"key": "bigint", "name": "string"})
    target = append(spark, target, customer.selectExpr("c_custkey AS key", "c_name AS name"))
    wider = customer.selectExpr("c_mktsegment AS segment", "c_custkey AS key", "round(c_acctbal, 2) AS balance")
    target = append(spark, target, wider)
    append(spark, target, customer.selectExpr("c_custkey + 1000000000 AS KEY", "c_name AS Name"))  # another case
    return spark.table(target.name)


@query("""
    SELECT event_id, epoch_us(ts) + CASE WHEN event_type = 'error' THEN 86400000000 ELSE 0 END AS ts_us, event_type,
           round(CASE WHEN event_type = 'error' THEN -value ELSE value END, 2) AS value
    FROM events
    UNION ALL
    SELECT event_id + 1000000000, epoch_us(ts), event_type, round(value, 2) FROM events WHERE event_type = 'click'
""")
def upsert_single_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors move to the next day under the same key, clicks come in again under new keys."""
    target = _events_table(spark, "upsert")
    rows = events(spark, sf_dir).select(*_EVENT_COLUMNS)
    overwrite_partitions(spark, target, rows)
    moved = rows.where(F.col("event_type") == "error").withColumns(
        {"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "value": -F.col("value")}
    )
    added = rows.where(F.col("event_type") == "click").withColumn("event_id", F.col("event_id") + 1_000_000_000)
    upsert(spark, target, moved.unionByName(added))
    return _shown(spark.table(target.name))


@query("""
    SELECT event_id, epoch_us(ts) + CASE WHEN event_id % 50 = 0 THEN 259200000000 ELSE 0 END AS ts_us, event_type,
           round(CASE WHEN event_id % 50 = 0 THEN value + 1 ELSE value END, 2) AS value
    FROM events
    UNION ALL
    SELECT event_id - 1000000000, epoch_us(ts), event_type, round(value, 2) FROM events WHERE event_id % 50 = 1
""")
def upsert_moving_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that come back three days later leave the partitions they were in, which the source does not name.

    The scan for them gets the keys as a pushed list, against statistics and Bloom filters of the row groups.
    """
    target = _events_table(spark, "moving")
    rows = events(spark, sf_dir).select(*_EVENT_COLUMNS)
    overwrite_partitions(spark, target, rows)
    later = rows.where("event_id % 50 = 0").withColumns(
        {"ts": F.col("ts") + F.expr("INTERVAL 3 DAY"), "value": F.col("value") + 1}
    )
    fresh = rows.where("event_id % 50 = 1").withColumn("event_id", F.col("event_id") - 1_000_000_000)
    upsert(spark, target, later.unionByName(fresh))
    return _shown(spark.table(target.name))


@query("""
    SELECT epoch_us(event_hour) AS hour_us, line,
           CASE WHEN line IN ('click', 'error') THEN 10 * n ELSE n END AS n
    FROM (SELECT date_trunc('hour', ts) AS event_hour, event_type AS line, count(*) AS n FROM events GROUP BY 1, 2) h
    UNION ALL
    SELECT epoch_us(date_trunc('hour', ts)), 'any', count(*) FROM events GROUP BY 1
""")
def upsert_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, folder = new_database(spark, "upsert2")
    columns = {"event_hour": "timestamp", "line": "string", "n": "bigint"}
    target = Table(
        f"{database}.hourly", f"{folder}/hourly", columns, ("event_hour", "line"), (day_partition("event_hour"),)
    )
    rows = events(spark, sf_dir).withColumn("event_hour", F.date_trunc("hour", "ts"))
    hourly = rows.groupBy("event_hour", F.col("event_type").alias("line")).agg(F.count("*").alias("n"))
    overwrite_partitions(spark, target, hourly)
    changed = hourly.where(F.col("line").isin("click", "error")).withColumn("n", F.col("n") * 10)
    every = rows.groupBy("event_hour").agg(F.count("*").alias("n")).withColumn("line", F.lit("any"))
    upsert(spark, target, changed.unionByName(every), stable_partitions=True)
    return spark.table(target.name).select(F.unix_micros("event_hour").alias("hour_us"), "line", "n")


@query("""
    SELECT CAST(o_orderkey AS BIGINT) AS key, CAST(round(o_totalprice) AS DOUBLE) AS price,
           CAST(o_orderkey % 7 AS DOUBLE) AS rate, o_orderstatus AS status
    FROM orders
    UNION ALL
    SELECT o_orderkey + 3000000000, round(o_totalprice, 2) + 0.5, o_orderkey % 11 + 0.125::DOUBLE, 'x'
    FROM orders
    UNION ALL
    SELECT -o_orderkey - 1, o_orderkey % 100, o_orderkey % 5, NULL FROM orders
""")
def append_widened_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys outgrow int, prices become fractions, rates get more digits; the last load has the narrow types again."""
    database, folder = new_database(spark, "widened")
    orders = table(spark, sf_dir, "orders")
    columns = {"key": "int", "price": "int", "rate": "decimal(7,1)", "status": "string"}
    target = Table(f"{database}.orders", f"{folder}/orders", columns)
    for load in (
        ("CAST(o_orderkey AS int) AS key", "CAST(round(o_totalprice) AS int) AS price",
         "CAST(o_orderkey % 7 AS decimal(7,1)) AS rate", "o_orderstatus AS status"),
        ("o_orderkey + 3000000000 AS key", "round(o_totalprice, 2) + 0.5D AS price",
         "CAST(o_orderkey % 11 + 0.125 AS decimal(12,3)) AS rate", "'x' AS status"),
        ("CAST(-o_orderkey - 1 AS int) AS key", "CAST(o_orderkey % 100 AS smallint) AS price",
         "CAST(o_orderkey % 5 AS decimal(7,1)) AS rate", "NULL AS status"),
    ):
        append(spark, target, orders.selectExpr(*load))
    compact(spark, target)
    return spark.table(target.name).withColumn("rate", F.col("rate").cast("double"))


@query(_SHOWN_SQL)
def compact_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each day in the order of kind and time, cut into files by ranges."""
    target = _events_table(spark, "clustered")
    rows = events(spark, sf_dir)
    for kind in ("event_type = 'click'", "event_type = 'view'", "event_type NOT IN ('click', 'view')"):
        append(spark, target, rows.where(kind).select(*_EVENT_COLUMNS))
    compact(spark, target, cluster_by=["event_type", "ts"])
    return _shown(spark.table(target.name))


_LINE_SQL = """
    (SELECT *, 1 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line,
            c_custkey || ',"' || replace(c_name, '#', '""') || CASE
                WHEN c_custkey % 7 = 0 THEN '"' WHEN c_custkey % 11 = 0 THEN '",a,b'
                ELSE '",' || c_mktsegment END AS raw,
            c_custkey % 7 = 0 OR c_custkey % 11 = 0 AS bad
     FROM customer)
"""


@query(f"""
    SELECT CAST(c_custkey AS VARCHAR) AS key, replace(c_name, '#', '"') AS name, c_mktsegment AS segment,
           CAST(NULL AS DOUBLE) AS line, CAST(NULL AS VARCHAR) AS raw, CAST(NULL AS VARCHAR) AS folder
    FROM {_LINE_SQL} l WHERE NOT bad
    UNION ALL
    SELECT NULL, NULL, NULL, CAST(line AS DOUBLE), raw, 'nation=' || c_nationkey FROM {_LINE_SQL} l WHERE bad
""")
def document_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per nation with lines of too few and too many cells, read twice: no bad line is kept twice."""
    database, folder = new_database(spark, "quarantine")
    key = F.col("c_custkey")
    tail = F.when(key % 7 == 0, '"').when(key % 11 == 0, '",a,b').otherwise(F.concat(F.lit('",'), "c_mktsegment"))
    text = F.concat(key.cast("string"), F.lit(',"'), F.regexp_replace("c_name", "#", '""'), tail)
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation")
    heads = customers.select("nation", F.lit(-1).cast("bigint").alias("at"), F.lit("key,name,segment").alias("value")).distinct()
    lines = heads.unionByName(customers.select("nation", key.cast("bigint").alias("at"), text.alias("value")))
    lines = lines.repartition("nation").sortWithinPartitions("nation", "at")
    lines.select("nation", "value").write.partitionBy("nation").text(f"{folder}/documents")
    for _ in range(2):
        good = documents_or_quarantine(spark, f"{folder}/documents", ["key", "name", "segment"], folder, database)
    bad = spark.table(quarantined_documents(folder, database).name)
    bad = bad.select(F.col("line").cast("double").alias("line"), "raw", "folder")
    return good.unionByName(bad, allowMissingColumns=True)
