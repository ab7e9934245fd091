"""Landing files: incremental discovery, routing by path, append to bronze."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

# Landing and bronze folder names, and the folder of each domain.
RAW, BRONZE = "raw", "bronze"
DOMAINS = {"arrivals": "arrivals/", "lines": "lines/", "meteorology": "meteorology/"}


def decoded_path(path: Column) -> Column:
    """Percent escapes undone; a plus sign is a plus sign."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def route(df: DataFrame, path: str = "source_path", domains: Mapping[str, str] = DOMAINS) -> DataFrame:
    """Adds ``domain``: the one whose folder the path lies in, null for none."""
    domain = F.lit(None).cast("string")
    for name, folder in reversed(domains.items()):
        domain = F.when(F.col(path).contains(f"/{folder}"), name).otherwise(domain)
    return df.withColumn("domain", domain)


def stream_files(spark: SparkSession, path: str, source_format: str = "text", **options: str) -> DataFrame:
    """New files below ``path``, each read once; the checkpoint of the query remembers which.

    ``text`` gives a row per line, ``binaryFile`` a row per file with its ``content``.
    """
    reader = spark.readStream.format(source_format).option("recursiveFileLookup", "true").options(**options)
    body = "content" if source_format == "binaryFile" else "value"
    if source_format == "binaryFile":
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    source = decoded_path(F.col("_metadata.file_path"))
    return reader.load(path).select(
        body,
        source.alias("source_path"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
    )


def write_bronze(
    stream: DataFrame,
    location: str,
    checkpoint: str,
    domains: Mapping[str, str] = DOMAINS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append to bronze, partitioned by domain; the landing file stays and its path is kept.

    Files of no known domain go to the null partition rather than being dropped. The file sink
    commits each batch once, whatever fails in between.
    """
    bronze_path = F.replace(F.col("source_path"), F.lit(f"/{RAW}/"), F.lit(f"/{BRONZE}/"))
    rows = stream.transform(route, "source_path", domains).withColumns(
        {"bronze_path": bronze_path, "ingest_ts": F.current_timestamp()}
    )
    return (
        rows.writeStream.format("parquet")
        .partitionBy("domain")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start(location)
    )
