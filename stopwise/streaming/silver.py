"""New landing files straight into the silver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stopwise import jobs
from stopwise.sources.documents import read_document_sets
from stopwise.streaming.landing import route, stream_files

LOADS = {"arrivals": jobs.load_arrivals, "lines": jobs.load_lines, "meteorology": jobs.load_weather}


def write_silver(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    warehouse: str,
    databases: dict[str, str],
    trigger: dict | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Load every file that lands below ``path`` by the job of its domain; ``databases`` by domain.

    A micro-batch holds at most ``max_files`` files, whose names alone come to the driver; their rows are read
    by the job. Loads are upserts or full refreshes, so a batch that is replayed changes nothing. Files of no
    known domain are left to the bronze stream.
    """

    def load(batch: DataFrame, _: int) -> None:
        names = route(batch.select("source_path").distinct()).where("domain IS NOT NULL")
        found: dict[str, list[str]] = {}
        for row in names.collect():
            found.setdefault(row["domain"], []).append(row["source_path"])
        for domain, files in found.items():
            documents = read_document_sets(batch.sparkSession, sorted(files))
            LOADS[domain](batch.sparkSession, documents, warehouse, databases[domain])

    files = stream_files(spark, path, maxFilesPerTrigger=str(max_files))
    return (
        files.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .foreachBatch(load)
        .start()
    )
