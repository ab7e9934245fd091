"""Registration, and the inputs shared by the queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stopwise.session import scratch_dir


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


REGISTRY: dict[str, Query] = {}


def query(sql: str, name: str | None = None, nullable: Sequence[str] = ()) -> Callable:
    """Register the function under ``name`` or its own name.

    ``nullable`` names integer columns that hold nulls. Data-frame libraries disagree on the type of
    those, so both sides hand them out as doubles.
    """
    if nullable:
        casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in nullable)
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql}) q"

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # as the SQL side reads times
            df = run(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("double") for c in nullable}) if nullable else df

        registered.__module__ = run.__module__
        REGISTRY[name or run.__name__] = Query(registered, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant as time, and ``k`` out of the properties."""
    return table(spark, sf_dir, "events").withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "k": F.get_json_object("props", "$.k").cast("int"),
        }
    )


EVENTS_SQL = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def new_folder(spark: SparkSession, label: str) -> str:
    return scratch_dir(spark, label)


def new_database(spark: SparkSession, label: str) -> tuple[str, str]:
    """``(database, folder)`` that no other call uses."""
    folder = scratch_dir(spark, label)
    return folder.rsplit("/", 1)[1].replace("-", "_"), folder


def scratch(df: DataFrame) -> DataFrame:
    """Written and read back, so that nothing of it is computed later, under other settings."""
    path = scratch_dir(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
