"""Document scans. Every column is text; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from stopwise.operators.rows import union_with_missing


def read_documents(spark: SparkSession, path: str, multi_line: bool = False, **options: str) -> DataFrame:
    """Delimited files with a header row. The files below one path share one header.

    ``multi_line`` is for cells that hold line breaks; such files are not split between tasks.
    """
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .options(**options)
        .csv(path)
    )


def read_document_sets(spark: SparkSession, paths: Iterable[str], **options) -> DataFrame:
    """Several folders whose headers may differ; a column a folder lacks is null in its rows."""
    return union_with_missing(*[read_documents(spark, p, **options) for p in paths])


def read_json_documents(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """JSON lines, the named top-level keys as text (objects and arrays keep their JSON text)."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).json(path)
