"""Document scans that keep what cannot be read: each line is a good row or a quarantined one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_CORRUPT = "__corrupt"
_PLACE = ("__file", "__block", "__at")


def _cells(kind: str, columns: Sequence[str]) -> Column:
    schema = ", ".join(f"`{c}` string" for c in [*columns, _CORRUPT])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    if kind == "json":
        return F.from_json("value", schema, options)
    return F.from_csv("value", schema, {**options, "escape": '"'})


def split_documents(
    spark: SparkSession, path: str, columns: Sequence[str], kind: str = "csv", glob: str = "*"
) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` of the lines of delimited (``csv``) or JSON-lines (``json``) files.

    ``good`` has the named columns as text. ``bad`` has ``file, line, reason, raw``: a line with more or fewer
    cells than columns, or without a JSON object. Lines count from 1 in each file. Blank lines, and lines that
    are the header (delimited files only), are neither. Cells with line breaks are not read: their pieces are bad
    lines. Columns are told, not taken from a header, so a file whose header differs has only lines that count
    as what their number of cells makes them, its header among them.

    Files are split between tasks. A line's number is its place in its block and the lines of the blocks before
    it, which one count per block gives; only bad lines are looked up, so good rows are not shuffled.
    """
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind {kind!r}")
    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    lines = read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),  # rises along a block
    )
    header = F.regexp_replace("value", "^﻿", "")
    parsed = lines.where(F.trim("value") != "").withColumn("__cells", _cells(kind, columns))
    if kind == "csv":
        names = F.from_csv(header, ", ".join(f"`{c}` string" for c in columns), {"escape": '"'})
        is_header = F.lit(True)
        for c in columns:
            is_header &= names[c].eqNullSafe(F.lit(c))
        parsed = parsed.where(~(is_header & F.col(f"__cells.{_CORRUPT}").isNull()))
    broken = F.col("__cells").isNull() | F.col(f"__cells.{_CORRUPT}").isNotNull()
    good = parsed.where(~broken).select(*[F.col(f"__cells.`{c}`").alias(c) for c in columns])
    bad = parsed.where(broken).select("value", *_PLACE)
    return good, _numbered(lines, bad, kind)


def _numbered(lines: DataFrame, bad: DataFrame, kind: str) -> DataFrame:
    blocks = lines.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__lines"))
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("__file", "__block", "__first", F.coalesce(F.sum("__lines").over(before), F.lit(0)).alias("__before"))
    reason = F.lit("number of cells" if kind == "csv" else "no JSON object")
    return bad.join(starts, ["__file", "__block"]).select(
        F.col("__file").alias("file"),
        (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("line"),
        reason.alias("reason"),
        F.col("value").alias("raw"),
    )
