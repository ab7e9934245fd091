"""Measured broadcasts, and left joins that survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

_FIXED_WIDTH = 8


def field_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.lit(_FIXED_WIDTH) + F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.lit(_FIXED_WIDTH) + F.coalesce(F.octet_length(F.to_json(column)), F.lit(0))
    return F.lit(_FIXED_WIDTH)


def measured_bytes(df: DataFrame) -> int:
    """Approximate in-memory size, computed by one aggregate job over the whole frame."""
    row = sum((field_bytes(f) for f in df.schema.fields), F.lit(_FIXED_WIDTH))
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0)).alias("bytes")).first()["bytes"]


def fits(df: DataFrame, limit_bytes: int) -> bool:
    return measured_bytes(df) <= limit_bytes


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    residual: Column | None = None,
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """Left join for a right side too large to broadcast.

    Keys with more than ``rows_per_task`` left rows are split over ``ceil(rows / rows_per_task)``
    salts, chosen by a hash of ``spread_by`` (columns that tell the left rows apart), and the right
    rows of just those keys are repeated per salt. There are at most ``rows / rows_per_task`` such
    keys, which is what bounds the two broadcasts below. Left rows with a null in the key match
    nothing and are spread freely.
    """
    hot = (
        left.groupBy(*on)
        .agg(F.count("*").alias("__n"))
        .where(F.col("__n") > rows_per_task)
        .select(*on, F.ceil(F.col("__n") / rows_per_task).cast("bigint").alias("__splits"))
    )
    matchless = reduce(or_, [F.col(k).isNull() for k in on])
    number = F.xxhash64(*spread_by)
    spread = F.when(matchless, number).otherwise(
        F.pmod(number, F.coalesce(F.col("__splits"), F.lit(1)))
    )
    salted = left.join(F.broadcast(hot), list(on), "left").withColumn("__salt", spread)
    last_salt = F.coalesce(F.col("__splits"), F.lit(1)) - F.lit(1).cast("bigint")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), last_salt))
    repeated = (
        right.join(F.broadcast(hot), list(on), "left")
        .withColumn("__salt", copies)
        .drop("__splits")
    )
    keys = [*on, "__salt"]
    condition = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    if residual is not None:
        condition.append(residual)
    added = [F.col(f"r.`{c}`") for c in right.columns if c not in on]
    return (
        salted.drop("__splits")
        .alias("l")
        .join(repeated.alias("r"), condition, "left")
        .select(*[F.col(f"l.`{c}`") for c in left.columns], *added)
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    residual: Column | None,
    small: bool,
) -> DataFrame:
    """Left join that leaves ``left`` where it is if ``right`` was measured to be ``small``, and goes
    through :func:`salted_left_join` if not."""
    if not small:
        return salted_left_join(left, right, on, spread_by, residual)
    condition = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in on]
    if residual is not None:
        condition.append(residual)
    added = [F.col(f"r.`{c}`") for c in right.columns if c not in on]
    return (
        left.alias("l")
        .join(F.broadcast(right).alias("r"), condition, "left")
        .select(*[F.col(f"l.`{c}`") for c in left.columns], *added)
    )
