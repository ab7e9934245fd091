"""Row-level reshaping: wide to long, unions, one row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where every given column has a value."""
    return df.dropna(subset=list(columns))


def unpivot_groups(
    df: DataFrame,
    keep: Sequence[str],
    groups: Mapping[str, Mapping[str, str]],
    tag: str,
) -> DataFrame:
    """Column groups to rows in one scan.

    ``groups`` maps a tag value to ``{output column: input column}``; all groups name the same
    output columns. Each input row gives one row per group.
    """
    rows = F.array(
        *[
            F.struct(F.lit(value).alias(tag), *[F.col(src).alias(out) for out, src in cols.items()])
            for value, cols in groups.items()
        ]
    )
    return df.select(*keep, F.inline(rows))


def union_with_missing(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _sortable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _sortable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_sortable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], tie_break: bool = True
) -> DataFrame:
    """First row of each key in ``order``; ties fall to the remaining columns, so a rerun agrees.

    The rank filter is applied before the shuffle as well as after it, so each task sends at most
    one row per key and a key holding most of the input costs no more than any other.
    """
    ties = []
    if tie_break:
        ties = [
            F.col(f"`{f.name}`").asc_nulls_last()
            for f in df.schema.fields
            if f.name not in keys and _sortable(f.dataType)
        ]
    window = Window.partitionBy(*keys).orderBy(*order, *ties)
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")
