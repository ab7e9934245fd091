"""Columns out of parsed items, by the declarations of :mod:`stopwise.schemas`."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from stopwise.functions import bool_text, json_int, lat, lon, strict_int

KINDS = {
    "text": lambda c: c,
    "flag": bool_text,
    "count": json_int,
    "whole": strict_int,
    "first": lambda c: lon(c, whole_only=False),
    "second": lambda c: lat(c, whole_only=False),
    "first of two": lon,
    "second of two": lat,
}


def each(df: DataFrame, items: Column | str, into: str, keep_empty: bool = True) -> DataFrame:
    """One row per item; with ``keep_empty`` a row without items stays, with a null item."""
    return df.withColumn(into, (F.explode_outer if keep_empty else F.explode)(items))


def declared(item: str, fields: Mapping[str, tuple[str, str]], own: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Output columns of an item. A column in ``own`` is the document's own value where it has one."""
    own = own or {}
    columns = {}
    for name, (path, kind) in fields.items():
        value = KINDS[kind](F.col(f"{item}.{path}"))
        columns[name] = F.coalesce(own[name], value) if name in own else value
    return columns


def named(columns: Mapping[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]
