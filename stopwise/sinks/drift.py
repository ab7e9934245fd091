"""Appends whose column types differ from the stored ones.

A type that holds every value of both becomes the stored type; files written before keep theirs and are read
as the wider one. Where there is no such type the stored one stays, and rows whose values it would change are
refused before anything is written.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ByteType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    NullType,
    ShortType,
)

from stopwise.sinks.table import Table, ensure_table

_WHOLE = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}  # decimal digits
MOST_DIGITS = 38  # of a decimal
_EXACT_IN_DOUBLE = (ByteType, ShortType, IntegerType, FloatType, DoubleType)


class TypeDrift(ValueError):
    """An append would change values, or the type a partition column is derived from."""


def wider(stored: DataType, incoming: DataType) -> DataType | None:
    """The type that holds every value of both and that files of the stored type can be read as; None without one."""
    if stored == incoming or isinstance(incoming, NullType):
        return stored
    a, b = type(stored), type(incoming)
    if a in _WHOLE and b in _WHOLE:
        return max(stored, incoming, key=lambda t: _WHOLE[type(t)])
    if a in _EXACT_IN_DOUBLE and b in _EXACT_IN_DOUBLE:
        return DoubleType()
    if a is DecimalType and (b is DecimalType or b in _WHOLE):
        whole, scale = (_WHOLE[b], 0) if b in _WHOLE else (incoming.precision - incoming.scale, incoming.scale)
        scale = max(stored.scale, scale)
        precision = max(stored.precision - stored.scale, whole) + scale
        return DecimalType(precision, scale) if precision <= MOST_DIGITS else None
    return None


def changed_types(df: DataFrame, table: Table, stored: Iterable) -> tuple[dict[str, str], dict[str, str]]:
    """``(column, wider type)`` of columns to widen, and ``(column, stored type)`` of those whose values decide.

    ``stored`` are the fields of the table; names match in any case.
    """
    incoming = {f.name.lower(): f.dataType for f in df.schema.fields}
    grown, doubtful = {}, {}
    for field in stored:
        if (kind := incoming.get(field.name.lower())) is None or field.name not in table.columns:
            continue
        target = wider(field.dataType, kind)
        if target is None:
            doubtful[field.name] = field.dataType.simpleString()
        elif target != field.dataType:
            grown[field.name] = target.simpleString()
    if fixed := sorted(set(grown) & {p.source for p in table.partitions}):
        raise TypeDrift(f"{table.name}: partitions are derived from {', '.join(fixed)}, whose type would change")
    return grown, doubtful


def reject_losses(df: DataFrame, table: Table, doubtful: dict[str, str]) -> None:
    """An error if a value of these columns is not the same after a cast to the stored type and back."""
    given = {f.name.lower(): f for f in df.schema.fields}
    lost = []
    for name, kind in doubtful.items():
        field = given[name.lower()]
        if isinstance(field.dataType, MapType):
            raise TypeDrift(f"{table.name}: {name} is {kind}, not {field.dataType.simpleString()}")
        value = F.col(f"`{field.name}`")
        back = value.try_cast(kind).try_cast(field.dataType)
        lost.append(F.count_if(~back.eqNullSafe(value)).alias(name))
    try:
        found = df.agg(*lost).first().asDict()
    except AnalysisException as error:
        raise TypeDrift(f"{table.name}: no cast for {', '.join(doubtful)}") from error
    if changed := {n: rows for n, rows in found.items() if rows}:
        told = ", ".join(f"{n} ({rows} rows do not fit {doubtful[n]})" for n, rows in changed.items())
        raise TypeDrift(f"{table.name}: {told}")


def widen(spark: SparkSession, table: Table, grown: dict[str, str]) -> Table:
    """The same folders declared again with wider columns; no file is touched.

    The catalog has no statement for it, so the table is dropped (its files are not the catalog's) and made
    again. A run that dies in between leaves folders that :func:`ensure_table` picks up with the types declared.
    """
    wide = dataclasses.replace(table, columns={**table.columns, **grown})
    spark.sql(f"DROP TABLE {table.name}")
    ensure_table(spark, wide)
    return wide
