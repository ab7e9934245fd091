"""Text to typed values, and surrogate keys.

Every conversion yields null for text it cannot read, with or without ANSI mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

KEY_SEPARATOR = "||"


def _with_point(text: Column) -> Column:
    return F.translate(text, ",", ".")


def locale_double(text: Column) -> Column:
    """``"40,4"`` and ``"1,76E+09"`` to double. A thousands point (``"1.234,5"``) gives null."""
    return _with_point(text).try_cast("double")


def locale_int(text: Column) -> Column:
    """As :func:`locale_double`, then truncated to int; out of range gives null."""
    return locale_double(text).try_cast("int")


def locale_bigint(text: Column) -> Column:
    """As :func:`locale_double`, then truncated to bigint."""
    return locale_double(text).try_cast("bigint")


def strict_int(text: Column) -> Column:
    """Digits only, else null: ``"07"`` is 7, ``"7.5"`` and ``""`` are null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def json_int(text: Column) -> Column:
    """Integer from a JSON scalar kept as text, quoted or not; signs allowed, fractions are null."""
    # A point makes every such cast fail, and a failing cast raises and catches an error.
    return F.when(~text.contains("."), text.try_cast("int"))


def bool_text(text: Column) -> Column:
    """True for any casing of ``true``; everything else, null too, is false."""
    return F.coalesce(F.lower(text) == F.lit("true"), F.lit(False))


def hash_key(columns: Sequence[Column], null_safe: bool = True) -> Column:
    """SHA-256 over the columns as text. Give instants as ``utc_text``, which no session zone changes.

    ``null_safe`` keeps a null as an empty part, so ``(a, null, b)`` and ``(a, b, null)`` differ.
    Without it nulls are left out, as plain ``concat_ws`` does.
    """
    parts = [c.cast("string") for c in columns]
    if null_safe:
        parts = [F.coalesce(p, F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(KEY_SEPARATOR, *parts), 256)
