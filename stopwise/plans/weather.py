"""Flattened weather documents to typed observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stopwise.functions import hash_key, locale_bigint, locale_double, locale_int, naive_to_instant, utc_text
from stopwise.operators import normalize_headers, optional_column
from stopwise.schemas import METEOROLOGY_CURRENT, WEATHER_FIELDS

_KEY = ("location_name", "location_region", "location_country", "localtime_epoch", "obs_ts", "run_ts_utc")
_NUMBERS = {"double": locale_double, "int": locale_int, "bigint": locale_bigint}


def _typed(text: Column, name: str, kind: str, source_tz: str | None) -> Column:
    if kind == "timestamp":
        return naive_to_instant(text, source_tz if name == "obs_ts" else None)
    return _NUMBERS[kind](text) if kind in _NUMBERS else text


def _fields(df: DataFrame, source_tz: str | None) -> dict[str, tuple[Column, Column]]:
    """Output name -> (raw text, typed value); a header the input lacks is null."""
    pairs = {}
    for name, (header, kind) in WEATHER_FIELDS.items():
        text = optional_column(df, header, "string")
        pairs[name] = (text, _typed(text, name, kind, source_tz))
    return pairs


def parse_weather(raw: DataFrame, source_tz: str | None = None) -> DataFrame:
    """The 49 columns of an observation. ``source_tz`` is the zone of the observation's wall clock."""
    df = normalize_headers(raw, "hyphen")
    typed = df.select(*[value.alias(name) for name, (_, value) in _fields(df, source_tz).items()])
    return typed.withColumns(
        {"id": hash_key([utc_text(typed[c]) if METEOROLOGY_CURRENT[c] == "timestamp" else F.col(c) for c in _KEY]), "ingest_ts": F.current_timestamp()}
    ).select(*METEOROLOGY_CURRENT)


def weather_quality(raw: DataFrame) -> DataFrame:
    """Rows, and per column the cells that hold text no value could be read from (one row)."""
    df = normalize_headers(raw, "hyphen")
    lost = {
        name: F.count_if((F.trim(text) != "") & value.isNull())
        for name, (text, value) in _fields(df, None).items()
    }
    return df.agg(F.count("*").alias("rows"), *[n.alias(f"{name}_bad") for name, n in lost.items()])
