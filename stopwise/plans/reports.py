"""Consumer reports on the gold tables. ``as_of`` is a timestamp column or literal text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stopwise.functions import utc_date


def _instant(as_of: Column | str | None) -> Column:
    if as_of is None:
        return F.current_timestamp()
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def _between_days(df: DataFrame, column: str, start: Column, stop: Column | None) -> DataFrame:
    """Rows from ``start`` up to ``stop``; on a gold table its day partition, a UTC date, is bounded too."""
    df = df.where(F.col(column) >= start)
    if stop is not None:
        df = df.where(F.col(column) < stop)
    if "event_date" in df.columns:
        df = df.where(F.col("event_date") >= utc_date(start))
        if stop is not None:
            df = df.where(F.col("event_date") <= utc_date(stop))
    return df


def latest_enriched(enriched: DataFrame, as_of: Column | str | None = None) -> DataFrame:
    """Arrivals of the day of ``as_of``, a day of the session zone."""
    start = F.date_trunc("day", _instant(as_of))
    return _between_days(enriched, "event_ts", start, F.date_trunc("day", start + F.expr("INTERVAL 36 HOURS")))


def recent_delay_rates(hourly: DataFrame, as_of: Column | str | None = None) -> DataFrame:
    """Delay rates per hour and line since the start of the day before ``as_of``, in that order."""
    since = F.date_trunc("day", _instant(as_of) - F.expr("INTERVAL 1 DAY"))
    rows = _between_days(hourly, "event_hour", since, None)
    return rows.select("event_hour", "line", "delay_rate", "weather_attrib_rate").orderBy("event_hour", "line")
