"""Local days, minutes of the day, slots and hours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Day-type codes of the timetables.
WORKING_DAY = "LA"
SATURDAY = "SA"
HOLIDAY = "FE"

MINUTES_PER_DAY = 24 * 60


def day_type(ts: Column, tz: str) -> Column:
    """Timetable day type of an instant in ``tz``: Monday-Friday, Saturday, or Sunday."""
    weekday = F.dayofweek(F.from_utc_timestamp(ts, tz))  # 1 is Sunday
    return (
        F.when(weekday.between(2, 6), F.lit(WORKING_DAY))
        .when(weekday == 7, F.lit(SATURDAY))
        .otherwise(F.lit(HOLIDAY))
    )


def minute_of_day(text: Column) -> Column:
    """``"HH:MM"`` to minutes since midnight; null when either part is missing or not a number."""
    parts = F.split(text, ":")
    return F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")


def local_minute(ts: Column, tz: str) -> Column:
    """Minute of the day (0-1439) of an instant in ``tz``."""
    local = F.from_utc_timestamp(ts, tz)
    return F.hour(local) * 60 + F.minute(local)


def slot_number(ts: Column, minutes: int) -> Column:
    """Number of the slot an instant falls in, counted from the epoch."""
    return F.floor(F.unix_seconds(ts) / F.lit(minutes * 60)).cast("bigint")


def time_slot(ts: Column, minutes: int = 30) -> Column:
    """Start of the slot. Integer floor on the epoch, so clock changes cannot move it."""
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(minutes * 60)))


def event_hour(ts: Column, bucket_tz: str | None = None) -> Column:
    """Start of the hour, in the session zone or on the wall clock of ``bucket_tz``."""
    if bucket_tz is None:
        return F.date_trunc("hour", ts)
    return F.date_trunc("hour", F.from_utc_timestamp(ts, bucket_tz))


def naive_to_instant(text: Column, source_tz: str | None = None) -> Column:
    """Timestamp text without zone, read on the wall clock of ``source_tz`` or of the session."""
    parsed = text.try_cast("timestamp")
    return parsed if source_tz is None else F.to_utc_timestamp(parsed, source_tz)


def utc_date(ts: Column) -> Column:
    """Date of an instant in UTC, whatever the session zone is."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / F.lit(86_400)).cast("int"))


def utc_hour_key(ts: Column) -> Column:
    """``yyyy-MM-dd-HH`` of an instant in UTC."""
    hour = F.floor(F.pmod(F.unix_seconds(ts), F.lit(86_400)) / 3_600).cast("string")
    return F.concat(utc_date(ts).cast("string"), F.lit("-"), F.lpad(hour, 2, "0"))


def utc_text(ts: Column) -> Column:
    """An instant as text in UTC, as a cast to text gives it there: no zeros at the end of a fraction."""
    second = F.pmod(F.unix_seconds(ts), F.lit(86_400))
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    whole = F.concat(
        utc_date(ts).cast("string"), F.lit(" "), two(second / 3_600), F.lit(":"), two(F.pmod(second, F.lit(3_600)) / 60),
        F.lit(":"), two(F.pmod(second, F.lit(60))),
    )
    fraction = F.rtrim(F.lpad(micros.cast("string"), 6, "0"), F.lit("0"))
    return F.when(micros == 0, whole).otherwise(F.concat(whole, F.lit("."), fraction))
