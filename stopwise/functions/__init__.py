"""Column functions. None of them touches a DataFrame or leaves the JVM."""

from stopwise.functions.clock import (
    day_type,
    event_hour,
    local_minute,
    minute_of_day,
    naive_to_instant,
    time_slot,
    utc_date,
    utc_hour_key,
    utc_text,
)
from stopwise.functions.delay import attributed, delay_ratio, delayed
from stopwise.functions.geo import lat, lon
from stopwise.functions.text import (
    bool_text,
    hash_key,
    json_int,
    locale_bigint,
    locale_double,
    locale_int,
    strict_int,
)
from stopwise.functions.weather import adverse, severity

__all__ = [
    "adverse",
    "attributed",
    "bool_text",
    "day_type",
    "delay_ratio",
    "delayed",
    "event_hour",
    "hash_key",
    "json_int",
    "lat",
    "local_minute",
    "locale_bigint",
    "locale_double",
    "locale_int",
    "lon",
    "minute_of_day",
    "naive_to_instant",
    "severity",
    "strict_int",
    "time_slot",
    "utc_date",
    "utc_hour_key",
    "utc_text",
]
