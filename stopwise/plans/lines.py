"""Line documents to the line master, the stops of each line, and the timetable."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stopwise.operators import latest_per_key, normalize_headers, parse_json_array
from stopwise.plans.fields import declared, each, named
from stopwise.schemas import DAY_FIELDS, LINE_STOP_FIELDS, LINE_STOP_ITEM, TIMETABLE_FIELDS, TIMETABLE_ITEM

_OWN = {"line": "line", "label": "label"}


def parse_lines(raw: DataFrame, repair_literals: bool = True) -> DataFrame:
    """Line, label and the two parsed arrays, with a ``*_bad`` flag beside each."""
    df = normalize_headers(raw, "strict").select("line", "label", "stops", "timetable")
    df = df.withColumn("ingest_ts", F.current_timestamp())
    df = parse_json_array(df, "stops", LINE_STOP_ITEM, "stops_json", repair_literals)
    return parse_json_array(df, "timetable", TIMETABLE_ITEM, "timetable_json", repair_literals)


def _entries(parsed: DataFrame, *more: str) -> DataFrame:
    """One row per timetable entry; the document's own line and label come first."""
    rows = each(parsed, "timetable_json", "entry")
    return rows.select(*named(declared("entry", TIMETABLE_FIELDS, _OWN)), *more, "ingest_ts")


def lines_master(parsed: DataFrame) -> DataFrame:
    """One row per line; of several, the first by label and names."""
    return latest_per_key(_entries(parsed), ["line"], [])


def line_stops(parsed: DataFrame) -> DataFrame:
    """One row per line and stop."""
    rows = each(parsed, "stops_json", "place")
    rows = rows.select(*_OWN, *named(declared("place", LINE_STOP_FIELDS)), "ingest_ts")
    return latest_per_key(rows, ["line", "stop_id"], [])


def timetable(parsed: DataFrame) -> DataFrame:
    """One row per line, day type and pair of first departures."""
    days = each(_entries(parsed, "entry.typeOfDays"), "typeOfDays", "day")
    rows = days.select(*TIMETABLE_FIELDS, *named(declared("day", DAY_FIELDS)), "ingest_ts")
    return latest_per_key(rows, ["line", "day_type", "d1_start_time", "d2_start_time"], [])


def ingest_lines(raw: DataFrame) -> dict[str, DataFrame]:
    parsed = parse_lines(raw)
    return {
        "lines": lines_master(parsed),
        "lines_stops": line_stops(parsed),
        "lines_timetable": timetable(parsed),
    }
