"""Whole jobs as functions from DataFrames to DataFrames, and the tables they fill."""

from stopwise.plans.arrivals import ingest_arrivals, parse_arrivals, predictions, stops
from stopwise.plans.gold import enrich, hourly_rollup
from stopwise.plans.lines import ingest_lines, line_stops, lines_master, parse_lines, timetable
from stopwise.plans.reports import latest_enriched, recent_delay_rates
from stopwise.plans.weather import parse_weather, weather_quality

__all__ = [
    "enrich",
    "hourly_rollup",
    "ingest_arrivals",
    "ingest_lines",
    "latest_enriched",
    "line_stops",
    "lines_master",
    "parse_arrivals",
    "parse_lines",
    "parse_weather",
    "predictions",
    "recent_delay_rates",
    "stops",
    "timetable",
    "weather_quality",
]
