"""Layouts of the raw cells and of the silver and gold tables.

All names and types in this file are fixed values: the input format and the published tables.
"""

from __future__ import annotations

# ---- JSON held in raw text cells (element types of the arrays). Integers arrive as numbers or as
# quoted text, so they are read as text and converted later.

_GEOMETRY = "struct<type:string, coordinates:array<double>>"

ARRIVE_ITEM = (
    "struct<line:string, stop:string, isHead:string, destination:string, deviation:string, bus:string,"
    f" geometry:{_GEOMETRY}, estimateArrive:string, DistanceBus:string, positionTypeBus:string>"
)
STOP_INFO_ITEM = (
    f"struct<lines:array<string>, stopId:string, stopName:string, geometry:{_GEOMETRY}, Direction:string>"
)
INCIDENT_ITEM = "string"
LINE_STOP_ITEM = (
    f"struct<stop:string, name:string, postalAddress:string, geometry:{_GEOMETRY}, pmv:string,"
    " dataLine:array<string>>"
)
_SERVICE = (
    "struct<StartTime:string, StopTime:string, MinimunFrequency:string, MaximumFrequency:string,"
    " Frequency:string>"
)
TIMETABLE_ITEM = (
    "struct<IdLine:string, Label:string, nameA:string, nameB:string,"
    f" typeOfDays:array<struct<Direction1:{_SERVICE}, Direction2:{_SERVICE}, DayType:string>>>"
)

# ---- Fields of the items: output column -> (path in the item, kind). Kinds are named in plans/fields.py.

ARRIVE_FIELDS = {
    "line": ("line", "text"),
    "stop_id": ("stop", "text"),
    "destination": ("destination", "text"),
    "is_head": ("isHead", "flag"),
    "deviation": ("deviation", "count"),
    "bus": ("bus", "count"),
    "estimate_arrive_sec": ("estimateArrive", "count"),
    "distance_bus_m": ("DistanceBus", "count"),
    "position_type_bus": ("positionTypeBus", "text"),
    "lon": ("geometry.coordinates", "first"),
    "lat": ("geometry.coordinates", "second"),
}
STOP_INFO_FIELDS = {
    "stop_id": ("stopId", "text"),
    "stop_name": ("stopName", "text"),
    "lon": ("geometry.coordinates", "first"),
    "lat": ("geometry.coordinates", "second"),
    "direction": ("Direction", "text"),
    "lines": ("lines", "text"),
}
LINE_STOP_FIELDS = {
    "stop_id": ("stop", "text"),
    "stop_name": ("name", "text"),
    "postal_address": ("postalAddress", "text"),
    "lon": ("geometry.coordinates", "first of two"),
    "lat": ("geometry.coordinates", "second of two"),
    "pmv": ("pmv", "text"),
    "data_lines": ("dataLine", "text"),
}
TIMETABLE_FIELDS = {
    "line": ("IdLine", "text"),
    "label": ("Label", "text"),
    "name_a": ("nameA", "text"),
    "name_b": ("nameB", "text"),
}
DAY_FIELDS = {
    "day_type": ("DayType", "text"),
    **{
        f"d{n}_{name}": (f"Direction{n}.{field}", kind)
        for n in (1, 2)
        for name, field, kind in (
            ("start_time", "StartTime", "text"),
            ("stop_time", "StopTime", "text"),
            ("min_freq", "MinimunFrequency", "whole"),
            ("max_freq", "MaximumFrequency", "whole"),
            ("freq", "Frequency", "whole"),
        )
    },
}

# ---- Silver

ARRIVALS_PREDICTIONS = {
    "id": "string",
    "event_ts": "timestamp",
    "line": "string",
    "stop_id": "string",
    "destination": "string",
    "is_head": "boolean",
    "deviation": "int",
    "bus": "int",
    "estimate_arrive_sec": "int",
    "distance_bus_m": "int",
    "position_type_bus": "string",
    "lon": "double",
    "lat": "double",
    "ingest_ts": "timestamp",
}
STOPS = {
    "stop_id": "string",
    "stop_name": "string",
    "lon": "double",
    "lat": "double",
    "direction": "string",
    "lines": "array<string>",
    "updated_ts": "timestamp",
}

# Weather observation: output column -> (raw header after normalisation, kind).
WEATHER_FIELDS = {
    "run_ts_utc": ("run_ts_utc", "timestamp"),
    "obs_ts": ("current_last_updated", "timestamp"),
    "location_name": ("location_name", "string"),
    "location_region": ("location_region", "string"),
    "location_country": ("location_country", "string"),
    "lat": ("location_lat", "double"),
    "lon": ("location_lon", "double"),
    "tz_id": ("location_tz_id", "string"),
    "localtime_epoch": ("location_localtime_epoch", "bigint"),
    "localtime": ("location_localtime", "timestamp"),
    "temp_c": ("current_temp_c", "double"),
    "temp_f": ("current_temp_f", "double"),
    "is_day": ("current_is_day", "int"),
    "condition_text": ("current_condition_text", "string"),
    "condition_icon": ("current_condition_icon", "string"),
    "condition_code": ("current_condition_code", "int"),
    "wind_mph": ("current_wind_mph", "double"),
    "wind_kph": ("current_wind_kph", "double"),
    "wind_degree": ("current_wind_degree", "int"),
    "wind_dir": ("current_wind_dir", "string"),
    "pressure_mb": ("current_pressure_mb", "double"),
    "pressure_in": ("current_pressure_in", "double"),
    "precip_mm": ("current_precip_mm", "double"),
    "precip_in": ("current_precip_in", "double"),
    "humidity": ("current_humidity", "int"),
    "cloud": ("current_cloud", "int"),
    "feelslike_c": ("current_feelslike_c", "double"),
    "feelslike_f": ("current_feelslike_f", "double"),
    "windchill_c": ("current_windchill_c", "double"),
    "windchill_f": ("current_windchill_f", "double"),
    "heatindex_c": ("current_heatindex_c", "double"),
    "heatindex_f": ("current_heatindex_f", "double"),
    "dewpoint_c": ("current_dewpoint_c", "double"),
    "dewpoint_f": ("current_dewpoint_f", "double"),
    "vis_km": ("current_vis_km", "double"),
    "vis_miles": ("current_vis_miles", "double"),
    "uv": ("current_uv", "double"),
    "gust_mph": ("current_gust_mph", "double"),
    "gust_kph": ("current_gust_kph", "double"),
    "air_co": ("current_air_quality_co", "double"),
    "air_no2": ("current_air_quality_no2", "double"),
    "air_o3": ("current_air_quality_o3", "double"),
    "air_so2": ("current_air_quality_so2", "double"),
    "air_pm2_5": ("current_air_quality_pm2_5", "double"),
    "air_pm10": ("current_air_quality_pm10", "double"),
    "air_us_epa_index": ("current_air_quality_us_epa_index", "int"),
    "air_gb_defra_index": ("current_air_quality_gb_defra_index", "int"),
}
METEOROLOGY_CURRENT = {
    "id": "string",
    **{name: kind for name, (_, kind) in WEATHER_FIELDS.items()},
    "ingest_ts": "timestamp",
}

# Live weather message: source key -> (output column, type). Objects stay JSON text.
LIVE_FIELDS = {
    "last_updated_epoch": ("ts_epoch", "bigint"),
    "last_updated": ("timestamp", "timestamp"),
    "temp_c": ("temperature_celsius", "double"),
    "temp_f": ("temperature_fahrenheit", "double"),
    "is_day": ("day_flag", "int"),
    "condition": ("weather_condition", "string"),
    "wind_mph": ("wind_mph", "double"),
    "wind_kph": ("wind_kph", "double"),
    "wind_degree": ("wind_degree", "int"),
    "wind_dir": ("wind_direction", "string"),
    "pressure_mb": ("pressure_mbar", "double"),
    "pressure_in": ("pressure_inhg", "double"),
    "precip_mm": ("precip_mm", "double"),
    "precip_in": ("precip_in", "double"),
    "humidity": ("humidity", "int"),
    "cloud": ("cloud_percent", "int"),
    "feelslike_c": ("feelslike_celsius", "double"),
    "feelslike_f": ("feelslike_fahrenheit", "double"),
    "windchill_c": ("windchill_celsius", "double"),
    "windchill_f": ("windchill_fahrenheit", "double"),
    "heatindex_c": ("heatindex_celsius", "double"),
    "heatindex_f": ("heatindex_fahrenheit", "double"),
    "dewpoint_c": ("dewpoint_celsius", "double"),
    "dewpoint_f": ("dewpoint_fahrenheit", "double"),
    "vis_km": ("visibility_km", "double"),
    "vis_miles": ("visibility_miles", "double"),
    "uv": ("uv_index", "double"),
    "gust_mph": ("gust_mph", "double"),
    "gust_kph": ("gust_kph", "double"),
    "air_quality": ("air_quality", "string"),
}

# ---- Gold

# Weather columns carried into the enriched fact.
NEARBY_WEATHER = (
    "obs_ts",
    "temp_c",
    "wind_kph",
    "precip_mm",
    "humidity",
    "vis_km",
    "uv",
    "air_pm10",
    "air_pm2_5",
    "condition_text",
)
ARRIVALS_WEATHER = {
    **{
        name: ARRIVALS_PREDICTIONS[name]
        for name in (
            "id",
            "event_ts",
            "line",
            "stop_id",
            "destination",
            "estimate_arrive_sec",
            "distance_bus_m",
            "bus",
        )
    },
    "expected_headway_min": "int",
    "delay_ratio": "double",
    "delayed": "boolean",
    **{name: METEOROLOGY_CURRENT[name] for name in NEARBY_WEATHER},
    "weather_severity": "string",
    "weather_adverse": "boolean",
    "delay_weather_attributed": "boolean",
    "weather_matched": "boolean",
    "build_ts": "timestamp",
}
DELAY_WEATHER_HOURLY = {
    "event_hour": "timestamp",
    "line": "string",
    "total_preds": "bigint",
    "delayed_preds": "bigint",
    "delay_rate": "double",
    "adverse_preds": "bigint",
    "adverse_rate": "double",
    "weather_attrib_delays": "bigint",
    "weather_attrib_rate": "double",
    "avg_temp_c": "double",
    "avg_wind_kph": "double",
    "avg_precip_mm": "double",
    "build_ts": "timestamp",
}
