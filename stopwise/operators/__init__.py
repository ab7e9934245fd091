"""DataFrame operators: headers, nested documents, rows, lookups and nearest-in-time matching."""

from stopwise.operators.headers import normalize_headers
from stopwise.operators.nearest import band_join, nearest_join
from stopwise.operators.nested import (
    flatten,
    map_fields,
    optional_column,
    parse_json_array,
    quality_counts,
)
from stopwise.operators.headway import headway_by_window, headway_lookup
from stopwise.operators.rows import latest_per_key, not_null, union_with_missing, unpivot_groups
from stopwise.operators.skew import salted_left_join

__all__ = [
    "band_join",
    "flatten",
    "headway_by_window",
    "headway_lookup",
    "latest_per_key",
    "map_fields",
    "nearest_join",
    "normalize_headers",
    "not_null",
    "optional_column",
    "parse_json_array",
    "quality_counts",
    "salted_left_join",
    "union_with_missing",
    "unpivot_groups",
]
