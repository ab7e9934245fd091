"""Point coordinates kept as ``[lon, lat]`` arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _part(point: Column, position: int, whole_only: bool) -> Column:
    value = F.get(point, F.lit(position))
    return F.when(F.size(point) >= 2, value) if whole_only else value


def lon(point: Column, whole_only: bool = True) -> Column:
    """Longitude; with ``whole_only`` null unless both coordinates are there."""
    return _part(point, 0, whole_only)


def lat(point: Column, whole_only: bool = True) -> Column:
    return _part(point, 1, whole_only)
