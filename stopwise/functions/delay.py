"""Delay measures against the expected headway."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def delay_ratio(eta_sec: Column, headway_min: Column) -> Column:
    """Waiting time over headway; null without a headway and for a headway of zero."""
    return F.try_divide(eta_sec.cast("double"), headway_min * F.lit(60.0))


def delayed(eta_sec: Column, headway_min: Column, threshold: float) -> Column:
    """Strictly more than ``threshold`` headways away; false where either side is unknown."""
    return F.coalesce(eta_sec > headway_min * 60 * F.lit(float(threshold)), F.lit(False))


def attributed(is_delayed: Column, is_adverse: Column) -> Column:
    """Delay under adverse weather."""
    return F.coalesce(is_delayed & is_adverse, F.lit(False))
