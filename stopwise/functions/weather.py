"""Weather severity classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Class -> lower bounds of rain (mm) and wind (km/h), upper bound of visibility (km).
SEVERITY_BOUNDS = {
    "severe": {"precip_mm": 2.0, "wind_kph": 45.0, "vis_km": 3.0},
    "bad": {"precip_mm": 0.5, "wind_kph": 30.0, "vis_km": 6.0},
    "moderate": {"precip_mm": 0.1, "wind_kph": 20.0},
}
MILDEST = "good"
ADVERSE = ("bad", "severe")


def severity(precip_mm: Column, wind_kph: Column, vis_km: Column) -> Column:
    """First class any measure reaches, worst first; no measure at all is the mildest class."""
    ladder = None
    for name, bounds in SEVERITY_BOUNDS.items():
        reached = (precip_mm >= bounds["precip_mm"]) | (wind_kph >= bounds["wind_kph"])
        if "vis_km" in bounds:
            reached = reached | (vis_km < bounds["vis_km"])
        ladder = F.when(reached, name) if ladder is None else ladder.when(reached, name)
    return ladder.otherwise(MILDEST)


def adverse(severity_class: Column) -> Column:
    return severity_class.isin(*ADVERSE)
