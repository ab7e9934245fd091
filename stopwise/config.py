"""Names and thresholds of the gold build in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GoldConfig:
    """Parameters of the enrichment and of the hourly roll-up."""

    tz: str = "Europe/Madrid"
    bucket_tz: str | None = None  # zone of the hour bucket; None is the session zone
    delay_ratio_threshold: float = 1.30
    weather_window_minutes: int = 60
    slot_minutes: int = 30
    window_mode: str = "slot"  # or "exact"
    wrap_midnight: bool = False
    max_broadcast_bytes: int = 64 * 1024 * 1024
