"""Layered bus-arrival and weather analytics as plain Spark DataFrame functions.

Everything is a function ``DataFrame -> DataFrame`` or ``Column -> Column``; only ``sinks`` and
``streaming`` write. Use them with ``df.transform``.
"""

from stopwise.config import GoldConfig
from stopwise.session import build_session

__all__ = ["GoldConfig", "build_session"]
