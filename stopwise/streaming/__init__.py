"""Structured Streaming jobs: live weather messages, and landing files to bronze."""

from stopwise.streaming.landing import decoded_path, route, stream_files, write_bronze
from stopwise.streaming.live import (
    live_rows,
    observations_from_live,
    parse_messages,
    stream_messages,
    write_live,
)

__all__ = [
    "decoded_path",
    "live_rows",
    "observations_from_live",
    "parse_messages",
    "route",
    "stream_files",
    "stream_messages",
    "write_bronze",
    "write_live",
]
