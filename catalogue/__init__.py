"""Registered queries: each runs library operators over the whole test tables, beside the SQL that
says what must come out."""

from catalogue.base import REGISTRY
from catalogue import columns, frames, gold, jobs, streams, writes  # noqa: F401  (registration)

__all__ = ["REGISTRY"]
