"""Queries over the given tables, one per operator, each with its SQL where SQL can express it."""

from __future__ import annotations

from areapulse.catalog.registry import QUERIES, SQL


def load() -> None:
    """Import every module that registers queries."""
    from areapulse.catalog import forecasts, indicators, ingest, pages, panels, scores, streams, texts  # noqa: F401


__all__ = ["QUERIES", "SQL", "load"]
