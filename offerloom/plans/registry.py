"""All registered queries and oracles, collected from the area modules."""

from __future__ import annotations

import importlib

AREAS = ["text_queries", "resolve_queries", "label_queries", "offer_queries", "ingest_queries", "identity_queries", "queue_queries", "analytics_queries"]


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for area in AREAS:
        merged.update(getattr(importlib.import_module(f"offerloom.plans.{area}"), attribute))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
