"""The registered queries, grouped by topic."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(queries, oracle SQL) of every topic module."""
    import importlib

    for topic in ("source", "profile", "missing", "feature", "quality", "learning", "log"):
        importlib.import_module(f"tallyglass.plans.{topic}_queries")
    from tallyglass.plans.catalog import ORACLES, QUERIES
    return QUERIES, ORACLES
