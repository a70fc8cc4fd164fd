"""Registered queries over the base tables and what Spark derives from them, with their DuckDB SQL."""

from __future__ import annotations

from . import manifests, metrics, text


def queries() -> dict:
    return metrics.Q | manifests.Q | text.Q


def oracle_sql() -> dict[str, str]:
    return metrics.O | manifests.O | text.O
