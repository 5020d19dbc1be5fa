"""All registered queries, in one place."""

from __future__ import annotations

from . import case_queries, entity_queries, graph_queries, job_queries, utxo_queries  # noqa: F401
from .registry import CHECKS, QUERIES, runnable


def queries():
    return {name: runnable(fn) for name, fn in QUERIES.items()}


def checks() -> dict[str, str]:
    return dict(CHECKS)
