"""Named queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query by its key; ``check`` is SQL over the tables and the shared views."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = with_views(check)
        return fn

    return add


def view(name: str, sql: str, recursive_columns: str | None = None) -> None:
    """A shared view for checks; ``recursive_columns`` names the columns of a recursive one."""
    VIEWS[name] = f"{name}({recursive_columns}) as ({sql})" if recursive_columns else f"{name} as materialized ({sql})"


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, directly or through others, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not needed:
        return sql
    views = "with recursive " + ",\n".join(VIEWS[n] for n in VIEWS if n in needed)
    body = sql.strip()
    return f"{views},\n{body[5:]}" if body.startswith("with ") else f"{views}\n{body}"


def runnable(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))
