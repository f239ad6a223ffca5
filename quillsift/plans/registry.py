"""The list of queries over the given tables and, where SQL can express one, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.sources.tables import REVIEW_FACTS_SQL, REVIEWS_SQL, SCORED_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

_VIEWS = {
    "reviews": REVIEWS_SQL.format(documents="documents"),
    "scored": SCORED_SQL.format(reviews="reviews"),
    "facts": REVIEW_FACTS_SQL.format(lineitem="lineitem", part="part"),
}


def view(name: str, sql: str) -> None:
    """Name a view that checks may use."""
    _VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Put the views that a check mentions, directly or through another view, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in _VIEWS.items():
            if name in needed or body is text or not _mentions(text, name):
                continue
            visit(body)
            if name not in needed:
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({_VIEWS[name]})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split()
    return name in words


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that must give the same rows."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if check:
            CHECKS[name] = with_views(check)
        return run

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round results whose last digits depend on the order of summation."""
    return df.withColumns({c: F.round(c, places) for c in columns})
