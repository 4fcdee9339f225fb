"""Registered queries: the library run over the given tables.

Each entry pairs a Spark query with SQL that answers the same question over
the same tables in another engine.  ``REGISTRY`` maps name -> (query, sql).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def load_all() -> dict[str, tuple[Query, str | None]]:
    from pressgraph.registry import (  # noqa: F401
        crawl, forms, graph, media, pages, stored, streams, text, urls,
    )

    return REGISTRY
