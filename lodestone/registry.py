"""The queries of the library, outside its training-data subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import answering, backends, catalog, chunking, code, covers, crawl, dialogue, display, flows, html, lexical_index, ranking, refresh, retrieval, schemas, sinks, stored_index, structure, urls
from .plans import ingest, layers
from .streaming import layered, limits

MODULES = [answering, backends, catalog, chunking, code, covers, crawl, dialogue, display, flows, html, ingest, layered, layers, lexical_index, limits, ranking, refresh, retrieval, schemas, sinks, stored_index, structure, urls]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
