"""The registry of queries and of the SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.operators import code, communities, docs, flows, governance, graph, linking, memory, report, resolve, rules, search, states, traverse, vectors
from skein.plans import explore, ingest, overview
from skein.streaming import deadlines, relay

MODULES = (traverse, graph, communities, search, vectors, flows, report, docs, memory, rules, resolve, linking, code, states, governance, overview, explore, ingest, relay, deadlines)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = "a07_degree_hubs"
