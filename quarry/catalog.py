"""Every registered query of the analytics engine, with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import paths
from .operators import budget, corpus, facts, graphs, integrity, matching, patches, records, retrieval, rules, store, trees
from .plans import design, telemetry
from .plans.relations import RELATIONS
from .plans.sqlkit import expand, spark_query
from .sources import ndjson, scan, sinks
from .streaming import telemetry as streams

SQL = {name: expand(sql, RELATIONS) for part in (telemetry.S, design.S) for name, sql in part.items()}


_PARTS = (facts, rules, graphs, trees, store, matching, budget, integrity, patches, scan, records, retrieval, paths, ndjson, sinks, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a13_health"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: spark_query(sql) for name, sql in SQL.items()}
    for part in _PARTS:
        out |= part.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(SQL)
    for part in _PARTS:
        out |= {name: expand(sql, corpus.FACTS) for name, sql in part.ORACLE.items()}
    return out
