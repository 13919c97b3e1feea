"""Named queries in SQL that Spark plans as it stands, over shared relations.

A relation is a named SELECT over the tables; a query names the relations and
tables that it reads, and only those become part of its plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\b[a-z_]+\b", sql))


def expand(sql: str, relations: dict[str, str]) -> str:
    """The query with the relations it needs, in the order they are defined, as common table expressions."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        for name in _names(todo.pop()) & relations.keys() - need:
            need.add(name)
            todo.append(relations[name])
    if not need:
        return sql
    body = ",\n".join(f"{n} AS ({relations[n]})" for n in relations if n in need)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        return f"WITH {own[1] or ''}{body},\n{sql[own.end() :]}"
    return f"WITH {body}\n{sql}"


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    tables = sorted(_names(sql) & set(TABLES))
    # Tables are arguments of the text, so that no view of the session is touched.
    text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(tables or ['-'])})\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables})

    return run
