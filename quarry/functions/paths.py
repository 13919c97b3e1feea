"""Predicates over relative paths: pruned directories and glob patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression for whole strings; a star also crosses separators, an unclosed bracket stands for itself."""
    out, i = "", 0
    while i < len(glob):
        c, end = glob[i], -1
        if c == "[":
            end = glob.find("]", i + (3 if glob[i + 1 : i + 2] == "!" else 2))
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[{'^' + inside[1:] if inside[0] == '!' else inside}]"
            i = end
        else:
            out += re.sub(r"[^\w/ ]", lambda m: "\\" + m[0], c)
        i += 1
    return f"(?s)^{out}$"


def glob_column(globs: Column) -> Column:
    """Each glob of a column as a regular expression, by the rule of ``glob_pattern``; null stays null."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda g: None if g is None else glob_pattern(g))

    return run(globs)


def excluded(path: Column, directories: Iterable[str] = (), globs: Iterable[str] = ()) -> Column:
    """Whether a component of the path is one of the directories, or the lower-cased path fits a glob; a null path is not excluded."""
    tests = [F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in directories]))] if directories else []
    tests += [F.lower(path).rlike(glob_pattern(g)) for g in globs]
    hit = F.lit(False)
    for t in tests:
        hit = hit | F.coalesce(t, F.lit(False))
    return hit


def _kept(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    where = F.when(k % 5 == 0, "build").when(k % 7 == 0, "RTL/sub").otherwise("rtl")
    name = F.when(k % 3 == 0, "_tb.sv").otherwise(".sv")
    paths = spark.read.parquet(f"{d}/part.parquet").select(F.concat(where, F.lit("/M"), k.cast("string"), name).alias("path"))
    return paths.where(~excluded(F.col("path"), ["build", ".git"], ["*_tb.sv", "rtl/sub/m1?.sv"]))


QUERIES = {"s02_path_exclusion": _kept}
ORACLE = {
    "s02_path_exclusion": """WITH f AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'build' WHEN p_partkey % 7 = 0 THEN 'RTL/sub' ELSE 'rtl' END || '/M' || p_partkey::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN '_tb.sv' ELSE '.sv' END AS path FROM part)
SELECT path FROM f WHERE NOT path LIKE 'build/%' AND NOT lower(path) GLOB '*_tb.sv' AND NOT lower(path) GLOB 'rtl/sub/m1?.sv'"""
}
