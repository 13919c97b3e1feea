"""Joins by substring and by glob without comparing all pairs.

A text is listed under its grams of up to three letters, and under the empty one;
what is looked for is listed under one gram that it must bring along: its
beginning, or that of the longest piece of a glob without a wildcard. Rows that
meet by gram are then verified. Only what has no such piece meets every text, as
it may fit every text.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from . import corpus

GRAM = 3


def grams(text: Column) -> Column:
    """All substrings of up to GRAM letters, once each, and the empty one."""
    size = lambda n: lambda i: F.substring(text, i, F.lit(n))
    each = [F.transform(F.sequence(F.lit(1), F.length(text)), size(n)) for n in range(1, GRAM + 1)]
    return F.when(F.length(text) > 0, F.array_distinct(F.concat(F.array(F.lit("")), *each))).otherwise(F.array(F.lit("")))


def contained(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text, needle): distinct pairs in which the needle is a part of the text; nulls match nothing, an empty needle everything."""
    t = texts.select("text").where("text is not null").distinct().withColumn("gram", F.explode(grams(F.col("text"))))
    n = needles.select("needle").where("needle is not null").distinct().withColumn("gram", F.substring("needle", 1, GRAM))
    return t.join(n, "gram").where(F.contains("text", F.col("needle"))).select("text", "needle")


def literal(glob: str) -> str:
    """The longest piece of a glob without wildcards; an unclosed bracket stands for itself."""
    parts, piece, i = [], "", 0
    while i < len(glob):
        c, end = glob[i], -1
        if c == "[":
            end = glob.find("]", i + (3 if glob[i + 1 : i + 2] == "!" else 2))
        if c in "*?" or end > 0:
            parts.append(piece)
            piece, i = "", end if end > 0 else i
        else:
            piece += c
        i += 1
    return max([*parts, piece], key=len)


def fitting(texts: DataFrame, globs: DataFrame) -> DataFrame:
    """(text, glob): distinct pairs in which the whole text fits the glob; nulls fit nothing."""

    @F.pandas_udf("string")
    def piece(batch: pd.Series) -> pd.Series:
        return batch.map(literal)

    t = texts.select("text").where("text is not null").distinct().withColumn("gram", F.explode(grams(F.col("text"))))
    g = globs.select("glob").where("glob is not null").distinct()
    g = g.withColumns({"gram": F.substring(piece("glob"), 1, GRAM), "regex": paths.glob_column(F.col("glob"))})
    return t.join(g, "gram").where(F.expr("text rlike regex")).select("text", "glob")


def _globs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = k.cast("string")
    forms = [F.concat(F.lit("rtl/m"), n, F.lit("*.sv")), F.concat(F.lit("*"), n, F.lit(".v")), F.lit("inc/h?[02468].vh"), F.concat(F.lit("pkg/p+(x)"), n, F.lit("*")), F.lit("[!rt]*/*[0-4]?.*v*"), F.concat(F.lit("*_tb.sv"), F.lit("")), F.concat(F.lit("rtl/[*"), n)]
    return s.read.parquet(f"{d}/nation.parquet").select(F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int")).alias("glob"))


QUERIES = {
    "j22_globs": lambda s, d: fitting(corpus.files(s, d).select(F.col("path").alias("text")), _globs(s, d)),
    "f26_named_targets": lambda s, d: contained(corpus.files(s, d).select(F.col("path").alias("text")), s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("needle"))),
    "j21_file_names": lambda s, d: contained(s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("text")), s.read.parquet(f"{d}/part.parquet").select(F.element_at(F.split("p_name", " "), -1).alias("needle"))),
}
ORACLE = {
    "j22_globs": """
        WITH g AS (SELECT DISTINCT ['rtl/m' || n_nationkey || '*.sv', '*' || n_nationkey || '.v', 'inc/h?[02468].vh', 'pkg/p+(x)' || n_nationkey || '*', '[!rt]*/*[0-4]?.*v*', '*_tb.sv', 'rtl/[*' || n_nationkey][n_nationkey % 7 + 1] AS glob FROM nation)
        SELECT DISTINCT f.path AS text, g.glob FROM f_path f, g WHERE CASE WHEN g.glob LIKE 'rtl/[*%' THEN false ELSE f.path GLOB g.glob END""",
    "f26_named_targets": "SELECT DISTINCT f.path AS text, 'm' || n.n_nationkey AS needle FROM f_path f, nation n WHERE contains(f.path, 'm' || n.n_nationkey)",
    "j21_file_names": "SELECT DISTINCT a.p_name AS text, b.needle FROM part a, (SELECT DISTINCT string_split(p_name, ' ')[-1] AS needle FROM part) b WHERE contains(a.p_name, b.needle)",
}
