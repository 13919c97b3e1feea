"""Connected components of links between ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _settled(e: DataFrame) -> bool:
    """Whether every id has one parent and no parent has any."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
    each = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not each.agg(F.max(F.expr("up > 1 or up = 1 and down = 1"))).first()[0]


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every id in links (a, b): label is the least id it reaches.

    Each round points every neighbour at the least one around it, first upwards,
    then downwards; links only ever shrink, and rounds grow with the logarithm of
    a component. Least ids are found by partial aggregation and links rewritten by
    joins, so an id with many links is never gathered in one task.
    """
    e = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, name)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        old, e = e, staged(small.where("u <> v").distinct(), name)
        discard(old, large)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
