"""Mixing sources to target weights by systematic sampling.

Each source's target is shared out by weight, up to a limit of repeats, and the
excess reshared (water filling in closed form over the sources). A document's
expected copies are its source's target over its source's size; the documents
of a source are laid in a line by size, their expected copies summed along it,
one random offset added, and a copy emitted for every whole number crossed.

The prefix sum is one rank in three levels (size class, salt, row), so that no
source, however large, is sorted in one task: only counts of classes and salts
meet by source, at most a few hundred rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, staged, table

WEIGHTS = (5, 2, 1)
SHARE, REPEATS, SEED = 1.5, 2, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """From (source, source_size) to those and ``target``.

    Sources by code point, null last, weigh as listed, repeating. With r = limit
    / weight, sources in order of r reach their limit as long as r is below the
    level that the rest then share; the first one above fixes the level.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("r", F.col("cap") / F.col("w")).withColumn("k", rank)
    before = Window.orderBy("r", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("r", "k").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("r", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    x = x.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    level = F.first(F.when(F.col("r") >= F.col("level"), F.col("level")), ignorenulls=True).over(everything)
    return x.withColumn("level", level).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def copies(docs: DataFrame, size: Column | None = None, seed: str = SEED, **how) -> DataFrame:
    """All columns of docs, then size, source_size, target, copies under names that docs leaves free.

    A null or empty text has size 0; texts of any length count whole; a null
    source is a source; rows alike in source, size and doc_id are interchangeable.
    An empty table gives no rows. Words are counted once and staged with the rows,
    of which the counts by class then read the small columns only.
    """
    names = fresh(docs, "size", "source_size", "target", "copies", "skey", "digest", "class", "salt", "place")
    n_size, n_whole, n_target, n_copies, skey, digest, klass, salt, place = names
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("source")))
    d = docs.withColumns({n_size: words(F.col("text")) if size is None else size, skey: key, digest: F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))})
    d = d.withColumns({klass: F.floor(F.sqrt(F.col(n_size).cast("double"))), salt: F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")})
    d = staged(d, "mixing")
    group = [skey, klass, salt]
    n = d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(n_size).alias("b"))
    classes = n.groupBy(skey, klass).agg(F.sum("n").alias("cn"), F.sum("b").alias("cb"))
    below = Window.partitionBy(skey).orderBy(klass).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("cbase", F.coalesce(F.sum("cn").over(below), F.lit(0)))
    inner = Window.partitionBy(skey, klass).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sizes = classes.groupBy(skey).agg(F.sum("cb").alias("source_size")).withColumn("source", F.when(F.col(skey) != "n", F.expr(f"substring({skey}, 2)")))
    rates = targets(sizes.select("source", "source_size"), **how).withColumn(skey, F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("source")))).drop("source")
    offsets = n.withColumn("sbase", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(classes.select(skey, klass, "cbase"), [skey, klass]).join(rates, skey)
    offsets = offsets.select(*group, (F.col("cbase") + F.col("sbase")).alias("base"), F.col("source_size").alias(n_whole), F.col("target").alias(n_target))
    # Every other salt runs backwards through its sizes: the line of sizes then has no jumps.
    turn = F.when(F.col(salt) % 2 == 0, F.col(n_size)).otherwise(-F.col(n_size))
    at = F.row_number().over(Window.partitionBy(*group).orderBy(turn, digest, "doc_id")) - 1
    d = d.withColumn(place, at).join(offsets, group)
    rate = F.when(F.col(n_whole) > 0, F.col(n_target) / F.col(n_whole)).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(skey))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    rank = F.col("base") + F.col(place)
    d = d.withColumn(n_copies, (F.floor(rate * (rank + 1).cast("double") + start) - F.floor(rate * rank.cast("double") + start)).cast("int"))
    return d.select(*[d[c] for c in docs.columns], n_size, n_whole, n_target, n_copies)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with docs' columns."""
    d = copies(docs, **how)
    n, i = d.columns[-1], fresh(d, "i")[0]
    return d.where(F.col(n) > 0).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = copies(docs.select("doc_id", "source", words(F.col("text")).alias("n")), size=F.col("n"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{SEED}' || coalesce(doc_id::VARCHAR, '-')) AS digest FROM documents),
o AS (SELECT *, floor(sqrt(size::DOUBLE)) AS klass, ('0x' || substr(digest, 1, 2))::INTEGER AS salt FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY klass, salt, CASE WHEN salt % 2 = 0 THEN size ELSE -size END, digest, doc_id) - 1 AS place FROM o),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][(k % 3 + 1)::INTEGER]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM k),
r AS (SELECT *, cap / w AS r FROM w),
l AS (SELECT *, ((SUM(source_size) OVER ()) * 1.5::DOUBLE - coalesce(SUM(cap) OVER (ORDER BY r, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / SUM(w) OVER (ORDER BY r, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
v AS (SELECT arg_min(level, (r, k)) AS level FROM l WHERE r >= level),
t AS (SELECT source, source_size, coalesce(least(cap, v.level * w), cap) AS target,
        CASE WHEN source_size > 0 THEN coalesce(least(cap, v.level * w), cap) / source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5('{SEED}' || CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM l, v)
SELECT p.doc_id, p.size, t.source_size, t.target,
  (p.size * (floor(rate * (place + 1)::DOUBLE + start) - floor(rate * place::DOUBLE + start)))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
