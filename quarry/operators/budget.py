"""What fits: places and running sums in two levels, sections of text within a budget, and ingest by batches that stand or fail alone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from ..staging import new_folder, staged

#: Letters that the head and the foot of a context take, beside its own lines.
FRAME = 105
MANIFEST = "batch long, state string, rows long, bad long, attempt string"


def running(rows: DataFrame, order: str, value: Column, name: str, by: tuple[str, ...] = (), width: int = 10_000) -> DataFrame:
    """rows with the sum of ``value`` over the rows before each, by a whole number that orders them within ``by``; equal numbers go together.

    Sums of stretches of ``width`` numbers come first, and only within a stretch
    are rows sorted, so that no group is sorted in one task, however large.
    """
    stretch = F.floor(F.col(order) / width)
    r = rows.withColumns({"_stretch": stretch, "_value": value})
    sums = r.groupBy(*by, "_stretch").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_stretch").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return r.join(sums, [*by, "_stretch"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_stretch", "_value", "_before", "_within")


def sections(items: DataFrame, budget: int, frame: int = FRAME) -> DataFrame:
    """(chunk, section, place, used): the items of each chunk that its budget takes, and the letters used after each.

    items: (chunk, section from 0, place, size, head). Sections go in order, items
    by place; an item takes its size and one more. The first of a section that
    does not fit ends that section, not the chunk: a later section's may fit.
    After a section with items its head and two more letters count. A section
    without items, or a budget used up when a section begins, ends the chunk.
    """
    left = budget - frame
    # What does not fit with those before it in its own section never does, so at most a budget of items a section is gathered.
    own = Window.partitionBy("chunk", "section").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = items.withColumn("_own", F.sum(F.col("size") + 1).over(own))
    some = some.where((F.col("_own") <= left) | (F.col("_own") - F.col("size") - 1 <= left))
    x = some.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("section", "place", "size", "head"))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("section"), F.lit(True).alias("open"), F.lit(False).alias("any"), F.lit(0).cast("long").alias("head"), F.lit(False).alias("done"), F.expr("cast(array() as array<struct<section: int, place: bigint, used: bigint>>)").alias("taken"))

    def add(a: Column, i: Column) -> Column:
        new = i["section"] != a["section"]
        used = a["used"] + F.when(new & a["any"], a["head"] + 2).otherwise(0)
        done = a["done"] | (new & ((i["section"] != a["section"] + 1) | (used >= left)))
        fits = ~done & (new | a["open"]) & (used + i["size"] + 1 <= left)
        after = used + F.when(fits, i["size"] + 1).otherwise(0)
        row = F.struct(i["section"].cast("int").alias("section"), i["place"].cast("long").alias("place"), after.alias("used"))
        return F.struct(after.cast("long").alias("used"), i["section"].cast("int").alias("section"), fits.alias("open"), (F.when(new, F.lit(False)).otherwise(a["any"]) | fits).alias("any"), i["head"].cast("long").alias("head"), done.alias("done"), F.when(fits, F.array_append(a["taken"], row)).otherwise(a["taken"]).alias("taken"))

    return x.select("chunk", F.explode(F.aggregate("items", zero, add)["taken"]).alias("t")).select("chunk", "t.*")


def batched(docs: DataFrame, key: str, size: int = 500) -> DataFrame:
    """docs with ``batch``, from 0: so many documents each, by key."""
    return running(docs, key, F.lit(1).cast("long"), "_place").withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")


def ingest(folder: str, manifest: KeyedTable, docs: DataFrame, valid: Column) -> dict[str, int]:
    """Write batches (docs with ``batch``) that are not done yet; a batch with a document that is not valid fails whole, and the others stand.

    The manifest has each batch's state and rows, and the attempt that wrote it.
    A retry, with the same or with mended documents, takes up only those that are
    not done; what an attempt wrote before it broke off is never read.
    """
    done = manifest.read().where("state = 'done'").select("batch")
    rest = staged(docs.join(done, "batch", "left_anti").withColumn("_valid", F.coalesce(valid, F.lit(False))), "ingest")
    states = rest.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.col("_valid"), 1)).alias("bad")).withColumn("state", F.when(F.col("bad") > 0, "failed").otherwise("done"))
    states = staged(states, "ingest-states")
    attempt = uuid.uuid4().hex
    good = rest.join(states.where("state = 'done'").select("batch"), "batch", "left_semi").drop("_valid")
    good.write.parquet(f"{folder}/attempt={attempt}")
    manifest.merge(states.withColumn("attempt", F.lit(attempt)), attempt)
    n = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"done": n.get("done", 0), "failed": n.get("failed", 0)}


def ingested(folder: str, manifest: KeyedTable) -> DataFrame:
    """The documents of the batches that are done, each from the attempt that wrote it."""
    done = manifest.read().where("state = 'done'").select("batch", "attempt")
    return manifest.spark.read.parquet(folder).join(done, ["batch", "attempt"], "left_semi").drop("attempt")


def _items(s: SparkSession, d: str) -> DataFrame:
    li = s.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("chunk"), (F.col("l_suppkey") % 4).cast("int").alias("section"), ((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 64 + F.col("l_quantity").cast("long")).alias("place"), F.col("l_quantity").cast("long").alias("size"), (3 + F.col("l_suppkey") % 4).alias("head"))


def _running(s: SparkSession, d: str) -> DataFrame:
    """Which documents of a source stay within a sum of lengths, by id."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars")
    r = running(docs, "doc_id", F.col("n_chars"), "before", ("source",), 100)
    return r.where(F.col("before") + F.col("n_chars") <= 60_000).select("source", "doc_id", "before")


def _ingest(s: SparkSession, d: str) -> DataFrame:
    """Vectors in batches of 60, some of a wrong width; a second try has mended half of those."""
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.size("embedding").alias("width"))
    table, manifest = new_folder(s, "vectors"), KeyedTable(s, new_folder(s, "manifest"), MANIFEST, ("batch",), buckets=2)
    first = batched(v.withColumn("width", F.when(F.col("vec_id") % 97 == 5, 3).otherwise(F.col("width"))), "vec_id", 60)
    ingest(table, manifest, first, F.col("width") == 64)
    mended = batched(v.withColumn("width", F.when(F.col("vec_id") % 194 == 5, 3).otherwise(F.col("width"))), "vec_id", 60)
    for _ in range(2):
        ingest(table, manifest, mended, F.col("width") == 64)
    stored = ingested(table, manifest).groupBy("batch").agg(F.count(F.lit(1)).alias("stored"))
    return manifest.read().join(stored, "batch", "left").select("batch", "state", "rows", "bad", F.coalesce("stored", F.lit(0)).alias("stored"))


QUERIES = {"w10_sections": lambda s, d: sections(_items(s, d), 75, 15), "w10_running": _running, "v06_batch_ingest": _ingest}
ORACLE = {
    # Section by section: the sum of a section's items from its first on, cut where it passes what is left.
    "w10_sections": """
        WITH RECURSIVE i AS (SELECT l_orderkey AS chunk, l_suppkey % 4 AS section, (l_linenumber * 1000000 + l_partkey) * 64 + l_quantity::BIGINT AS place, l_quantity::BIGINT + 1 AS size FROM lineitem),
        own AS (SELECT *, sum(size) OVER (PARTITION BY chunk, section ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM i),
        s AS (SELECT chunk, 0 AS section, 0::BIGINT AS used FROM i GROUP BY chunk
          UNION ALL SELECT s.chunk, s.section + 1, s.used + (SELECT coalesce(max(o.upto) + 3 + s.section + 2, 0) FROM own o WHERE o.chunk = s.chunk AND o.section = s.section AND s.used + o.upto <= 60)::BIGINT
          FROM s WHERE s.section < 3 AND s.used < 60 AND EXISTS (SELECT 1 FROM i WHERE i.chunk = s.chunk AND i.section = s.section))
        SELECT s.chunk, s.section::INT AS section, o.place, s.used + o.upto AS used FROM s JOIN own o ON o.chunk = s.chunk AND o.section = s.section AND s.used + o.upto <= 60 WHERE s.used < 60""",
    "w10_running": "SELECT source, doc_id, before FROM (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) WHERE before + n_chars <= 60000",
    "v06_batch_ingest": """
        WITH v AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 60 AS batch FROM embeddings),
        b AS (SELECT batch, count(*) AS rows, count(*) FILTER (vec_id % 97 = 5) AS one, count(*) FILTER (vec_id % 194 = 5) AS two FROM v GROUP BY batch)
        SELECT batch, CASE WHEN two > 0 THEN 'failed' ELSE 'done' END AS state, rows, two AS bad, CASE WHEN two > 0 THEN 0 ELSE rows END AS stored FROM b""",
}
