"""Sharding by fixed virtual slots.

Every record hashes into one of a few thousand slots by its id and text. Bytes are
summed per slot, and a small versioned table maps slots to shards: largest slot
first, each to the shard with the fewest bytes. Rebalancing edits that table; it
moves whole slots out of shards above their share and nothing else. The table
has as many rows as there are slots, whatever the input's size, so planning is
one fold over a bounded array, and records never meet in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, staged, table

SLOTS = 8192
OVERHEAD = 16


def slot_rows(docs: DataFrame, n_slots: int = SLOTS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, vslot of every row.

    Size is the text's UTF-8 bytes plus ``overhead``; a null text has none, and
    its crc32 is that of no bytes. Rows hash by id and text, so that many texts
    under one id, or under none, spread over the slots; rows alike in both share
    one. Texts of any length and empty ones are rows like others; other columns
    are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    crc, n = F.crc32(text), F.octet_length(text).cast("long")
    return docs.select("doc_id", (n + overhead).alias("size"), crc.alias("text_crc32"), F.pmod(F.xxhash64("doc_id", crc, n), F.lit(n_slots)).cast("int").alias("vslot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _deal(loose: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """Deal loose slots out, largest first, each to the shard with the fewest bytes so far.

    ``loads`` is one row with a map m from shard to the bytes it holds beforehand.
    There is a row for each slot at most, so the array that is folded has a fixed
    bound.
    """
    least = "array_position(a.loads, array_min(a.loads)) - 1"
    folded = f"""aggregate(todo,
        named_struct('loads', transform(sequence(0, {n_shards} - 1), s -> coalesce(m[s], 0L)), 'own', cast(array() as array<int>)),
        (a, x) -> named_struct(
            'loads', transform(a.loads, (v, i) -> if(i = {least}, v + x.weight, v)),
            'own', concat(a.own, array(cast({least} as int)))),
        a -> transform(a.own, (s, i) -> named_struct('vslot', todo[i].vslot, 'shard', s)))"""
    todo = loose.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", F.col("bytes").alias("weight")))).alias("todo"))
    return todo.crossJoin(F.broadcast(loads)).select(F.explode(F.expr(folded)).alias("x")).select("x.vslot", "x.shard")


def _loads(kept: DataFrame) -> DataFrame:
    return kept.groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("m"))


def plan(stats: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map: vslot, shard, version, for the slots that hold rows."""
    nothing = stats.select(F.lit(0).alias("shard"), "bytes").where("false")
    return _deal(stats, _loads(nothing), n_shards).withColumn("version", F.lit(1))


def rebalance(old: DataFrame, stats: DataFrame, n_shards: int, slack: float = 0.02) -> DataFrame:
    """The map's next version for new bytes or another number of shards.

    A shard keeps its slots, by number, while they fit its share plus ``slack``;
    the others, those of shards that are gone and new slots are dealt out anew.
    """
    share = stats.agg((F.sum("bytes") * (1 + slack) / n_shards).alias("share"))
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy("vslot"))
    held = stats.join(old.select("vslot", "shard"), "vslot", "left").withColumn("upto", upto).crossJoin(F.broadcast(share))
    keeps = F.coalesce((F.col("shard") < n_shards) & (F.col("upto") <= F.col("share")), F.lit(False))
    kept = held.where(keeps)
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return kept.select("vslot", "shard").unionByName(_deal(held.where(~keeps), _loads(kept), n_shards)).crossJoin(F.broadcast(version))


def save_map(slot_map: DataFrame, path: str) -> int:
    """Store a version in a folder of its own beside the others, in place of an earlier try of the same; its number, 0 for an empty map."""
    version = slot_map.agg(F.max("version")).first()[0] or 0
    slot_map.select("vslot", "shard").write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored map of that version, the latest by default."""
    every = spark.read.schema("vslot int, shard int, version int").option("basePath", path).parquet(path)
    if version is not None:
        return every.where(F.col("version") == version)
    return every.join(F.broadcast(every.agg(F.max("version").alias("version"))), "version").select("vslot", "shard", "version")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Give every row its shard and its place there, gapless from 0.

    The place is the row's rank within its virtual slot plus the rows of the
    shard's earlier slots; ties go by crc and size, and rows alike in those are
    interchangeable.
    """
    stats = slot_bytes(rows).drop("bytes")
    base = stats.join(slot_map.select("vslot", "shard"), "vslot").withColumn("base", F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(base.drop("rows"), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("place")).alias("slot"))


def op7(spark: SparkSession, sf_dir: str, n_shards: int = 40) -> DataFrame:
    """Shards 0 to 39 of near equal bytes (law ``bytes``), by the first version of a stored map."""
    rows = staged(slot_rows(table(spark, sf_dir, "documents")), "slots")
    path = f"{shared_dir(spark)}/quarry/slot-maps-{uuid.uuid4().hex}"
    version = save_map(plan(slot_bytes(rows), n_shards), path)
    return assign(rows, load_map(spark, path, version)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
