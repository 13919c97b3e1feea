"""Event streams: inserts without repeats, and a daily rollup that can run again.

Each micro-batch writes its own partial sums under its batch number, replacing
what an earlier try of the same batch wrote; a report adds the partial sums up.
So a batch that fails halfway and runs again is counted once, no batch rewrites
the days of others, and the state kept is a row for each batch, day and type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import filesystem, new_folder


def event_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """The event files at path as a stream, a bounded number of files a batch."""
    schema = spark.read.parquet(path).schema
    path = re.sub(r"([A-Za-z])$", r"[\1]", path)  # as a pattern it may also name a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def fresh_events(events: DataFrame, late: str | None = None) -> DataFrame:
    """Each event once. With a watermark the state is bounded, and what comes later than it is lost; without one nothing is."""
    if late is None:
        return events.withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates(["event_id"])
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def partial_sums(batch: DataFrame) -> DataFrame:
    day = F.to_date("ts").alias("day")
    return batch.groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.max("value").alias("top_value"))


def rollup(events: DataFrame, folder: str) -> None:
    """Add what has come since the last run to the partial sums in folder."""

    def keep(batch: DataFrame, number: int) -> None:
        partial_sums(batch).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")

    events.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def report(spark: SparkSession, folder: str) -> DataFrame:
    """(day, event_type, n, first_event, last_event, top_value) of all batches so far."""
    sums = spark.read.parquet(f"{folder}/sums")
    return sums.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"), F.max("top_value").alias("top_value"))


class EventStore:
    """Events by day, each id once, from a stream of which batches may run again.

    What has been seen is in the stored days, not in the stream's state: a batch
    is held against the ids of its own days alone, so memory does not grow with
    the stream. An event's time belongs to its identity: the same id at another
    day is another event. Rows of days that lie ``late_days`` or more before the
    newest day of earlier batches go to a side table, unless they are known, so
    that finished days stay as they are and nothing is lost.
    """

    def __init__(self, spark: SparkSession, folder: str, late_days: int = 7, key: str = "event_id", time: str = "ts") -> None:
        self.spark, self.folder, self.late_days, self.key, self.time = spark, folder.rstrip("/"), late_days, key, time

    def _table(self, name: str, before: int | None = None) -> DataFrame | None:
        """The stored rows of batches before a number, or all."""
        at, fs = filesystem(self.spark, f"{self.folder}/{name}")
        numbers = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [n for n in numbers if n.startswith("batch=") and (before is None or int(n.removeprefix("batch=")) < before)]
        # A batch that had no rows for a table has no days in it.
        paths = [f"{self.folder}/{name}/{n}" for n in numbers if any(x.getPath().getName().startswith("day=") for x in fs.listStatus(filesystem(self.spark, f"{self.folder}/{name}/{n}")[0]))]
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*paths) if paths else None

    def _fresh(self, batch: DataFrame, number: int) -> DataFrame:
        """The rows that neither table has from earlier batches."""
        stored = [t for t in (self._table("events", number), self._table("late", number)) if t is not None]
        if not stored:
            return batch
        first, last = batch.agg(F.min("day"), F.max("day")).first()
        for t in stored:
            batch = batch.join(t.where(F.col("day").between(F.lit(first), F.lit(last))).select(self.key, "day"), [self.key, "day"], "left_anti")
        return batch

    def add(self, batch: DataFrame, number: int) -> None:
        """Store what is new in a batch; the same number again replaces what it wrote before."""
        batch = batch.withColumn("day", F.to_date(self.time)).dropDuplicates([self.key, "day"]).persist()
        try:
            stored = self._table("events", number)
            newest = stored.agg(F.max("day")).first()[0] if stored is not None else None
            late = F.lit(False) if newest is None else F.coalesce(F.col("day") <= F.date_sub(F.lit(newest), self.late_days), F.lit(False))
            for name, rows in (("events", batch.where(~late)), ("late", batch.where(late))):
                self._fresh(rows, number).write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/{name}/batch={number}")
        finally:
            batch.unpersist()

    def run(self, events: DataFrame) -> None:
        """All that has come since the last run."""
        events.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start().awaitTermination()

    def events(self) -> DataFrame | None:
        return self._table("events")

    def late(self) -> DataFrame | None:
        return self._table("late")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "rollup")
    rollup(event_stream(spark, f"{d}/events.parquet"), folder)
    return report(spark, folder)


def _inserted(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "events")
    events = fresh_events(event_stream(spark, f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type"))
    events.writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/events").select("event_id", "user_id", "event_type")


def _batches(spark: SparkSession, d: str) -> tuple[EventStore, DataFrame]:
    """The events as files by the order that they come in: even ids by week, odd ids all at the end, every fifth twice."""
    folder = new_folder(spark, "event-store")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    week = F.when(F.col("event_id") % 2 == 1, F.lit(99)).otherwise(F.weekofyear("ts"))
    parts = e.withColumn("part", week).unionByName(e.where("event_id % 5 = 0").withColumn("part", F.lit(98)))
    numbers = sorted(r["part"] for r in parts.select("part").distinct().collect())
    store = EventStore(spark, f"{folder}/store")
    for n in numbers:  # a file for each; the stream takes one a batch
        parts.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        store.run(event_stream(spark, f"{folder}/in", 1))
    return store, e


def _stored(spark: SparkSession, d: str) -> DataFrame:
    store, _ = _batches(spark, d)
    kept = store.events().select("event_id", "user_id", "event_type", F.lit(False).alias("late"))
    late = store.late()
    return kept if late is None else kept.unionByName(late.select("event_id", "user_id", "event_type", F.lit(True).alias("late")))


def _again(spark: SparkSession, d: str) -> DataFrame:
    """The same batch twice under its number, and again under the next: counts by day."""
    store = EventStore(spark, new_folder(spark, "event-again"))
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    store.add(e.where("event_id % 3 = 0"), 0)
    store.add(e.where("event_id % 3 = 0").unionByName(e.where("event_id % 6 = 0")), 0)
    store.add(e, 1)
    return store.events().unionByName(store.late()).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


QUERIES = {"t01_event_insert": _inserted, "t02_daily_rollup": _daily, "t01_event_store": _stored, "t04_event_retries": _again}
ORACLE = {
    "t01_event_insert": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "t02_daily_rollup": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event, max(value) AS top_value FROM events GROUP BY 1, 2",
    # Even ids come by week, so each is in time; odd ids come when the newest even day is known.
    "t01_event_store": """
        WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), n AS (SELECT max(day) AS newest FROM e WHERE event_id % 2 = 0)
        SELECT event_id, user_id, event_type, event_id % 2 = 1 AND day <= newest - 7 AS late FROM e, n""",
    "t04_event_retries": "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
}
