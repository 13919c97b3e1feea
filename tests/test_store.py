"""Keyed tables: versions, retries, writers that meet, and what a merge touches."""

import datetime

from pyspark.sql import functions as F

from quarry.operators import store
from quarry.sources import keyed

SCHEMA = "k long, a string, b int"


def rows(spark, *x):
    return spark.createDataFrame(list(x), SCHEMA)


def all_of(df):
    return sorted(map(tuple, df.collect()))


def test_insert_update_fill_and_leave(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("k",), buckets=4)
    assert t.version() == 0 and t.read().count() == 0
    assert t.merge(rows(spark, (1, "x", 1), (2, "y", 2), (None, "lost", 0)), "one") == {"version": 1, "inserted": 2, "updated": 0}
    assert t.merge(rows(spark, (2, None, None), (3, "z", 3)), "two", update={"a": keyed.FILL, "b": keyed.NEW}) == {"version": 2, "inserted": 1, "updated": 1}
    assert all_of(t.read().fillna(-1)) == [(1, "x", 1), (2, "y", -1), (3, "z", 3)]
    assert t.merge(rows(spark, (3, "w", 9), (4, "no", 0)), "three", update={"b": keyed.NEW}, insert=False) == {"version": 3, "inserted": 0, "updated": 1}
    assert all_of(t.read().where("k > 2")) == [(3, "z", 9)]
    assert all_of(t.read(1)) == [(1, "x", 1), (2, "y", 2)]


def test_a_retry_changes_nothing(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("k",))
    t.merge(rows(spark, (1, "x", 1)), "one")
    t.merge(rows(spark, (1, "y", 2)), "two")
    assert t.merge(rows(spark, (1, "x", 1)), "one") == {"version": 1, "inserted": 0, "updated": 0}
    assert t.version() == 2 and all_of(t.read()) == [(1, "y", 2)]
    assert t.merge(rows(spark), "none") == {"version": 2, "inserted": 0, "updated": 0}


def test_several_rows_of_a_key(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("k",))
    t.merge(rows(spark, (1, "old", 1), (1, "new", 5), (1, "mid", 3), (2, "a", 1), (2, "b", 1)), "one", latest=F.col("b"))
    assert all_of(t.read()) == [(1, "new", 5), (2, "b", 1)]


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    """A second writer commits between the first one's read and its commit; the first starts again."""
    t, other = (keyed.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("k",), buckets=2) for _ in range(2))
    publish, meet = t._publish, [True]

    def late(version, commit):
        if meet.pop() if meet else False:
            other.merge(rows(spark, (1, "theirs", 1), (2, "theirs", 2)), "other")
        return publish(version, commit)

    t._publish = late
    assert t.merge(rows(spark, (1, "mine", 1)), "mine", update={"a": keyed.NEW}) == {"version": 2, "inserted": 0, "updated": 1}
    assert all_of(t.read()) == [(1, "mine", 1), (2, "theirs", 2)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("k",), buckets=8)
    t.merge(rows(spark, *[(i, "x", i) for i in range(200)]), "one")
    before = t._commit(1)["folders"]
    t.merge(rows(spark, (5, "y", 5)), "two")
    after = t._commit(2)["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1 and t.read().count() == 200
    t.merge(rows(spark, *[(i, "z", i) for i in range(200)]), "three")
    assert t.vacuum() == 2 and t.read().where("a = 'z'").count() == 200


def test_runs_end_once_and_only_if_they_began(spark, tmp_path):
    t = store.runs_table(spark, f"file://{tmp_path}/runs")
    store.start_runs(t, spark.createDataFrame([("r1", "m1"), ("r2", None)], "run_id string, metadata string").withColumn("mode", F.lit("fixer")), "s")
    at = datetime.datetime(2024, 1, 1)
    ends = spark.createDataFrame([("r1", at, 4, None), ("r9", at, 1, "x")], "run_id string, finished_at timestamp, issues_total int, metadata string")
    assert store.finish_runs(t, ends, "e")["updated"] == 1
    store.start_runs(t, spark.createDataFrame([("r1", "again")], "run_id string, metadata string"), "s2")
    got = {r["run_id"]: r for r in t.read().collect()}
    assert set(got) == {"r1", "r2"} and got["r1"]["status"] == "completed" and got["r1"]["metadata"] == "m1" and got["r1"]["issues_total"] == 4 and got["r1"]["issues_low"] == 0
    assert got["r2"]["status"] == "started" and got["r2"]["finished_at"] is None


def test_feedback_is_traced_to_what_became_of_it(spark):
    feedback = spark.createDataFrame([("a.v", "x", "FIX"), ("a.v", "y", "FIX"), ("b.v", "x", "SKIP"), (None, "x", "FIX"), ("c.v", "x", "FIX")], "file string, issue string, action string")
    audit = spark.createDataFrame([("a.v", "x", 1, "FAILED", 9), ("a.v", "x", 2, "FIXED", 4), ("a.v", "y", 1, "", 3), (None, "x", 1, None, 1)], "file string, issue string, at int, status string, lines_changed int")
    fixes = spark.createDataFrame([("a.v", "x", 1, "ok"), ("a.v", "y", 1, "ok"), ("b.v", "x", 1, "skipped"), (None, "x", 5, "late")], "file string, issue string, at int, status string")
    got = sorted((r["file"], r["issue"], r["fixer_status"], r["lines_changed"]) for r in store.traceability(feedback, audit, fixes).collect())
    assert got == [("", "x", "late", 1), ("a.v", "x", "FIXED", 4), ("a.v", "y", "ok", 3), ("b.v", "x", "skipped", 0), ("c.v", "x", "PENDING", 0)]
