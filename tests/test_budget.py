"""Budgets, running sums and batches against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import budget
from quarry.sources.keyed import KeyedTable


def plain_sections(items, letters):
    """The items of one chunk that are taken, section by section, by a loop."""
    out, used, s = [], 0, 0
    while used < letters and any(x[0] == s for x in items):
        own, taken = sorted(x for x in items if x[0] == s), 0
        for section, place, size, head in own:
            if used + size + 1 > letters:
                break
            used, taken = used + size + 1, taken + 1
            out.append((section, place, used))
        used += head + 2 if taken else 0
        s += 1
    return out


@pytest.mark.parametrize("letters", [1, 40, 100, 10_000])
def test_sections_equal_a_loop(spark, letters):
    rng = np.random.default_rng(letters)
    rows = [(c, int(s), k, int(rng.integers(0, 30)), 4 + int(s)) for c in range(60) for k, s in enumerate(rng.choice(5, rng.integers(0, 25), p=[0.3, 0.3, 0.2, 0.1, 0.1]))]
    got = budget.sections(spark.createDataFrame(rows, "chunk long, section int, place long, size long, head long"), letters + 10, 10).collect()
    for c in range(60):
        assert sorted((r["section"], r["place"], r["used"]) for r in got if r["chunk"] == c) == sorted(plain_sections([x[1:] for x in rows if x[0] == c], letters)), c


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[int(rng.integers(2))], int(k), int(rng.integers(9))) for k in rng.integers(-500, 500, 700)]
    got = budget.running(spark.createDataFrame(rows, "g string, k long, v long"), "k", F.col("v"), "before", ("g",), 64).collect()
    assert len(got) == 700 and all(r["before"] == sum(v for g, k, v in rows if g == r["g"] and k < r["k"]) for r in got)
    assert budget.running(spark.createDataFrame([], "k long, v long"), "k", F.col("v"), "before").count() == 0


def test_one_batch_fails_alone_and_is_taken_up_again(spark, tmp_path):
    docs = budget.batched(spark.range(25).selectExpr("id", "if(id = 13, null, 'x') as text"), "id", 10)
    assert sorted((r["batch"], r["count"]) for r in docs.groupBy("batch").count().collect()) == [(0, 10), (1, 10), (2, 5)]
    manifest = KeyedTable(spark, f"file://{tmp_path}/m", budget.MANIFEST, ("batch",), buckets=2)
    table = f"file://{tmp_path}/t"
    valid = F.col("text").isNotNull()
    assert budget.ingest(table, manifest, docs, valid) == {"done": 2, "failed": 1}
    assert budget.ingested(table, manifest).count() == 15
    assert budget.ingest(table, manifest, docs, valid) == {"done": 0, "failed": 1}
    assert budget.ingest(table, manifest, docs.fillna("y", ["text"]), valid) == {"done": 1, "failed": 0}
    assert budget.ingest(table, manifest, docs, valid) == {"done": 0, "failed": 0}
    docs.write.parquet(f"{table}/attempt=broken")  # an attempt that never came to its manifest
    got = budget.ingested(table, manifest)
    assert got.select("id").distinct().count() == got.count() == 25
    assert {r["state"] for r in manifest.read().collect()} == {"done"}
