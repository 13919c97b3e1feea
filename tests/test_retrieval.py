"""Nearest neighbours against all pairs: regions, ties, thresholds as they are, and vectors without a direction."""

import numpy as np
import pytest

from quarry.operators import retrieval

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, asked, k, least, metric):
    x = {i: np.asarray(v, float) for i, v in rows if v is not None and None not in v}
    out = []
    for i in asked:
        found = []
        for j, v in x.items():
            q = x.get(i)
            if q is None or i == j:
                continue
            if metric == "cosine":
                size = np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())
                if size > 0 and (least is None or (v * q).sum() / size >= least):
                    found.append((-(v * q).sum() / size, j))
            else:
                found.append((np.sqrt(((v - q) ** 2).sum()), j))
        out += [(i, j, r) for r, (_, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(12, 16)) * 3
    x = [(i, (middles[i % 12] + rng.normal(size=16) * 0.4).astype(np.float32).tolist()) for i in range(900)]
    return x + [(1000 + i, x[i][1]) for i in range(0, 40, 4)] + [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 15 + [None])]


@pytest.mark.parametrize(("k", "least", "metric"), [(2, None, "cosine"), (25, 0.6, "cosine"), (2000, 0.0, "cosine"), (3, None, "l2")])
def test_equal_to_all_pairs(spark, rows, k, least, metric):
    v = spark.createDataFrame(rows, SCHEMA)
    asked = [i for i, _ in rows if i % 60 == 0 or i >= 2000]
    index = retrieval.Index(v, metric, region=50)
    got = retrieval.nearest(index, v.where(v["vec_id"].isin(asked)), k, least)
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()) == plain(rows, asked, k, least, metric)


def test_far_regions_are_not_asked(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16))
    v = spark.createDataFrame([(i, (middles[i % 12] + rng.normal(size=16) * 0.03).tolist()) for i in range(900)], "vec_id long, embedding array<double>")
    index = retrieval.Index(v, region=10)
    q = retrieval.points(v.where("vec_id % 60 = 0 and vec_id < 900"), "cosine").withColumnsRenamed({"vec_id": "query_id", "point": "query"})
    best = retrieval._measured(index, q, None, 2, np.inf).groupBy("query_id").agg({"away": "max"}).withColumnRenamed("max(away)", "kth")
    size = {int(r[0]): r[3] for r in index.table[1]}
    both = retrieval.asked(index, q, None, 2, np.inf).unionByName(retrieval.asked(index, q, best, 2, np.inf)).collect()
    assert sum(size[r["region"]] for r in both) < 0.35 * q.count() * index.n


def test_scores_are_not_rounded(spark):
    import math

    near = [math.cos(math.acos(0.2999997)), math.sin(math.acos(0.2999997))]
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, near), (2, [0.3000001, math.sqrt(1 - 0.3000001**2)])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in retrieval.nearest(v, v.where("vec_id = 0"), 5, 0.3).collect()] == [2]


def test_empty_tables(spark, rows):
    v, none = spark.createDataFrame(rows[:20], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert [retrieval.nearest(a, b, 2).count() for a, b in ((none, v), (v, none), (none, none))] == [0, 0, 0]
