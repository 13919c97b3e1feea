"""Ranked search against brute force: lists, blocks of items, ties and hard inputs."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=50):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    df = Counter(t for _, c in found for t in c)
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for i, asked in wanted.items():
        scores = []
        for d, c in found:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(60)] + ["É", "ß9", "漢"])
    share = 1 / np.arange(1, len(words) + 1)
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 40), p=share / share.sum()))) for i in rng.permutation(400)]
    docs += [(500 + i, "W1, w2; w3") for i in range(70)] + [(3, "w1 w1 w62"), (3, "w1 w1 w62"), (None, "w7 w8"), (None, "w1 W2 w3"), (900, None), (901, ""), (902, "?!"), (903, "w5 " * 30_000)]
    items = [(i, " ".join(rng.choice(words, 6)) + " unknown") for i in range(12)] + [(20, "w1 w2 w3"), (21, None), (22, ""), (23, "nowhere"), (24, "w1"), (24, "w9 W9"), (None, "w4 É"), (25, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"k": 3}, {"block_terms": 20}])
def test_search_equals_brute_force(spark, table, how):
    docs, items = table
    df = spark.createDataFrame(docs, DOCS).repartition(3).withColumns({c: F.lit("x") for c in ("n", "at", "tf", "item_id", "score")})
    got = lexical.search(df, spark.createDataFrame(items, ITEMS).withColumn("rank", F.lit(1)), **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, how.get("k", 50))


def test_empty_tables(spark, table):
    docs, items = (spark.createDataFrame(t, s) for t, s in zip(table, (DOCS, ITEMS), strict=True))
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert [lexical.search(a, b).count() for a, b in ((none_d, items), (docs, none_i), (none_d, none_i), (docs.where("doc_id in (900, 901, 902)"), items))] == [0, 0, 0, 0]


def test_lists_are_left_early_and_parts_agree(monkeypatch):
    """One part or many, the best are those of a full sum; where one document holds rare terms, most documents are never scored."""
    rng = np.random.default_rng(12)
    n, vocabulary = 20_000, 50
    sizes = rng.integers(1, 8, n)
    sizes[:12] = 6
    lists = [np.sort(rng.choice(vocabulary, s, replace=False)) for s in sizes]
    lists[:12] = [np.arange(6)] * 12  # a few documents hold all of the first six terms
    at = np.concatenate(lists)
    tf = rng.integers(1, 5, len(at))
    tf[: 6 * 12] = 9
    length = rng.integers(10, 200, n)
    part = lexical.Part(length, sizes, at, tf, n, int(length.sum()), vocabulary)
    weights = rng.integers(1, 3000, vocabulary)
    scored = []
    plain_scores = part.scores
    monkeypatch.setattr(part, "scores", lambda docs: scored.append(len(docs)) or plain_scores(docs))
    for turn in range(20):
        asked = np.sort(rng.choice(vocabulary, 6, replace=False)) if turn else np.arange(6)
        scored.clear()
        d, s = part.best(asked, weights[asked], 10, 0)
        dense = np.zeros(vocabulary, np.int64)
        dense[asked] = weights[asked]
        full = np.add.reduceat(dense[at] * part.impact, part.starts[:-1])
        least = np.sort(full)[-10]
        assert sorted(d.tolist()) == np.flatnonzero(full >= least).tolist() and (full[d] == s).all()
        assert turn or sum(scored) < 0.3 * (full > 0).sum()
        assert not part.seen.any() and not part.asked.any()
