"""Phrase mining against a plain count of all phrases, on blocks and tasks of any size and on hard inputs."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import phrases

DOCS = "lang string, text string"


def plain(docs, least, best=phrases.BEST):
    f, n = {}, Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            c.update(tuple(ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        text = {p: f" {' '.join(p)} " for p in found}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and text[p] in text[q] for q, b in found.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(7)
    words = np.array(["de", "la", "casa", "É", "B", "b", "x-y", "\x01z", "漢字", "o'k", "(a)", "tail"])
    share = 1 / np.arange(1, len(words) + 1)
    out = []
    for i in range(300):
        ws = rng.choice(words, rng.integers(1, 60), p=share / share.sum()).tolist()
        out.append((["en", "fr", None, "und"][i % 4], "".join(w + rng.choice([" ", "  ", "\t", ", ", ".\n", "\r", " \x0b"], p=[0.8, 0.05, 0.05, 0.04, 0.03, 0.02, 0.01]) for w in ws)))
    out += [("en", "the same old line again")] * 40 + [("fr", None), ("fr", ""), ("fr", " .,; \t"), ("de", "never often"), ("en", "go " * 4000)]
    return out


@pytest.mark.parametrize("how", [{}, {"block_words": 50}, {"common": 40}, {"common": 0}, {"best": 5}])
def test_mining_equals_a_plain_count(spark, docs, how, monkeypatch):
    monkeypatch.setattr(phrases, "ROW_TOKENS", 100)
    monkeypatch.setattr(phrases, "RANKED", 50)
    monkeypatch.setattr(phrases, "PART_BYTES", 10_000)
    df = spark.createDataFrame(docs, DOCS).repartition(3).withColumns({c: F.lit("x") for c in ("word", "n", "block", "a", "phrase", "words")})
    got = phrases.mine(df, least=6, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(docs, 6, how.get("best", phrases.BEST))


def test_phrases_longer_than_the_longest_and_overlaps(spark):
    rows = [("en", "one two three four five six seven")] * 7 + [("en", "ha ha ha ha ha ha")] * 3
    got = phrases.mine(spark.createDataFrame(rows, DOCS), least=5).collect()
    assert sorted(map(tuple, got)) == plain(rows, 5)
    assert "two three four five six" in {r["phrase"] for r in got}


def test_nothing_to_find(spark):
    for rows in ([], [("en", None)], [("en", "a b c")], [(None, "a. a. a.")]):
        assert phrases.mine(spark.createDataFrame(rows, DOCS), least=3).count() == 0


def test_scores_beyond_64_bits(spark):
    """Products of counts far over 64 bits divide exactly, and ties after flooring go to the first cut."""
    a, n = 3 * 10**11 + 7, 9 * 10**13 + 1
    found = spark.createDataFrame([([1, 2, 3], a, n, "en"), ([4, 5], 100, 10**15, "en")], "words array<long>, a long, n long, lang string")
    sizes = {(1,): a + 5, (2, 3): a + 9, (1, 2): a + 9, (3,): a + 5, (4,): 10**14, (5,): 10**12}
    counts = spark.createDataFrame([("en", [*k], v) for k, v in sizes.items()], "lang string, words array<long>, a long")
    got = {tuple(r["words"]): r for r in phrases.cut_scores(found, counts).collect()}
    assert got[1, 2, 3]["score"] == 1000 * a * n // ((a + 5) * (a + 9)) and (got[1, 2, 3]["l"], got[1, 2, 3]["r"]) == (a + 5, a + 9)
    assert got[4, 5]["score"] == 0
