"""Toxicity scores against a plain learner, on held-out rows and on hard inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, toxicity

SF = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def plain_features(text):
    """Words, neighbours and skips of a text with their values, by dictionaries."""
    low = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower())
    words = [zlib.crc32(w.encode()) for w in low.split(" ") if w]
    out = {}
    for gap in range(len(toxicity.MIX)):
        for i in range(len(words) - gap):
            if gap:
                x = (words[i] * toxicity.MIX[gap] + words[i + gap] * toxicity.SECOND) % 2**64
                x = (x ^ x >> 29) * toxicity.MIX[gap] % 2**64
            else:
                x = words[i] * toxicity.MIX[0] % 2**64
            out.setdefault(x >> (64 - toxicity.BITS), 1.0 if gap == 0 else toxicity.PAIR_VALUE)
    return out


class PlainLearner:
    def __init__(self):
        self.z, self.n = {}, {}

    def weight(self, i):
        z, n = self.z.get(i, 0.0), self.n.get(i, 0.0)
        if abs(z) <= toxicity.L1:
            return 0.0
        return -(z - np.copysign(toxicity.L1, z)) / ((toxicity.BETA + n**0.5) / toxicity.ALPHA + toxicity.L2)

    def score(self, x):
        return 1 / (1 + np.exp(-sum(self.weight(i) * v for i, v in x.items())))

    def learn(self, x, label):
        p = self.score(x)
        for i, v in x.items():
            g, n = (p - label) * v, self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - ((n + g * g) ** 0.5 - n**0.5) / toxicity.ALPHA * self.weight(i)
            self.n[i] = n + g * g


def test_learner_equals_a_plain_one(spark):
    rows = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()] + ["", "a", "b b B", "Çà ça!"]
    fast, plain, of = toxicity.Learner(), PlainLearner(), toxicity.Hasher()
    for k, text in enumerate(rows):
        h = of(text)
        at, x = toxicity.valued(toxicity.features(h), len(h))
        want = plain_features(text)
        assert dict(zip(at.tolist(), x.tolist(), strict=True)) == want
        fast.learn(at, x, k % 3 == 0)
        plain.learn(want | {1 << toxicity.BITS: 1.0}, k % 3 == 0)
    w = fast.weights()
    assert np.allclose(w[list(plain.z)], [plain.weight(i) for i in plain.z])
    assert set(np.flatnonzero(w)) == {i for i in plain.z if plain.weight(i)}


@pytest.fixture(scope="module")
def judged(spark):
    return {r["doc_id"]: r for r in toxicity.op11(spark, SF).collect()}


def test_query_equals_a_plain_version(spark, judged):
    """All of the query again on collected rows: the same examples in the same order, learned and scored without arrays."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels").where("crc32(cast(doc_id as string)) % 5 != 0")
    rows = toxicity.examples(docs, labels)
    assert rows.count() == labels.count()  # below the bound all teach
    turns = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(toxicity.EPOCHS)))).orderBy("epoch", F.xxhash64("draw", "epoch"), "label").collect()
    plain, bias = PlainLearner(), 1 << toxicity.BITS
    seen = {}
    for r in turns:
        x = seen.setdefault(r["text"], plain_features(r["text"]) | {bias: 1.0})
        plain.learn(x, r["label"])
    picked = sorted(judged)[::25]
    texts = {r["doc_id"]: r["text"] for r in docs.where(F.col("doc_id").isin(picked)).collect()}
    for i in picked:
        assert judged[i]["score"] == pytest.approx(plain.score(plain_features(texts[i]) | {bias: 1.0}), abs=1e-4)


def test_held_out_rows(spark, judged):
    assert len(judged) == 1000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in judged.items())
    held = [(r["toxic"], judged[r["doc_id"]]) for r in common.table(spark, SF, "labels").collect() if judged[r["doc_id"]]["held_out"]]
    bad, good = [x["score"] for y, x in held if y], [x["score"] for y, x in held if not y]
    assert sum(s >= 0.5 for s in good) == 0
    assert np.mean([b > g for b in bad for g in good]) > 0.85


def test_hard_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!! ..."), (4, "you idiot"), (4, "you idiot"), (None, "fine words"), (5, "idiot " * 50_000), (6, "fine words here"), (7, None), (9, "fine day"), (9, "Another text")]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("score", "label", "words", "draw")})
    labels = spark.createDataFrame([(4, 0, 1), (4, 0, 1), (5, 0, 1), (6, 1, 0), (6, 1, 1), (7, 0, 1), (None, 0, 1), (2, 1, None), (8, 0, 1), (9, 1, 0), (3, 1, 0)], LABELS)
    taught = toxicity.examples(df, labels).collect()
    assert sorted((r["text"][:12], r["label"]) for r in taught) == [("!!! ...", 0), ("Another text", 0), ("fine words h", 0), ("fine words h", 1), ("idiot idiot ", 1), ("you idiot", 1)]
    got = toxicity.scored(df, toxicity.fit(df, labels))
    assert got.columns == [*df.columns, "_score", "predicted"]
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r["_score"])
    assert by[1] == by[2] == by[3] == by[7] and by[4][0] == by[4][1] and len(by[9]) == 2
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert toxicity.scored(empty, toxicity.fit(df, labels)).count() == 0
    for d, x in ((df, none), (empty, labels), (empty, none)):
        assert {r["_score"] for r in toxicity.scored(df, toxicity.fit(d, x)).collect()} == {0.5}


def test_sample_is_bounded_and_odds_are_kept(spark):
    """A class over the bound is thinned by ids; an id that fills the table is one example; the constant makes up for it."""
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 10 = 0, 'plain bad', 'plain') as text").union(spark.range(3000).selectExpr("7L", "'plain again ' || id"))
    labels = docs.selectExpr("doc_id", "1 as quality", "if(doc_id % 10 = 0, 1, 0) as toxic")
    rows = toxicity.examples(docs, labels, sample_docs=200).collect()
    n = [sum(r["label"] == k for r in rows) for k in (0, 1)]
    assert 150 < n[0] < 250 and 150 < n[1] < 250
    mixed = spark.range(4000).selectExpr("id as doc_id", "'plain' as text", "1 as quality", "if(id % 10 = 0, 1, 0) as toxic")
    one = toxicity.scored(docs.limit(1).select("doc_id", F.lit("plain").alias("text")), toxicity.fit(mixed, mixed, sample_docs=400, l1=0.1)).first()["score"]
    assert 0.05 < one < 0.2
