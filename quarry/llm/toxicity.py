"""Toxicity scores by FTRL-proximal logistic regression over hashed words.

A text's features are the hashes of its words, of pairs of neighbours and of
pairs with one or two words between them; a feature counts once a text, pairs
less than words, so that length does not thin out a single insult. Each coordinate has its own learning
rate, and the L1 part keeps the weight of a coordinate at exactly zero until its
gradients add up to more than ``L1``: few weights remain, and these travel to
every task.

The learner goes through examples one after another, so it runs in one task over
a sample of bounded size; scoring covers all texts where they lie.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, short_batches, staged, table, worker_state

#: Documented bound: about so many labelled documents a class, picked by a hash of their ids, fit the model.
SAMPLE_DOCS = 8192
BITS, EPOCHS, PAIR_VALUE = 22, 3, 0.3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.0
#: Odd multipliers that keep words, neighbours and skips of one and two words apart.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
SECOND = 0xD6E8FEB86659FD93
REMEMBERED = 400_000


def separators() -> bytes:
    """A table that turns every ASCII byte but letters and digits into a space."""
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Hasher:
    """32-bit hashes of a text's words in order; a memo of bounded size (a speed-up only) holds those of words seen."""

    def __init__(self) -> None:
        self.known, self.plain = {}, separators()

    def __call__(self, text: str) -> np.ndarray:
        found = text.lower().encode("utf-8", "replace").translate(self.plain).split()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(found).difference(known):
            known[w] = zlib.crc32(w)
        return np.array([known[w] for w in found], np.uint32)


def features(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Feature numbers below 2**bits: those of the words come first."""
    h = words.astype(np.uint64)
    parts = [h * np.uint64(MIX[0])]
    for gap in range(1, len(MIX)):
        x = h[:-gap] * np.uint64(MIX[gap]) + h[gap:] * np.uint64(SECOND)
        parts.append((x ^ (x >> np.uint64(29))) * np.uint64(MIX[gap]))
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def valued(found: np.ndarray, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Features without repeats, and their values; ``words`` says which are words, or how many come first."""
    pair = np.arange(len(found)) >= words if isinstance(words, int) else ~words
    both = np.sort(found * 2 + pair)
    both = both[np.diff(both >> 1, prepend=-1) != 0]
    return both >> 1, np.where(both & 1, PAIR_VALUE, 1.0)


class Learner:
    """FTRL-proximal: sums of gradients ``z``, of their squares ``n``; weights follow from both. The last coordinate is always on."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w, n = self.weights(at), self.n[at]
        g = (probability(w @ x) - label) * x
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -700, 700))))


def examples(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, label, share, draw): a sample of the labelled documents, about sample_docs a class, all of a rarer one.

    A null label is none; labels that repeat count once, and an id under both
    labels teaches both. Of several texts under one id the least teaches, so an
    id that fills the table is still one example. Ids of labels without a
    document, or with a null text, teach nothing. ``share`` is the part of the
    class that was taken.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    have = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, min(1.0, sample_docs / max(1, have.get(k, 0))))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = known.withColumns({"draw": draw, "share": share[F.col("label")]}).where("draw < share")
    # At most about 2 * sample_docs rows of four numbers.
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id", "label", "draw", "share").agg(F.min("text").alias("text")).select("text", "label", "share", "draw")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, bits: int = BITS, epochs: int = EPOCHS, **how) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates whose weight is not zero, and these weights; at most 2**bits + 1 of them.

    The classes are sampled apart, which shifts the odds of all examples alike;
    the constant takes that back. Without examples no weight is left, and every
    score is one half.
    """

    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Hasher()
        for batch in texts:
            yield pd.Series([of(t).tobytes() for t in batch], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learner, share = Learner(bits, **how), {0: 1.0, 1: 1.0}
        for batch in batches:
            for words, label in zip(batch["words"], batch["label"], strict=True):
                h = np.frombuffer(words, np.uint32)
                learner.learn(*valued(features(h, bits), len(h)), label)
            share |= dict(zip(batch["label"], batch["share"], strict=True))
        w = learner.weights()
        w[-1] += np.log(share[0] / share[1])
        at = np.flatnonzero(w)
        for i in range(0, len(at), 1 << 16):
            yield pd.DataFrame({"at": at[i : i + (1 << 16)], "w": w[at[i : i + (1 << 16)]]})

    words = F.pandas_udf(hashed, "binary")
    sample = staged(short_batches(examples(docs, labels, sample_docs)).select(words("text").alias("words"), "label", "share", "draw"), "toxicity")
    # Every epoch has an order of its own, which depends on the ids alone.
    turns = sample.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("turn", F.xxhash64("draw", "epoch"))
    rows = turns.repartition(1).sortWithinPartitions("epoch", "turn", "label").select("words", "label", "share").mapInPandas(run, "at long, w double").toPandas()
    return rows["at"].to_numpy(np.int64), rows["w"].to_numpy(np.float64)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """docs' columns, then score and predicted under names that docs leaves free; only the text decides.

    A null text counts as an empty one, whose score is that of the constant
    alone. Whole texts count, however long; rows that repeat score alike; a score
    of just one half is predicted 1. An empty table gives no rows.
    """
    score, predicted = fresh(docs, "score", "predicted")
    blob = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits + 1 weights

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept = worker_state("toxicity")
        if kept.get("of") is not blob.value:
            at, w = blob.value
            dense = np.zeros((1 << bits) + 1, np.float32)
            dense[at] = w
            kept.update(of=blob.value, dense=dense, hasher=Hasher())
        dense, hasher = kept["dense"], kept["hasher"]
        for texts in batches:
            out = []
            for t in texts:
                h = hasher(t or "")
                f = features(h, bits)
                some = np.flatnonzero(dense[f])
                f, x = valued(f[some], some < len(h))
                out.append(probability(float(dense[f] @ x + dense[-1])))
            yield pd.Series(out, dtype="float64")

    return short_batches(docs).withColumn(score, run(F.col("text"))).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id counts as not held out, and has no label."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out())
    return scored(docs.withColumn("held_out", held_out()), fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")
