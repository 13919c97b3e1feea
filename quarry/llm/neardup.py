"""Near-duplicate documents by DartMinHash signatures.

Darts are thrown at the rectangle (weight x rank) of every shingle of a text: a
hash of the shingle and of each unit cell gives the number of darts in that cell
and the place, rank and coordinate of each. A dart counts if it lands within the
shingle's weight and below a rank that leaves about k ln k + 2 k darts in all,
so the work is that of the shingles plus that of the signature, not their
product. The dart of least rank at each coordinate makes the signature.

Texts with equal words are one from the start. Signatures are cut into bands,
and texts that share a band are candidates. In each bucket members are compared
with a leader by exact Jaccard similarity, and links merge components. Texts of
buckets that are not of one component then (such as those that share a long
passage and little else) are dealt anew by their rarest shingles: two sets of the
needed similarity must share one of the rarest fifth of the longer's and one of
the rarest ninth of the shorter's, so texts that share only what is common never
meet. Those buckets go on with more leaders every round until every pair that can
be similar has been compared or is connected. So no link found by a band is lost,
and a bucket of thousands of copies costs a comparison each, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, short_batches, staged, table
from .components import components

WORDS, THRESHOLD, BANDS, ROWS, SEED = 5, 0.8, 20, 5, 1
REMEMBERED = 60_000
#: Keys of more rows than this meet their few partners by broadcast, of which there may be so many rows; beyond that by an ordinary join.
HOT, HOT_ROWS = 1000, 200_000
_U = np.uint64
_P = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_CDF = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _P[1]
    x = (x ^ (x >> _U(27))) * _P[2]
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS, seed: int = SEED) -> np.ndarray:
    """k values; each agrees between two weighted sets with probability near their weighted Jaccard similarity.

    elements: distinct 64-bit hashes, at least one; weights: positive, 1 each if not given.
    """
    w = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    aim = (k * math.log(k) + 2 * k) / w.sum()
    base = mix64(elements.astype(_U) * _P[0] + _U(seed))
    across = np.ceil(w).astype(np.int64)
    if weights is not None:
        base, w = np.repeat(base, across), np.repeat(w, across)
        cell = np.arange(len(base)) - np.repeat(across.cumsum() - across, across)
        base = mix64(base + cell.astype(_U) * _P[3])
        room = w - cell
    else:
        room = w
    while True:
        rows = math.ceil(aim)
        seeds = mix64(base[:, None] + np.arange(rows, dtype=_U) * _P[4]).ravel()
        n = np.searchsorted(_CDF, unit(seeds))
        has = np.flatnonzero(n)
        owner = np.repeat(has, n[has])
        which = np.arange(len(owner)) - np.repeat(n[has].cumsum() - n[has], n[has])
        dart = mix64(seeds[owner] + (which + 1).astype(_U) * _P[0])
        rank = owner % rows + unit(mix64(dart + _P[1]))
        hit = rank < aim
        if weights is not None:
            hit &= unit(mix64(dart + _P[2])) < room[owner // rows]
        dart, rank = dart[hit], rank[hit]
        late = np.argsort(-rank, kind="stable")
        dart = dart[late]
        at = (mix64(dart + _P[3]) % _U(k)).astype(np.int64)
        out, full = np.zeros(k, _U), np.zeros(k, bool)
        out[at], full[at] = dart, True  # the last to be written has the least rank
        if full.all():
            return out
        aim *= 2


def banded(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for every band, different from band to band."""
    x = np.arange(1, bands + 1, dtype=_U) * _P[3]
    for col in sig.reshape(bands, rows).T:
        x = mix64(x * _P[0] + col)
    return x.view(np.int64)


class Shingler:
    """The hashes of a text's runs of words; a memo of bounded size (a speed-up only) holds those of words."""

    def __init__(self, words: int = WORDS) -> None:
        import xxhash

        self.words, self.hash, self.known = words, xxhash.xxh3_64_digest, {}

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """A digest of all words in order, and the distinct shingles; a shorter text is one shingle, one without words has none."""
        import xxhash

        words = text.lower().split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.frombuffer(b"".join([known[w] for w in words]), _U)
        digest = xxhash.xxh3_128_digest(h.tobytes())
        if not len(h):
            return digest, h
        n = max(1, len(h) - self.words + 1)
        x = np.full(n, len(h) if len(h) < self.words else self.words, _U)
        for i in range(min(self.words, len(h))):
            x = mix64(x * _P[0] + h[i : i + n])
        return digest, np.unique(x)


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest of the words, and band keys; of rows with an id and a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                digest, x = shingle(text)
                out.append((doc_id, digest, banded(signature(x, k=bands * rows), bands, rows) if len(x) else []))
            yield pd.DataFrame(out, columns=["doc_id", "digest", "bands"])

    found = short_batches(docs).where("doc_id is not null and text is not null")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingles) of the given ids: their distinct shingles' low 32 bits, sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for batch in batches:
            sets = [np.unique(shingle(t)[1].astype(np.uint32)).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "shingles": sets})

    texts = short_batches(docs).where("text is not null").select(F.col("doc_id").cast("long").alias("node"), "text")
    return texts.join(ids.select("node").hint("shuffle_hash"), "node", "left_semi").mapInPandas(run, "node long, shingles binary")


def jaccard(a: str, b: str) -> Column:
    """Of two columns of shingles."""

    def one(x: bytes, y: bytes) -> float:
        p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        if min(len(p), len(q)) < 0.01 * max(len(p), len(q)):
            return min(len(p), len(q)) / max(len(p), len(q), 1)  # what it can be at most
        both = len(np.intersect1d(p, q, assume_unique=True))
        return both / (len(p) + len(q) - both)

    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(xs, ys, strict=True)])

    return run(a, b)


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The classes (a, b) that pairs of texts (p, q: structs of id and class so far) link."""
    x = sets.select(F.col("node").alias("x_id"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("y_id"), F.col("shingles").alias("y"))
    both = pairs.join(x, F.col("p.id") == F.col("x_id")).join(y, F.col("q.id") == F.col("y_id"))
    least = F.least(F.length("x"), F.length("y")) / F.greatest(F.length("x"), F.length("y"))
    return both.where(least >= threshold).where(jaccard("x", "y") >= threshold).select(F.col("p.label").alias("a"), F.col("q.label").alias("b"))


def _merged(label: DataFrame | None, step: DataFrame) -> DataFrame:
    """Labels of ids after a step that labelled labels."""
    if label is None:
        return step
    to = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = label.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return staged(moved.unionByName(step.join(label.select("node"), "node", "left_anti")), "labels")


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """left joined with right on key, where right has a column n, the rows that left has of the key.

    The rows of a frequent key stay where they are and their partners come to
    them, so that no task gets all of them.
    """
    hot = right.where(F.col("n") > HOT)
    rows = hot.count()
    if not 0 < rows <= HOT_ROWS:
        return left.join(right, "key")
    often = F.broadcast(hot)
    return left.join(often, "key").unionByName(left.join(F.broadcast(hot.select("key").distinct()), "key", "left_anti").join(right.where(F.col("n") <= HOT), "key"))


def rare_first(sets: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(key, node, size, at, short): a row for each shingle that may be the rarest one a similar pair shares.

    Shingles are ordered by how many of the nodes have them. ``short`` tells
    whether the shingle may be that of a pair's smaller set; keys without such a
    row or with one row only are left out. ``at`` is the shingle's place in the order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.frombuffer(x, np.int32) for x in batch["shingles"]]
            yield pd.DataFrame({"node": batch["node"], "size": [len(x) for x in found], "keys": found})

    some = sets.join(nodes.hint("shuffle_hash"), "node", "left_semi").mapInPandas(run, "node long, size int, keys array<int>")
    each = staged(some.select("node", "size", F.explode("keys").alias("key")), "rare-shingles")
    often = staged(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "rare-counts")
    # Shingles of one node alone come first and meet nothing; the others follow them.
    mine = beside(each, often).groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    room = lambda t: (F.col("size") - F.ceil(F.col("size") * F.lit(t) - F.lit(1e-9)) + 1).cast("int")
    alone = F.col("size") - F.size("shared")
    rows = mine.select("node", "size", alone.alias("alone"), room(2 * threshold / (1 + threshold)).alias("short"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(room(threshold) - alone, F.lit(0)))).alias("at", "x"))
    rows = staged(rows.select(F.col("x.key").cast("long").alias("key"), "node", "size", (F.col("alone") + F.col("at")).alias("at"), (F.col("alone") + F.col("at") < F.col("short")).alias("short")), "rare-first")
    useful = staged(rows.groupBy("key").agg(F.max("short").alias("s"), F.count(F.lit(1)).alias("n")).where("s and n > 1").select("key", "n"), "rare-keys")
    return beside(rows, useful)


def _relabelled(members: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return members if "label" in members.columns else members.withColumn("label", F.col("node"))
    return members.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets of several classes that still have a leader to offer."""
    open_ = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("short").alias("s"), F.count(F.lit(1)).alias("n"))
    open_ = staged(open_.where("x < y and s").select("key", "n"), "open")
    out = staged(beside(members.drop("n"), open_).select("key", "node", "label", "size", "at", "short", "n"), "members")
    discard(open_)
    return out


def _round(members: DataFrame, label: DataFrame | None, sets: DataFrame, threshold: float, leaders_each: int) -> tuple[DataFrame, DataFrame | None]:
    """Compare members with their buckets' leaders, the smaller sets of pairs; what is still open, and the labels."""
    part = F.pmod(F.xxhash64("node"), F.lit(leaders_each))
    one = F.struct(F.col("node").alias("id"), "label", "size", "at")
    lead = staged(members.where("short").groupBy("key", part.alias("part")).agg(F.min(one).alias("lead"), F.max("n").alias("n")).select("key", "lead", "n"), "leaders")
    # If this shingle is the first that a pair shares, the pair shares no more than what follows it.
    enough = F.expr("1 + least(size - at - 1, lead.size - lead.at - 1)") >= (F.expr("size + lead.size") * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    near = F.expr("label <> lead.label and size >= lead.size") & enough
    pairs = beside(members.drop("n"), lead).where(near).withColumn("member", one)
    new = staged(_linked(pairs.select(F.least("lead", "member").alias("p"), F.greatest("lead", "member").alias("q")).distinct(), sets, threshold), "links")
    if not new.isEmpty():
        label = _merged(label, components(new))
    used = lead.select("key", F.col("lead.id").alias("node"), F.lit(True).alias("used"))
    rest = members.join(used, ["key", "node"], "left").withColumn("short", F.col("short") & F.col("used").isNull()).drop("used")
    out = _open(_relabelled(rest, label))
    discard(lead, new, members)
    return out, label


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id): class_id is the least doc_id among the near copies.

    Rows with one doc_id are one document. A null text is no copy of anything; a
    row without doc_id has none to name its class by and gets a null class_id.
    Texts without words are exact copies of each other.
    """
    sigs = staged(signatures(docs, words, bands, rows), "signatures")
    reps = staged(sigs.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "representatives")
    keys = reps.select("node", F.explode("bands").alias("key"))
    buckets = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = staged(beside(keys, buckets).select("key", "node", F.col("node").alias("label"), F.lit(0).alias("size"), F.lit(0).alias("at"), F.lit(True).alias("short"), "n"), "members")
    sets = staged(shingle_sets(docs, members.select("node").distinct(), words), "shingles")
    members, label = _round(members, None, sets, threshold, 1)
    if not members.isEmpty():
        members = staged(_relabelled(rare_first(sets, members.select("node").distinct(), threshold), label), "rare")
        members, leaders_each = _open(members), 16
        while not members.isEmpty():
            # One leader for each bucket and class of ids; classes grow, so that rounds stay few.
            members, label = _round(members, label, sets, threshold, leaders_each)
            leaders_each *= 8
    if label is None:
        label = reps.select("node", F.col("node").alias("label")).limit(0)
    found = reps.select("digest", "node").join(label, "node", "left").select("digest", F.coalesce("label", "node").alias("class_id"))
    named = sigs.select("doc_id", "digest").join(found, "digest").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = staged(named, "classes")
    discard(sigs, reps, buckets, sets, members, label)
    return out


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept: one row for each row of documents."""
    docs = table(spark, sf_dir, "documents")
    found = classes(docs)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without near copies: of each class the rows with the class's id stay, one of those alike in id and text.

    Rows without doc_id or text stay. An empty table gives no rows.
    """
    key, digest = fresh(docs, "key", "digest")
    first = classes(docs, **how).where("doc_id = class_id").select(F.col("doc_id").alias(key))
    whole = docs.where("doc_id is not null and text is not null").join(first, F.col("doc_id") == F.col(key), "left_semi")
    whole = whole.withColumn(digest, F.md5("text")).dropDuplicates(["doc_id", digest]).drop(digest)
    return whole.unionByName(docs.where("doc_id is null or text is null"))
