"""Ranked lexical search by the threshold algorithm.

Documents become a forward index of the terms that the items ask for. In each
part of it, a term's list is sorted by impact, and an item reads its terms' lists
from the top in turn, a block each round. Every document that a list shows for
the first time is scored whole from the forward index. No document that is still
unseen can score more than the impacts at the current depths together; once this
threshold lies strictly below the k-th best score so far, the lists are left. The
best of all parts meet by item.

All scores are whole numbers, so the result is exact and the same in any layout.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, short_batches, staged, table

BEST = 50
#: Pairs of item and term that are asked at once; more are asked in blocks of items.
BLOCK_TERMS = 500_000
#: Postings of one part's lists, and entries that a list shows in the first round; later rounds double.
PART_POSTINGS, FIRST_ROUND = 2_000_000, 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded() -> bytes:
    """A table for UTF-8 bytes: A-Z to a-z, other ASCII bytes than letters and digits to spaces."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once. Rows of one item_id are one item; a null item_id is one; a null text has no term."""
    low = F.translate("text", UPPER, LOWER)
    return items.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def forward(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, at, tf): every document's number of terms, and which of ``terms`` it holds how often, by their places."""
    blob = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    @F.pandas_udf("n long, at array<int>, tf array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        place, plain = blob.value, folded()
        for texts in batches:
            rows = []
            for text in texts:
                words = (text or "").encode("utf-8", "replace").translate(plain).split()
                have = Counter(words)
                asked = sorted((place[w], have[w]) for w in have.keys() & place.keys())
                rows.append((len(words), [a for a, _ in asked], [n for _, n in asked]))
            yield pd.DataFrame(rows, columns=["n", "at", "tf"])

    return short_batches(docs).select("doc_id", run("text").alias("found")).select("doc_id", "found.*")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Part:
    """Lists sorted by impact, and a forward index, of some documents."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, at: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int, vocabulary: int) -> None:
        m = 50 + 50 * n * n_docs // max(1, n_terms)
        self.starts = np.concatenate([[0], sizes.cumsum()])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.at, self.impact = at, 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        order = np.lexsort((doc, -self.impact, at))
        self.listed, self.listed_impact = doc[order], self.impact[order]
        self.lists = np.searchsorted(at[order], np.arange(vocabulary + 1))
        self.asked = np.zeros(vocabulary, np.int64)
        self.seen = np.zeros(len(sizes), bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Random access: whole scores of documents for the weights in ``asked``."""
        n = self.starts[docs + 1] - self.starts[docs]
        ends = n.cumsum()
        every = np.arange(ends[-1] if len(n) else 0) + np.repeat(self.starts[docs] - (ends - n), n)
        sums = np.concatenate([[0], (self.asked[self.at[every]] * self.impact[every]).cumsum()])
        return sums[ends] - sums[ends - n]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, first: int = FIRST_ROUND) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the k highest scores, ties at the k-th kept, and these scores; what scores below ``floor`` may be missing."""
        some = (weights > 0) & (self.lists[terms + 1] > self.lists[terms])
        terms, weights = terms[some], weights[some]
        self.asked[terms] = weights
        depth, ends, step = self.lists[terms], self.lists[terms + 1], first
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = []
        while len(terms):
            upto = np.minimum(depth + step, ends)
            shown = np.unique(np.concatenate([self.listed[a:b] for a, b in zip(depth.tolist(), upto.tolist(), strict=True)]))
            new = shown[~self.seen[shown]]
            self.seen[new] = True
            seen.append(new)
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new)])
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                high = scores >= floor
                docs, scores = docs[high], scores[high]
            # The impact shown last bounds what a list still hides; a list at its end hides nothing.
            threshold = int((weights * np.where(upto < ends, self.listed_impact[upto - 1], 0)).sum())
            if threshold < floor or (upto == ends).all():
                break
            depth, step = upto, 2 * step
        self.asked[terms] = 0
        for x in seen:
            self.seen[x] = False
        high = (scores >= floor) & (scores > 0)
        return docs[high], scores[high]


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by doc_id, null last.

    Every row of docs is a document of its own: a null or empty text, or one
    without a term, is never found and counts in no figure; rows that repeat are
    all ranked; texts count whole, however long; other columns are not read.
    An item without a term, and an empty table on either side, give no rows.
    """
    wanted = staged(item_terms(items), "items")
    blocks = 1 + wanted.count() // block_terms
    block = F.pmod(F.xxhash64("item_id", F.lit(5)), F.lit(blocks))
    out = [_search_block(docs, wanted.where(block == b), k) for b in range(blocks)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _search_block(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    # About block_terms pairs, or one item's: the terms come to the driver, and go to all tasks.
    rows = wanted.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
    names = sorted({t for r in rows for t in r["terms"]})
    place = {t: i for i, t in enumerate(names)}
    index = staged(forward(docs, names), "forward")
    n_docs, n_terms = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for r in index.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each term asked
        df[r["at"]] = r["df"]
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    blob = spark.sparkContext.broadcast(([np.array(sorted(place[t] for t in r["terms"])) for r in rows], weights, n_docs, n_terms))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, w, docs_, terms_ = blob.value
        held: list = [None] * len(asked)  # the best of all parts so far: ids, whether null, scores
        for ids, null, n, sizes, at, tf in _parts(batches):
            part = Part(n, sizes, at, tf, docs_, terms_, len(w))
            for i, terms in enumerate(asked):
                old = held[i]
                floor = int(old[2][-1]) if old is not None and len(old[2]) == k else 0
                d, s = part.best(terms, w[terms], k, floor)
                if len(d):
                    held[i] = _top((ids[d], null[d], s), old, k)
        for i, x in enumerate(held):
            if x is not None:
                yield pd.DataFrame({"item": i, "id": x[0], "lost": x[1], "score": x[2]})

    lists = index.where("size(at) > 0").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("lost"), "n", "at", "tf")
    best = lists.mapInPandas(run, "item int, id long, lost boolean, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "lost", "id"))
    # At most k rows a task and item meet here.
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
    doc_id = F.when(~F.col("lost"), F.col("id")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    found = staged(best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score"), "ranked")
    discard(index)
    return found


def _top(new: tuple, old: tuple | None, k: int) -> tuple:
    """The k best of new and old, equal scores by id, null last."""
    ids, null, scores = new if old is None else (np.concatenate(x) for x in zip(new, old, strict=True))
    order = np.lexsort((ids, null, -scores))[:k]
    return ids[order], null[order], scores[order]


def _parts(batches: Iterator[pd.DataFrame], postings: int = PART_POSTINGS) -> Iterator[tuple]:
    """Batches of the forward index joined until they hold so many postings."""
    held, n = [], 0

    def joined() -> tuple:
        b = pd.concat(held, ignore_index=True)
        flat = [np.concatenate(b[c].to_list()).astype(np.int64) for c in ("at", "tf")]
        return b["id"].to_numpy(np.int64), b["lost"].to_numpy(bool), b["n"].to_numpy(np.int64), b["at"].map(len).to_numpy(np.int64), *flat

    for batch in batches:
        if len(batch):
            held.append(batch)
            n += int(batch["at"].map(len).sum())
        if n >= postings:
            yield joined()
            held, n = [], 0
    if held:
        yield joined()


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ws FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM d) GROUP BY row, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
a AS (SELECT count(*) FILTER (len(ws) > 0) AS n, sum(len(ws))::BIGINT AS l FROM d),
s AS (SELECT q.item_id, t.row, sum(floor(1000 * ln((2 * a.n + 2)::DOUBLE / (2 * f.df + 1)))::BIGINT
        * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * len(d.ws) * a.n) // a.l))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (row) CROSS JOIN a GROUP BY q.item_id, t.row),
r AS (SELECT s.item_id, d.doc_id, s.score, row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id) AS rank FROM s JOIN d USING (row) WHERE s.score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {BEST}
"""
