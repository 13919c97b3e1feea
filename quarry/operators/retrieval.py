"""Exact nearest neighbours over embeddings, with thresholds and metadata filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import discard, staged


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector is null, and no number for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2))), F.lit(0.0), lambda s, v: s + v))


#: Vectors of a region, about; regions at most; queries of a block.
REGION, REGIONS, BLOCK = 4096, 256, 512
#: What the order of sums may change in a distance.
SLACK = 1e-7


def points(vectors: DataFrame, metric: str) -> DataFrame:
    """(vec_id, point) in double precision: as they are, or for the cosine of length one. Vectors with nulls or no finite size go, for the cosine zero ones too."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, v: s + v * v))
    found = vectors.select("vec_id", wide.alias("wide"), size.alias("size")).where("size < double('Infinity') and not exists(wide, x -> x is null)")
    if metric == "cosine":
        return found.where("size > 0").select("vec_id", F.transform("wide", lambda x: x / F.col("size")).alias("point"))
    return found.select("vec_id", F.col("wide").alias("point"))


class Index:
    """Points by region, staged: each lies in the region of the nearest of at most REGIONS middles, which are points drawn by id.

    What the driver and the tasks hold of it is a row for each region: its middle,
    the nearest and farthest distance from it, and its size.
    """

    def __init__(self, vectors: DataFrame, metric: str = "cosine", region: int = REGION) -> None:
        self.metric, p = metric, staged(points(vectors, metric), "knn-points")
        self.vectors = vectors.select("vec_id", "embedding")
        self.n = p.count()
        drawn = p.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(min(REGIONS, 1 + self.n // region)).select("point").collect()
        middles = np.array([r["point"] for r in drawn])

        @F.pandas_udf("region int, away double")
        def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for x in batches:
                d = _distances(np.stack(x.to_numpy()), middles) if len(x) else np.zeros((0, 1))
                at = d.argmin(1)
                yield pd.DataFrame({"region": at.astype(np.int32), "away": d[np.arange(len(d)), at]})

        self.rows, self.table = None, None
        if self.n:
            # A region's points lie in pieces of bounded size.
            piece = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 + self.n // region)).alias("piece")
            self.rows = staged(p.withColumn("at", place("point")).select("vec_id", "point", "at.region", "at.away", piece), "knn-regions")
            found = self.rows.groupBy("region").agg(F.min("away").alias("near"), F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).orderBy("region").collect()
            self.table = (middles[[r["region"] for r in found]], np.array([(r["region"], r["near"], r["far"], r["n"]) for r in found]))
        discard(p)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def nearest(vectors: DataFrame | Index, queries: DataFrame, k: int, least: float | None = None, metric: str = "cosine") -> DataFrame:
    """(query_id, vec_id, score, rank): the k most alike for each query, by falling cosine of at least ``least``, or by rising distance; ties by vec_id.

    Exact, without all pairs. By the triangle inequality a query at distance d
    from a region's middle has none of its points nearer than d less the farthest
    there, or the nearest there less d. The regions of the least bounds that hold
    more than k points are asked first; of the others only those whose bound is
    not beyond the k-th distance found. Scores are compared as they are. No
    vector is a neighbour of its own id; vectors without a direction have none.
    """
    index = vectors if isinstance(vectors, Index) else Index(vectors, metric)
    q = staged(points(queries, index.metric).withColumnsRenamed({"vec_id": "query_id", "point": "query"}), "knn-queries")
    if not index.n:
        return _ranked(q.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).where("false"), k, index.metric)
    # A cosine of at least ``least`` is a distance of at most this between points of length one.
    limit = np.inf if least is None or index.metric != "cosine" else float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    first = staged(_measured(index, q, None, k, limit), "knn-first")
    best = first.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("away")), k - 1).alias("kth"))
    rest = _measured(index, q, best, k, limit)
    # The few that are left get their scores by the plain formula.
    near = first.unionByName(rest).select("query_id", "vec_id").join(index.vectors, "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id")
    scored = near.select("query_id", "vec_id", (cosine if index.metric == "cosine" else distance)(F.col("embedding"), F.col("query")).alias("score"))
    return _ranked(scored if least is None else scored.where(F.col("score") >= least), k, index.metric)


def _ranked(scored: DataFrame, k: int, metric: str) -> DataFrame:
    best = F.desc("score") if metric == "cosine" else F.asc("score")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(best, "vec_id"))).where(F.col("rank") <= k)


def asked(index: Index, q: DataFrame, best: DataFrame | None, k: int, limit: float) -> DataFrame:
    """(region, query_id, query): the first regions of each query without ``best``, with it the others that may hold a nearer point."""
    held = q.sparkSession.sparkContext.broadcast(index.table)  # at most REGIONS rows

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        middle, r = held.value
        for b in batches:
            if len(b):
                d = _distances(np.stack(b["query"].to_numpy()), middle)
                low = np.maximum(np.maximum(d - r[:, 2], r[:, 1] - d), 0) - SLACK
                order = np.argsort(low, axis=1, kind="stable")
                before = np.cumsum(r[order, 3], axis=1) - r[order, 3]
                first = np.zeros(low.shape, bool)
                np.put_along_axis(first, order, before <= k, 1)
                if "kth" in b:
                    first = ~first & (low <= b["kth"].fillna(np.inf).to_numpy()[:, None])
                i, j = np.nonzero(first & (low <= limit))
                yield pd.DataFrame({"region": r[j, 0].astype(np.int32), "query_id": b["query_id"].to_numpy()[i], "query": b["query"].to_numpy()[i]})

    return (q if best is None else q.join(best, "query_id", "left")).mapInPandas(ask, "region int, query_id long, query array<double>")


def _measured(index: Index, q: DataFrame, best: DataFrame | None, k: int, limit: float) -> DataFrame:
    """(query_id, vec_id, away): of each piece of a region asked, the points that may be among a query's k best."""
    asks = asked(index, q, best, k, limit)
    block = F.pmod(F.xxhash64("query_id"), F.lit(1 + q.count() // BLOCK))
    blocks = asks.groupBy("region", block.alias("block")).agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("query").alias("queries"))
    pieces = index.rows.groupBy("region", "piece").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("point").alias("points"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, x, query_ids, y in zip(batch["ids"], batch["points"], batch["query_ids"], batch["queries"], strict=True):
                d = _distances(np.stack(y), np.stack(x))
                d[np.asarray(query_ids)[:, None] == np.asarray(ids)] = np.inf
                if d.shape[1] > k:  # what ties with the k-th stays
                    d[d > np.partition(d, k - 1, axis=1)[:, k - 1 : k] + SLACK] = np.inf
                i, j = np.nonzero(d <= min(limit, 1e300))
                yield pd.DataFrame({"query_id": np.asarray(query_ids)[i], "vec_id": np.asarray(ids)[j], "away": d[i, j] + SLACK})

    return blocks.join(pieces, "region").select("ids", "points", "query_ids", "queries").mapInPandas(measure, "query_id long, vec_id long, away double")


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _knn(spark, d, k=2, least=None):
    v = _vectors(spark, d)
    return nearest(v, v.where("vec_id % 100 = 0"), k, least)


QUERIES = {
    "v01_knn": lambda spark, d: _knn(spark, d).select("query_id", "vec_id", "rank"),
    "v02_knn_threshold": lambda spark, d: _knn(spark, d, 250, 0.3).select("query_id", "vec_id", "rank"),
    "v03_knn_then_filter": lambda spark, d: _knn(spark, d, 20).join(_vectors(spark, d).where("label = 1").select("vec_id"), "vec_id").select("query_id", "vec_id", "rank"),
}

_SQL = "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, (list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))) AS score, v.label FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s{where}) SELECT query_id, vec_id, rank::INTEGER AS rank FROM r WHERE {keep}"
ORACLE = {
    "v01_knn": _SQL.format(where="", keep="rank <= 2"),
    "v02_knn_threshold": _SQL.format(where=" WHERE score >= 0.3", keep="rank <= 250"),
    "v03_knn_then_filter": _SQL.format(where="", keep="rank <= 20 AND label = 1"),
}
