"""Best-fit packing of token sequences, planned on a histogram of lengths.

A length is at most the window, so best-fit decreasing runs over at most 1024
counts on the driver: whole runs of open sequences with equal room take whole
runs of equal pieces at once. The plan says for each length which ranks go to
which sequences at which offset. Pieces then take planned slots by their rank
within their length; the rank is counted in two levels (salt, row), so a length
that a third of all pieces share is never sorted in one task.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key, short_batches, staged, table, worker_state

WINDOW, END, SALTS, VOCABULARY = 1024, 2, 512, "byte_bpe_50k.json"
#: Fixed value: the vocabulary's pattern for cutting words, without backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to the tokenizer's own.

    A merge's rank is its id in this kind of vocabulary (checked on loading), so
    a ranked encoder over the same file gives the same ids, faster and without a
    memo. The tokenizer itself, loaded when first needed, takes the texts beyond
    Latin-1 (where two libraries may class a rare letter differently), those with
    the special token's string, and those whose runs of spaces are too long for
    the ranked encoder's pattern.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path) as f:
            stored = json.load(f)
        ids, letters = stored["model"]["vocab"], {c: b for b, c in byte_letters().items()}
        self.path, self.special, self.loaded = path, [t["content"] for t in stored["added_tokens"]], None
        ranks = {bytes(letters[c] for c in w): i for w, i in ids.items() if w not in self.special}
        merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in stored["model"]["merges"]]
        if merged != sorted(merged) or max((ranks[bytes([b])] for b in range(256)), default=0) >= min(merged, default=256):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        if self.loaded is None:
            self.loaded = Tokenizer.from_file(self.path)
        return np.asarray(self.loaded.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text).tobytes()
        try:
            text.encode("latin-1")
            ids = self.ranked.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            ids = self.whole(text)
        return ids.astype("<u4").tobytes()


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    kept = worker_state("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def cut(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, after a shorter first one if n is no multiple."""
    first = n % window or window
    return [(0, min(first, n))] + [(s, window) for s in range(first, n, window)]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, from its whole text.

    A null or empty text is the end id alone; a text of any length is cut into
    as many pieces as it needs; rows that repeat give their pieces again; other
    columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        encode, last = encoder(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary), np.asarray([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = encode(text or "") + last
                rows += [(doc_id, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, window))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(kind))


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, offset).

    ``open_`` holds runs of sequences by room; ``rooms`` the rooms that have any.
    """
    out: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    new = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not open_.get(room):
                insort(rooms, room)
            open_.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
                take = min(n, left)
                put(room, first + take, n - take)
            else:
                room, first = window, new
                take = n = min(left, -(-left // (window // length)))
                new += take
            out.append((length, rank, take, first, window - room))
            put(room - length, first, take)
            rank, left = rank + take, left - take
    return out


def pack(p: DataFrame, window: int = WINDOW, salts: int = SALTS) -> DataFrame:
    """Add sequence_id and offset to pieces.

    Ranks within a length go by salt, then by doc_id and piece; pieces alike in
    those and in their ids are interchangeable. No piece gives no rows.
    """
    spark = p.sparkSession
    p = p.withColumn("salt", F.pmod(F.xxhash64(row_key("doc_id", F.col("ids_crc32")), "piece"), F.lit(salts)).cast("int"))
    n = p.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    base = n.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    # A row for each length, at most `window` in all, comes to the driver.
    counts = {r["length"]: r["n"] for r in n.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = pd.DataFrame(plan(counts, window), columns=["length", "rank", "ranks", "sequence", "offset"]).astype("int64")
    by_length = planned.groupby("length").agg(list).reset_index() if len(planned) else planned
    slots = spark.createDataFrame(by_length, "length long, rank array<long>, ranks array<long>, sequence array<long>, offset array<long>")
    at = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    p = p.withColumn("at", at).join(base, ["length", "salt"]).withColumn("at", F.col("at") + F.col("base"))
    # The plan's runs of one length lie in one row: a piece finds its own among them, and no row is multiplied.
    p = p.join(F.broadcast(slots), "length")
    run = F.expr("size(filter(rank, r -> r <= at)) - 1")
    p = p.withColumn("run", run).withColumns({"sequence_id": F.expr("sequence[run] + at - rank[run]"), "place": F.expr("offset[run]")})
    return p.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("place").alias("offset"))


def best_fit(docs: DataFrame, **how) -> DataFrame:
    return pack(staged(pieces(docs, **how), "pieces"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
