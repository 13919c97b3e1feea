"""Phrase collocations by growing frequent prefixes to the right.

Texts become blocks of word numbers, each with a dictionary of its own. What a
block holds is counted within it before anything moves: its words, then its pairs
of frequent words. The counts travel in one message from each block to each part
of all words or pairs; a part adds them up and answers each block which of its
own are frequent overall. A frequent pair is a prefix, and each place where it
begins an occurrence pointer: the window of up to five words that begins there
and ends before the first pair that is not frequent. Equal windows of a block are
counted together and dealt out by prefix; the prefix's task sorts its windows and
grows it to the right, depth first, as long as it stays frequent. Windows of a
prefix that is too common for one task are grown in their blocks instead, and
what they grow to is dealt out and added up by whole phrase.

Words are told apart by their text and a number that each frequent word of a
language gets once, never by a hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, short_batches, staged, table

LEAST, LONGEST, BEST = 100, 5, 2000
#: Words of a block, tokens of a stored row of it, bytes of text for each part of all words and pairs,
#: occurrences of a prefix that one task grows, candidates ranked together.
BLOCK_WORDS, ROW_TOKENS, PART_BYTES, COMMON, RANKED = 2_000_000, 250_000, 16 << 20, 500_000, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = b"\xff"  # no byte of UTF-8


def folded() -> bytes:
    """A table for UTF-8 bytes: A-Z to a-z, what ends a piece to BREAK, tabs to spaces."""
    ends = b".,;:!?\x0a\x0b\x0c\x0d"
    return bytes(b + 32 if 65 <= b <= 90 else BREAK[0] if b in ends else 32 if b == 9 else b for b in range(256))


class Numbers(dict):
    """Numbers for words in the order they come; BREAK is 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(a: np.ndarray, kind: str = "<i4") -> bytes:
    """Whole numbers as bytes: all lowest bytes first, then the next, compressed."""
    a = np.ascontiguousarray(a, kind)
    return zlib.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unpacked(b: bytes, kind: str = "<i4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zlib.decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def rising(a: np.ndarray) -> bytes:
    """As packed, for 64-bit numbers that rise: their differences."""
    return packed(np.diff(a, prepend=0), "<i8")


def risen(b: bytes) -> np.ndarray:
    return unpacked(b, "<i8").cumsum()


def _rows(tokens: np.ndarray, words: np.ndarray, same: dict) -> list[dict]:
    """A block's tokens in rows of bounded size; part -1 tells them from messages."""
    out = []
    for k, at in enumerate(range(0, len(tokens), ROW_TOKENS)):
        row = slice(at, at + ROW_TOKENS)
        out.append({**same, "part": -1, "number": k, "n": int(words[row].sum()), "names": None, "data": packed(tokens[row])})
    return out


STORED = "block string, lang string, part int, number int, n long, names binary, data binary"
COLUMNS = [c.split()[0] for c in STORED.split(", ")]


def blocks(docs: DataFrame, parts: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks as rows of STORED: their tokens by number of word (0 ends a piece), and a message for each part with words, their numbers and counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain, held, words, turn = folded(), {}, 0, 0
        task = TaskContext.get().partitionId()

        def flush() -> Iterator[pd.DataFrame]:
            for i, (lang, (numbers, texts)) in enumerate(held.items()):
                tokens, names = np.concatenate(texts), list(numbers)
                n = np.bincount(tokens, minlength=len(names))
                n[0] = n.max() + 1
                order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which pack well
                place = np.empty(len(names), np.int32)
                place[order] = np.arange(len(names))
                names, n, tokens = [names[j] for j in order.tolist()], n[order], place[tokens]
                same = {"block": f"{task}-{turn}-{i}", "lang": lang}
                out = _rows(tokens, tokens > 0, same)
                part = np.array([zlib.crc32(w) % parts for w in names])
                part[0] = -1
                for p in np.unique(part[1:]).tolist():
                    own = np.flatnonzero(part == p)
                    out.append({**same, "part": p, "number": 0, "n": len(own), "names": zlib.compress(b"\n".join(names[j] for j in own.tolist()), 1), "data": packed(np.concatenate([own, n[own]]))})
                yield pd.DataFrame(out, columns=COLUMNS, dtype=object)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found = text.encode("utf-8", "replace").translate(plain).replace(BREAK, b" \xff ").split()
                numbers, texts = held.setdefault(lang, (Numbers(), []))
                texts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                texts.append(np.zeros(1, np.int32))
                words += len(found)
                if words >= block_words:
                    yield from flush()
                    words, turn = 0, turn + 1
        yield from flush()

    texts = short_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    return texts.mapInPandas(run, STORED)


def counted_words(messages: DataFrame, parts: int, least: int) -> DataFrame:
    """Frequent words (lang, id, word, f), and answers (lang, block, numbers, ids) which of a block's words these are. Ids are a language's own."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = [zlib.decompress(x).split(b"\n") for x in rows["names"]]
        data = [unpacked(x).reshape(2, -1) for x in rows["data"]]
        code, word = pd.factorize(np.array([w for x in names for w in x], object))
        n = np.zeros(len(word), np.int64)
        np.add.at(n, code, np.concatenate([x[1] for x in data]))
        often = np.flatnonzero(n >= least)
        ids = np.full(len(word), -1)
        ids[often] = key[1] + parts * np.arange(len(often))
        if len(often) and ids.max() >= 1 << 31:
            raise ValueError("more than 2**31 numbers for the frequent words of a language")
        out = [{"id": int(ids[i]), "word": word[i].decode("utf-8", "replace"), "f": int(n[i])} for i in often.tolist()]
        at = 0
        for block, x in zip(rows["block"], data, strict=True):
            own = ids[code[at : at + x.shape[1]]]
            at += x.shape[1]
            if (own >= 0).any():
                out.append({"block": block, "numbers": packed(x[0][own >= 0]), "ids": packed(own[own >= 0])})
        return pd.DataFrame([{"lang": key[0], **r} for r in out], columns=["lang", "id", "word", "f", "block", "numbers", "ids"], dtype=object)

    return messages.groupBy("lang", "part").applyInPandas(run, "lang string, id int, word string, f long, block string, numbers binary, ids binary")


def _tokens(rows: pd.DataFrame) -> np.ndarray:
    return np.concatenate([unpacked(x) for x in rows.sort_values("number")["data"]])


def pairs(texts: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Blocks again, as rows of STORED: tokens by id, where one -1 stands for all between frequent words, and a message for each part with pairs and counts."""

    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(answers):
            return pd.DataFrame(columns=COLUMNS, dtype=object)
        tokens = _tokens(own)
        ids = np.full(int(tokens.max()) + 1, -1, np.int64)
        for numbers, found in zip(answers["numbers"], answers["ids"], strict=True):
            ids[unpacked(numbers)] = unpacked(found)
        tokens = ids[tokens]
        tokens = tokens[(tokens >= 0) | (np.roll(tokens, 1) >= 0)]
        same = {"block": own["block"].iloc[0], "lang": own["lang"].iloc[0]}
        out = _rows(tokens, tokens >= 0, same)
        pair, n = np.unique(_pairs(tokens), return_counts=True)
        pair, n = (pair[1:], n[1:]) if len(pair) and pair[0] < 0 else (pair, n)
        part = _part(pair, parts)
        for p in np.unique(part).tolist():
            out.append({**same, "part": p, "number": 0, "n": int((part == p).sum()), "names": rising(pair[part == p]), "data": packed(n[part == p])})
        return pd.DataFrame(out, columns=COLUMNS, dtype=object)

    return texts.groupBy("block").cogroup(answers.groupBy("home")).applyInPandas(run, STORED)


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Both ids of neighbours as one number; -1 where either is no frequent word."""
    return np.where((tokens[:-1] >= 0) & (tokens[1:] >= 0), tokens[:-1] << 32 | tokens[1:], -1)


def _part(pair: np.ndarray, parts: int) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def counted_pairs(messages: DataFrame, least: int, common: int = COMMON) -> DataFrame:
    """Frequent pairs (lang, one, two, a), and answers (home, often, hot) which of a block's pairs these are, and which have more than ``common`` occurrences."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = [risen(x) for x in rows["names"]]
        pair, code = np.unique(np.concatenate(own), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, code, np.concatenate([unpacked(x) for x in rows["data"]]))
        kept = np.flatnonzero(n >= least)
        out = [{"lang": key[0], "one": p >> 32, "two": p & 0xFFFFFFFF, "a": a} for p, a in zip(pair[kept].tolist(), n[kept].tolist(), strict=True)]
        ends = np.cumsum([len(x) for x in own])
        for block, x, end in zip(rows["block"], own, ends.tolist(), strict=True):
            total = n[code[end - len(x) : end]]
            often = total >= least
            if often.any():
                out.append({"home": block, "often": rising(x[often]), "hot": packed(total[often] > common, "u1")})
        return pd.DataFrame(out, columns=["lang", "one", "two", "a", "home", "often", "hot"], dtype=object)

    return messages.groupBy("lang", "part").applyInPandas(run, "lang string, one int, two int, a long, home string, often binary, hot binary")


def _sums(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted and without repeats, with the sums of their counts."""
    order = np.lexsort(w.T[::-1])
    w, n = w[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], np.any(w[1:] != w[:-1], axis=1)])) if len(w) else np.zeros(0, np.int64)
    return w[new], np.add.reduceat(n, new) if len(new) else n


def _grown(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All phrases of three words and more at the beginning of sorted windows; in sorted rows a prefix is one run."""
    out = []
    for k in range(3, LONGEST + 1):
        some = w[:, k - 1] >= 0
        head = np.where(np.arange(LONGEST) < k, w[some], -1)
        out.append(_sums(head, n[some]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def pointers(texts: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """(lang, part, whole, data, counts): each block's windows of three words and more, dealt by their first two, or grown and dealt whole where that pair is common."""
    columns = ["lang", "part", "whole", "data", "counts"]

    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(answers):
            return pd.DataFrame(columns=columns, dtype=object)
        tokens = _tokens(own).astype(np.int64)
        often = np.concatenate([risen(x) for x in answers["often"]])
        hot = np.concatenate([unpacked(x, "u1") for x in answers["hot"]])
        order = np.argsort(often)
        often, hot = often[order], hot[order] > 0
        pair = _pairs(tokens)
        at = np.minimum(np.searchsorted(often, pair), len(often) - 1)
        goes_on = np.concatenate([often[at] == pair, np.zeros(LONGEST, bool)])
        first = np.flatnonzero(goes_on[:-1] & goes_on[1:])
        more = np.concatenate([tokens, np.full(LONGEST, -1)])
        w, alive = [more[first], more[first + 1]], np.ones(len(first), bool)
        for k in range(1, LONGEST - 1):
            alive = alive & goes_on[first + k]
            w.append(np.where(alive, more[first + k + 1], -1))
        w, n = _sums(np.stack(w, axis=1), np.ones(len(first), np.int64))
        common = hot[np.searchsorted(often, w[:, 0] << 32 | w[:, 1])]
        out = []
        for whole, (x, m) in ((False, (w[~common], n[~common])), (True, _grown(w[common], n[common]))):
            mix = x[:, 0] << 32 | x[:, 1]
            for c in range(2, LONGEST if whole else 2):
                mix = (mix ^ (mix >> 29)) * 0x2545F4914F6CDD1D + x[:, c]
            part = _part(mix, parts)
            for p in np.unique(part).tolist():
                mine = part == p
                out.append((own["lang"].iloc[0], p, whole, packed(x[mine].T.ravel()), packed(m[mine])))
        return pd.DataFrame(out, columns=columns, dtype=object)

    return texts.groupBy("block").cogroup(answers.groupBy("home")).applyInPandas(run, "lang string, part int, whole boolean, data binary, counts binary")


def grow(rows: np.ndarray, n: np.ndarray, depth: int, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """All frequent phrases that extend the first ``depth`` words, which all of the sorted rows share."""
    total = np.concatenate([[0], n.cumsum()])
    todo = [(0, len(rows), depth)]
    while todo:  # depth first: what lies deeper is on top
        a, b, k = todo.pop()
        count = int(total[b] - total[a])
        if count < least:
            continue
        if k > depth:
            yield tuple(rows[a, :k].tolist()), count
        if k < rows.shape[1]:
            word = rows[a:b, k]
            cuts = [a, *(np.flatnonzero(np.diff(word)) + a + 1).tolist(), b]
            todo += [(x, y, k + 1) for x, y in zip(cuts, cuts[1:], strict=False) if rows[x, k] >= 0]


def phrases(messages: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, a): the frequent phrases of three words and more."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, n = _sums(np.concatenate([unpacked(x).reshape(LONGEST, -1).T for x in rows["data"]]), np.concatenate([unpacked(x) for x in rows["counts"]]).astype(np.int64))
        if key[2]:
            found = [(tuple(x[x >= 0].tolist()), a) for x, a in zip(w[n >= least], n[n >= least].tolist(), strict=True)]
        else:
            cuts = [0, *(np.flatnonzero(np.any(w[1:, :2] != w[:-1, :2], axis=1)) + 1).tolist(), len(w)]
            found = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in grow(w[a:b], n[a:b], 2, least)]
        return pd.DataFrame([(key[0], list(x), a) for x, a in found], columns=["lang", "words", "a"], dtype=object)

    return messages.groupBy("lang", "part", "whole").applyInPandas(run, "lang string, words array<int>, a long")


def cut_scores(found: DataFrame, counts: DataFrame) -> DataFrame:
    """found with l, r and score of each phrase's lowest-scoring cut; ``counts`` has (lang, words, a) of all parts, n that of the language."""
    size = F.size("words")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, size)})
    cuts = cuts.join(counts.select("lang", F.col("words").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("words").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    wide = "decimal(38,0)"
    score = F.expr(f"cast((cast(1000 as {wide}) * cast(a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide})) as long)")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "words", "a", "n").agg(least).select("lang", "words", "a", "n", "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, least: int = LEAST, best: int = BEST, block_words: int = BLOCK_WORDS, common: int = COMMON) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best collocations.

    A null lang is ``und``, together with documents that have that lang. A null
    or empty text has no words; texts count whole, however long; rows that repeat
    count again; other columns are not read. Ties in score go by a, then by the
    phrase's bytes. An empty table, or one without a frequent pair, gives no rows.
    """
    parts = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    store = staged(blocks(docs, parts, block_words), "phrase-blocks")
    texts = store.where("part = -1").select("block", "lang", "number", "data")
    totals = store.where("part = -1").groupBy("lang").agg(F.sum("n").alias("n"))
    words = staged(counted_words(store.where("part >= 0").select("lang", "part", "block", "names", "data"), parts, least), "phrase-words")
    frequent = words.where("word is not null").select("lang", "id", "word", "f")
    paired = staged(pairs(texts, words.where("word is null").select(F.col("block").alias("home"), "numbers", "ids"), parts), "phrase-pairs")
    often = staged(counted_pairs(paired.where("part >= 0").select("lang", "part", "block", "names", "data"), least, common), "phrase-often")
    answers = often.where("home is not null").select("home", "often", "hot")
    dealt = pointers(paired.where("part = -1").select("block", "lang", "number", "data"), answers, parts)
    two = often.where("home is null").select("lang", F.array("one", "two").alias("words"), "a")
    c = staged(phrases(dealt, least).unionByName(two), "phrases")
    discard(paired, often)
    counts = c.select("lang", "words", "a").unionByName(frequent.select("lang", F.array("id").alias("words"), F.col("f").alias("a")))
    # A phrase inside a longer one that is as frequent lies in one of just one word more that is, too.
    inner = c.where(F.size("words") > 2).select("lang", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), "a").distinct()
    own = c.join(inner, ["lang", "words", "a"], "left_anti").join(totals, "lang")
    scored = staged(cut_scores(own, counts), "phrase-scores")
    place = scored.select("lang", "words", F.posexplode("words").alias("i", "id")).join(frequent.select("lang", "id", "word"), ["lang", "id"])
    named = place.groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("x")).select("lang", "words", F.concat_ws(" ", F.transform("x", lambda x: x["word"])).alias("phrase"))
    rows = scored.join(named, ["lang", "words"])
    salts = 1 + scored.count() // RANKED
    order = (F.col("score").desc(), F.col("a").desc(), "phrase")
    # The best of each salt first: a language's candidates are never sorted in one task.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(salts)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= best)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    out = staged(rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(store, words, c, scored)
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) s(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1),
d AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
u AS (SELECT d.lang, d.k, d.phrase, d.a, j, string_split(d.phrase, ' ') AS ws FROM d, (VALUES (1), (2), (3), (4)) s(j) WHERE j < d.k),
x AS (SELECT u.lang, u.phrase, u.a, u.j, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * u.a * t.n) // (l.a::HUGEINT * r.a) AS score
      FROM u JOIN t ON t.lang = u.lang
      JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1:u.j], ' ') AND l.k = u.j
      JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[u.j + 1:], ' ') AND r.k = u.k - u.j),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM x),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM m WHERE cut = 1)
SELECT * FROM o WHERE rank <= {BEST}
"""
