"""Scoring by a trigram model, with bigrams and unigrams below, kept in Elias-Fano tries.

The model is never on one machine. Documents are tokenized into blocks of a
bounded number of tokens. Level by level a block asks once for each distinct
n-gram, together with how often training documents of the block hold it, and
requests meet by hash of their context. For words the sums are the counts, and
each word gets a number. For bigrams and trigrams every part sums what it is
asked, builds a level of the trie (monotone pointers, quantised smoothed
probabilities), stores it, maps it into memory and looks the requests up in it.
A bigram's place in its part's trie is its number as a context of trigrams, so
that requests hold small rising numbers. Answers go back to the blocks, which
score their documents. What moves grows with the distinct n-grams of blocks,
and no part or broadcast holds a model. N-grams with a word or bigram that only
one block has stay in that block, in tries of its own. Contexts of many tokens
are spread over parts by their successors.

With c the counts in training documents and M the prior:
P(w) = (c(w) + 1) / (N + V + 1), P(w | v) = c(v w) / (c(v) + M) + M / (c(v) + M) * P(w),
P(w | u v) = c(u v w) / (c(u v) + M) + M / (c(u v) + M) * P(w | v); the first term of each is quantised.
A document's first word has an end as its context and no longer one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, discard, dropped, short_batches, staged, table
from .elias_fano import Trie, dequantise, quantise

#: Bytes of text for each part of the model, and tokens of a block.
PRIOR, BLOCK_TOKENS, PART_BYTES, LEAST_PARTS = 200.0, 3 << 19, 1 << 22, 64
#: A bigram's number is its part, then so many bits for its place there.
PLACE_BITS = 40
END = 0  # the hash of a document's end; also the context of its first word
_U = np.uint64
_PLACE = (1 << PLACE_BITS) - 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = "block long, part int, doc_ids binary, flags binary, lengths binary, tokens binary, hashes binary, counts binary"
_ANSWER = "block long, part int, codes binary, told binary, nodes binary, trie binary"


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, cut at ASCII white space."""
    return (text or "").encode().translate(_LOWER).split()


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal ranges of hashes, rising with them."""
    return ((hashes >> _U(40)) * _U(parts) >> _U(24)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 up, of as many bytes as the largest needs, by bytes, the lowest first, so that what is zero lies together."""
    import zstandard

    x = np.ascontiguousarray(x, "<i8")
    if not len(x):
        return b""
    n = max(1, -(-int(x.max()).bit_length() // 8))
    return bytes([n]) + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    if not blob:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : blob[0]] = raw.T
    return out.view("<i8").ravel()


def _slices(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of runs of a sorted array."""
    if len(parts):
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(parts[a]), a, b


def ordered(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, then the next ones, of numbers from 0 up: as one number where their bits fit into one."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    bits = [int(k.max()).bit_length() for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    one = keys[0].astype(np.int64)
    for k, n in zip(keys[1:], bits[1:], strict=True):
        one = one << n | k
    return np.argsort(one)


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def blocks(docs: DataFrame, held_out: Column, parts: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of documents (part -1: ids, flags, lengths, and tokens as places among the block's sorted hashes) and rows of these hashes with training counts by part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from array import array

        import xxhash
        from pyspark import TaskContext

        number, done = TaskContext.get().partitionId(), 0
        ids, held, lengths, tokens, known, hashes = [], [], [], array("i"), {}, [END]

        def emit() -> pd.DataFrame:
            h, n = np.array(hashes, _U), np.array(lengths)
            order = np.argsort(h, kind="stable")  # an end comes first, as it does in the block
            place = np.empty(len(h), np.int64)
            place[order] = np.arange(len(h))
            t, sorted_ = place[np.frombuffer(tokens, np.int32)], h[order]
            train = np.repeat(~np.array(held, bool), n)
            counts = np.bincount(t[train], minlength=len(h))
            null = np.array([i is None or i != i for i in ids])
            flags = np.array(held, np.uint8) | null.astype(np.uint8) << 1
            block = number << 24 | done
            rows = [(block, -1, np.array([0 if x else i for i, x in zip(ids, null, strict=True)], np.int64).tobytes(), flags.tobytes(), packed(n), packed(t), None, None)]
            rows += [(block, p, None, None, None, None, sorted_[a:b].tobytes(), packed(counts[a:b])) for p, a, b in _slices(part_of(sorted_, parts))]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for doc_id, text, out in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["held_out"].tolist(), strict=True):
                words = tokens_of(text)
                for w in set(words).difference(known):
                    known[w] = len(hashes)
                    hashes.append(xxhash.xxh3_64_intdigest(w) or 1)
                tokens.extend([known[w] for w in words])
                tokens.append(0)
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(words) + 1)
                if len(tokens) >= block_tokens:
                    yield emit()
                    done += 1
                    ids, held, lengths, tokens, known, hashes = [], [], [], array("i"), {}, [END]
        if ids:
            yield emit()

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out")).mapInPandas(run, _BLOCK)


def _count_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one part: for each block its words' counts over all blocks, doubled, and one more if no other block has the word, and the words' places in the part, the most frequent first; under block -1 tokens and distinct words."""
    part = int(rows["part"].iloc[0])
    hashes = [np.frombuffer(x, _U) for x in rows["hashes"]]
    names, of = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(of, np.concatenate([unpacked(x) for x in rows["counts"]]), len(names)).astype(np.int64)
    place = np.empty(len(names), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(names))
    ends = np.cumsum([len(h) for h in hashes])
    told = counts * 2 + (np.bincount(of) == 1)
    at = [of[e - len(h) : e] for h, e in zip(hashes, ends, strict=True)]
    out = [(b, part, packed(told[i]), packed(place[i]), 0, 0) for b, i in zip(rows["block"], at, strict=True)]
    out.append((-1, part, None, None, int(counts.sum()), int((counts > 0).sum())))
    return pd.DataFrame(out, columns=["block", "part", "told", "nodes", "n", "v"])


def _numbers(answers: pd.DataFrame, parts: int, rising: bool = False) -> np.ndarray:
    """The numbers of n-grams in the model: of words small ones for frequent ones, of bigrams, rising in a part, the part and their places there."""
    got = [p << PLACE_BITS | unpacked(x).cumsum() if rising else unpacked(x) * parts + p for p, x in zip(answers["part"], answers["nodes"], strict=True)]
    return np.concatenate(got) if got else np.zeros(0, np.int64)


class Level:
    """The distinct n-grams of a block at one level: contexts and words by number, and who answers for them.

    ``shared`` are those that other blocks may have too; they are asked for by
    part, context and word. ``own`` are those that only this block can have.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, seen: np.ndarray, before: np.ndarray, private: np.ndarray, hopeless: np.ndarray, number: np.ndarray, word_number: np.ndarray, parts: int, total: int) -> None:
        """context, word: in the block; before: the contexts' counts; number, word_number: of contexts and words in the model."""
        self.context, self.word, self.seen, self.before, self.private = context, word, seen, before, private
        which = np.flatnonzero(~private & ~hopeless)
        c, w = number[context[which]], word_number[word[which]]
        # A context goes to one part, or to as many more as its share of all tokens is of half a part.
        spread = 1 + before[which] * (2 * parts) // max(total, 1)
        if number is word_number:
            x = (c.astype(_U) ^ (w % spread).astype(_U) * _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
            p = part_of(x ^ (x >> _U(29)), parts)
        else:  # trigrams stay with their bigrams, whose numbers then lie close together
            p = ((c >> PLACE_BITS) + w % spread) % parts
        order = ordered(p, c >> PLACE_BITS, c & _PLACE, w)
        self.shared, self.parts, self.c, self.w = which[order], p[order], c[order], w[order]

    def requests(self, block: int) -> list[tuple]:
        rows = []
        for part, s, e in _slices(self.parts):
            c, w = self.c[s:e], self.w[s:e]
            first = _firsts(c)
            step = np.diff(w, prepend=0)
            step[first] = w[first]
            at = self.shared[s:e]
            rows.append((block, part, packed(np.diff(c[first], prepend=0)), packed(np.diff(np.append(first, e - s))), packed(self.before[at][first]), packed(step), packed(self.seen[at])))
        return rows

    def answered(self, answers: list[np.ndarray] | np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each n-gram what the parts say, in their order, or its own."""
        out = np.zeros(len(self.seen), np.int64)
        if len(self.shared):
            out[self.shared] = np.concatenate(answers) if isinstance(answers, list) else answers
        out[self.private] = own[self.private]
        return out

    def own_codes(self, prior: float) -> np.ndarray:
        out = np.zeros(len(self.seen), np.int64)
        own = np.flatnonzero(self.private)  # by context and word, as all n-grams of a level are
        out[own] = trie_of(self.context[own], self.word[own], self.seen[own], self.before[own], prior).mapped().lookup(self.context[own], self.word[own])
        return out


class Block:
    """A block's documents and n-grams; each level needs the answers to the one below."""

    def __init__(self, row: pd.Series, words: pd.DataFrame, parts: int, total: int) -> None:
        self.parts, self.total = parts, total
        words = words.sort_values("part")
        self.counts, self.number = np.concatenate([unpacked(x) for x in words["told"]]), _numbers(words, parts)
        alone, self.counts = (self.counts & 1).astype(bool), self.counts >> 1
        self.ids, flags = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["flags"], np.uint8)
        self.held, self.null = (flags & 1).astype(bool), (flags & 2).astype(bool)
        self.lengths, self.tokens = unpacked(row["lengths"]), unpacked(row["tokens"])
        self.starts = self.lengths.cumsum() - self.lengths
        self.train = np.repeat(~self.held, self.lengths)
        before = np.empty_like(self.tokens)
        before[0], before[1:] = 0, self.tokens[:-1]  # the token before a document's first is an end
        n = len(self.number)
        pairs, self.pair = np.unique(before * n + self.tokens, return_inverse=True)
        u, w = pairs // n, pairs % n
        seen = np.bincount(self.pair, self.train, len(pairs)).astype(np.int64)
        private = alone[u] | alone[w]
        self.two = Level(u, w, seen, self.counts[u], private, np.zeros(len(pairs), bool), self.number, self.number, parts, total)

    def trigrams(self, answers: pd.DataFrame) -> Level:
        """With the bigrams' answers: their counts, which are this block's alone, and their numbers."""
        two = self.two
        answers = answers.sort_values("part")
        told = two.answered([unpacked(x) for x in answers["told"]], two.seen * 2 + 1)
        nodes = two.answered(_numbers(answers, self.parts, True), np.zeros(len(two.seen), np.int64))
        alone, self.pair_counts = (told & 1).astype(bool), told >> 1
        inner = np.ones(len(self.tokens), bool)
        inner[self.starts] = False
        self.inner = np.flatnonzero(inner)
        n = len(self.number)
        keys, self.triple = np.unique(self.pair[self.inner - 1] * n + self.tokens[self.inner], return_inverse=True)
        context, w = keys // n, keys % n
        last = np.empty(len(keys), np.int64)
        last[self.triple] = self.pair[self.inner]
        seen = np.bincount(self.triple, self.train[self.inner], len(keys)).astype(np.int64)
        # Without the bigrams in training there is no such trigram in it.
        hopeless = (self.pair_counts[context] == 0) | (self.pair_counts[last] == 0)
        return Level(context, w, seen, self.pair_counts[context], alone[context] | alone[last], hopeless, nodes, self.number, self.parts, self.total)


def trie_of(context: np.ndarray, word: np.ndarray, seen: np.ndarray, before: np.ndarray, prior: float) -> Trie:
    """From sorted distinct n-grams with their counts and their contexts' counts; those never seen are left out."""
    has = seen > 0
    return Trie.build(context[has], word[has], quantise(seen[has] / (before[has] + prior)) if has.any() else np.zeros(0, np.uint16))


_REQUEST = "block long, part int, contexts binary, runs binary, totals binary, words binary, seen binary"


def _asked(parts: int, total: int, order: int):
    def ask(docs: pd.DataFrame, words: pd.DataFrame, pairs: pd.DataFrame | None = None) -> pd.DataFrame:
        b = Block(docs.iloc[0], words, parts, total)
        level = b.two if order == 2 else b.trigrams(pairs)
        return pd.DataFrame(level.requests(int(docs["block"].iloc[0])), columns=[c.split()[0] for c in _REQUEST.split(", ")])

    def both(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=[c.split()[0] for c in _REQUEST.split(", ")])
        return ask(docs, answers[answers["level"] == 1], answers[answers["level"] == 2])

    return both


def _answer(prior: float, order: int):
    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        cs, ws, seens, totals = [], [], [], []
        for r in rows.itertuples():
            runs, step = unpacked(r.runs), unpacked(r.words)
            first = runs.cumsum() - runs
            upto = step.cumsum()
            cs.append(np.repeat(unpacked(r.contexts).cumsum(), runs))
            ws.append(upto - np.repeat(upto[first] - step[first], runs))
            totals.append(np.repeat(unpacked(r.totals), runs))
            seens.append(unpacked(r.seen))
        part = int(rows["part"].iloc[0])
        ends = np.cumsum([len(c) for c in cs])
        c, w, seen, total = (np.concatenate(x) for x in (cs, ws, seens, totals))
        sorted_ = ordered(c >> PLACE_BITS, c & _PLACE, w)
        c, w, seen, total = c[sorted_], w[sorted_], seen[sorted_], total[sorted_]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        first = np.flatnonzero(new)
        of = np.empty(len(c), np.int64)
        of[sorted_] = new.cumsum() - 1
        counts = np.add.reduceat(seen, first)
        alone = np.diff(np.append(first, len(c))) == 1
        trie = trie_of(c[first], w[first], counts, total[first], prior).mapped()
        at = trie.find(c[first], w[first])
        codes = np.where(at >= 0, trie.codes[np.maximum(at, 0)], 0) if len(trie.codes) else np.zeros(len(at), np.int64)
        told, nodes = counts * 2 + alone, np.maximum.accumulate(np.maximum(at, 0))  # a place that rises: those never seen share one and are no contexts
        out = []
        for block, e, n in zip(rows["block"], ends, map(len, cs), strict=True):
            i = of[e - n : e]
            out.append((block, part, packed(codes[i]), packed(told[i]) if order == 2 else None, packed(np.diff(nodes[i], prepend=0)) if order == 2 else None, None))
        out.append((-1, part, None, None, None, trie.dump()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _ANSWER.split(", ")])

    return answer


def _scored(parts: int, total: int, distinct: int, prior: float):
    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"doc_id": pd.array([], "Int64"), "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []})
        by = {k: answers[answers["level"] == k] for k in (1, 2, 3)}
        b = Block(docs.iloc[0], by[1], parts, total)
        three = b.trigrams(by[2])
        two = b.two
        codes2, codes3 = (x.answered([unpacked(c) for c in by[k].sort_values("part")["codes"]], x.own_codes(prior)) for k, x in ((2, two), (3, three)))
        below = (b.counts + 1) / (total + distinct + 1)
        p = (dequantise(codes2) + prior / (two.before + prior) * below[two.word])[b.pair]
        longer = dequantise(codes3) + 0.0
        p[b.inner] = longer[b.triple] + (prior / (three.before + prior))[b.triple] * p[b.inner]

        def sums(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, b.starts)

        out = pd.DataFrame({"doc_id": pd.array(b.ids, "Int64"), "held_out": b.held, "n_tokens": b.lengths, "n_known": sums((b.counts[b.tokens] > 0).astype(np.int64)), "train_tokens": total, "base_score": sums(np.log10(below)[b.tokens]), "score": sums(np.log10(p))})
        out.loc[b.null, "doc_id"] = pd.NA
        return out

    return score


def _level(df: DataFrame, level: int) -> DataFrame:
    have = {"codes", "told", "nodes"} & set(df.columns)
    return df.where("block >= 0").select("block", "part", F.lit(level).alias("level"), *[F.col(c) if c in have else F.lit(None).cast("binary").alias(c) for c in ("codes", "told", "nodes")])


def fit_and_score(docs: DataFrame, held_out: Column, prior: float = PRIOR, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Scores of all documents, and the model: (level, part, trie), a stored trie for each part of the levels 2 and 3.

    A null or empty text has its end as its only token; texts of any length and
    rows that repeat are scored as they are, repeats counting in the model. A row
    without doc_id keeps a null one. Without training documents every score is the
    unknown word's. Columns but doc_id, text and those of held_out are not read.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    every = bucketed(blocks(docs, held_out, parts, block_tokens), "block", parts, "lm_blocks")
    texts = every.where("part < 0").select("block", "doc_ids", "flags", "lengths", "tokens")
    asked = every.where("part >= 0").select("block", "part", "hashes", "counts")
    words = staged(asked.groupBy("part").applyInPandas(_count_words, "block long, part int, told binary, nodes binary, n long, v long"), "lm-words")
    total, distinct = (int(x or 0) for x in words.where("block < 0").agg(F.sum("n"), F.sum("v")).first())
    known, answers = _level(words, 1), []
    for order in (2, 3):
        requests = texts.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_asked(parts, total, order), _REQUEST)
        answers.append(staged(requests.groupBy("part").applyInPandas(_answer(prior, order), _ANSWER), f"lm-{order}"))
        known = known.unionByName(_level(answers[-1], order))
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = staged(texts.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_scored(parts, total, distinct, prior), result), "lm-scores")
    model = None
    for order, part in zip((2, 3), answers, strict=True):
        level = part.where("block < 0").select(F.lit(order).alias("level"), "part", "trie")
        model = level if model is None else model.unionByName(level)
    dropped(every)
    discard(words)
    return scored, model


def scores(docs: DataFrame, held_out: Column, **how) -> DataFrame:
    return fit_and_score(docs, held_out, **how)[0]


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return scores(table(spark, sf_dir, "documents"), held)
