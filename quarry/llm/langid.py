"""Language identification of whole texts and of spans within them.

A classifier over character n-grams of words (1 to 3 letters, with word ends)
is fitted on a bounded sample of labelled rows. To label a text, the scripts
that its letters come from narrow the candidate languages, every word gets a
score per candidate, and Viterbi with a penalty for each switch labels runs of
words. The text's language is the one that holds most letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, row_key, short_batches, table

#: Documented bound: about so many labelled documents a language, picked by a hash of their ids, fit the classifier.
SAMPLE_DOCS = 250
LONGEST_GRAM, SMOOTHING, SWITCH = 3, 0.5, 12.0
KEEP_SCORE = 0.5
#: Ranges of code points by script.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
)
_WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 150_000


def letter_runs(text: str) -> list[tuple[int, int]]:
    """Where runs of letters begin and end; fractions, raised digits and number letters are none."""
    out = []
    for m in _WORD.finditer(text):
        if m[0].isalpha():
            out.append(m.span())
            continue
        at = None
        for i, c in enumerate(m[0] + " ", m.start()):
            if c.isalpha():
                at = i if at is None else at
            elif at is not None:
                out.append((at, i))
                at = None
    return out


def words_of(text: str) -> list[str]:
    """The runs of letters of a text."""
    found = _WORD.findall(text)
    return found if all(map(str.isalpha, found)) else [text[a:b] for a, b in letter_runs(text)]


def script(letter: str) -> str:
    c = ord(letter)
    return next((name for name, lo, hi in SCRIPTS if lo <= c <= hi), "other")


def grams(word: str, longest: int = LONGEST_GRAM) -> list[str]:
    """The n-grams of a word between marks; of very long words all as well."""
    w = f"^{word}$"
    return [w[i : i + n] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


class Model(NamedTuple):
    langs: list[str]
    scripts: list[frozenset[str]]
    gram: dict[str, np.ndarray]
    unseen: np.ndarray


class Span(NamedTuple):
    start: int
    end: int
    lang: str


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a sample of labelled rows (lang not null) of about sample_docs a language; all rows of rarer languages.

    Without any labelled row the model has no languages and predicts ``und``.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    have = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not have:
        return Model([], [], {}, np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in have.items() for x in (k, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64(row_key("doc_id", F.col("text")), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = labelled.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                total.setdefault(lang, Counter()).update(words_of(text.lower()))
        for lang, words in total.items():
            counts, seen = Counter(), Counter()
            for w, n in words.items():
                for g in grams(w):
                    counts[g] += n
                for s in {script(c) for c in w}:
                    seen[s] += n
            keys = list(counts) + [f"script {s}" for s in seen]
            if keys:
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": [*counts.values(), *seen.values()]})

    rows = picked.mapInPandas(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).toPandas()
    # A language none of whose sampled texts has a letter teaches nothing, and is not predicted.
    is_script = rows["gram"].str.startswith("script ")
    langs = sorted(set(rows["lang"][~is_script]))
    if not langs:
        return Model([], [], {}, np.zeros(0))
    at = {x: i for i, x in enumerate(langs)}
    used: list[set[str]] = [set() for _ in langs]
    for lang, g in zip(rows["lang"][is_script], rows["gram"][is_script], strict=True):
        used[at[lang]].add(g.removeprefix("script "))
    rows = rows[~is_script]
    names, index = np.unique(rows["gram"].to_numpy(str), return_inverse=True)
    table_ = np.zeros((len(names), len(langs)))
    table_[index, [at[x] for x in rows["lang"]]] = rows["n"]
    total = table_.sum(0) + SMOOTHING * (len(names) + 1)
    scores = np.log((table_ + SMOOTHING) / total).astype(np.float32)
    return Model(langs, [frozenset(x) for x in used], dict(zip(names.tolist(), scores, strict=True)), np.log(SMOOTHING / total).astype(np.float32))


class Labeller:
    """Labels texts; a memo of bounded size (a speed-up only, cleared when full) holds the rows of words seen."""

    def __init__(self, model: Model, switch: float = SWITCH) -> None:
        self.m, self.switch = model, switch
        letters = sorted({c for g in model.gram for c in g})
        self.base = len(letters) + 2
        self.place = np.full(0x110000, len(letters) + 1, np.int64)  # one place for all letters that were never seen
        self.place[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        codes = np.array([self._code(g) for g in model.gram], np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.table = np.vstack([*model.gram.values(), model.unseen])[[*order, len(order)]] if model.langs else np.zeros((1, 0), np.float32)
        self.names = sorted({x for used in model.scripts for x in used})
        self.bit = {x: 1 << i for i, x in enumerate(self.names)}  # "other", if a language uses it, has its own
        self.bits = np.full(0x110000, self.bit.get("other", 1 << len(self.names)), np.int64)
        for name, lo, hi in reversed(SCRIPTS):
            self.bits[lo : hi + 1] = self.bit.get(name, 1 << len(self.names))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.masks, self.lengths = np.empty((1024, len(self.m.langs)), np.float32), np.empty(1024, np.int64), np.empty(1024)

    def _code(self, gram: str) -> int:
        out = 0
        for c in gram:
            out = out * self.base + int(self.place[ord(c)])
        return out

    def _of(self, codes: np.ndarray) -> np.ndarray:
        """The scores of n-grams by code."""
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        return self.table[np.where(self.codes[at] == codes, at, len(self.codes))]

    def _learn(self, words: list[str]) -> None:
        """Score new words: the mean log score of a word's n-grams times its letters."""
        marked = [f"^{w}$" for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        c = self.place[points]
        ends = lengths.cumsum()
        total, code = self._of(c), c
        for n in range(1, LONGEST_GRAM):  # at each letter, the n-gram that starts there, if its word is long enough
            code = code[:-1] * self.base + c[n:]
            inside = np.ones(len(c), bool)
            for k in range(1, n + 1):
                inside[ends - k] = False
            at = np.flatnonzero(inside[: len(code)])
            total[at] += self._of(code[at])
        grams_each = sum(np.maximum(lengths - n, 0) for n in range(LONGEST_GRAM))
        rows = np.add.reduceat(total, ends - lengths, axis=0) * ((lengths - 2) / grams_each)[:, None]
        first, last = len(self.known), len(self.known) + len(words)
        if last > len(self.rows):
            grow = max(last, 2 * len(self.rows))
            self.rows, self.masks, self.lengths = np.resize(self.rows, (grow, self.rows.shape[1])), np.resize(self.masks, grow), np.resize(self.lengths, grow)
        self.rows[first:last] = rows
        self.lengths[first:last] = lengths - 2
        bits = self.bits[points]
        bits[ends - 1] = bits[ends - lengths] = 0
        self.masks[first:last] = np.bitwise_or.reduceat(bits, ends - lengths)
        self.known.update(zip(words, range(first, last), strict=True))

    def ids(self, words: list[str]) -> np.ndarray:
        try:
            return np.array([self.known[w] for w in words])
        except KeyError:
            pass
        if len(self.known) > REMEMBERED:
            self._clear()
        new = list(set(words).difference(self.known))
        for i in range(0, len(new), 2000):
            self._learn(new[i : i + 2000])
        return np.array([self.known[w] for w in words])

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word.

        If no run of words gains more than one penalty over the best single
        language, even with free switches between the others, leaving that
        language never pays.
        """
        best = int(s.sum(0).argmax())
        rest = s.astype(np.float64)
        own = rest[:, best].copy()
        rest[:, best] = -np.inf
        upto = np.concatenate([[0.0], (rest.max(1) - own).cumsum()])
        if s.shape[1] == 1 or (upto - np.minimum.accumulate(upto)).max() <= self.switch:
            return np.full(len(s), best)
        rows = s.astype(np.float64).tolist()
        v, steps = rows[0], []
        for row in rows[1:]:
            steps.append(v)
            least = max(v) - self.switch
            v = [(x if x >= least else least) + y for x, y in zip(v, row)]  # noqa: B905
        at = v.index(max(v))
        out = [at]
        for v in reversed(steps):
            top = max(v)
            if v[at] < top - self.switch:
                at = v.index(top)
            out.append(at)
        return np.array(out[::-1])

    def label(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A language's index for every word, the candidates by script, and the words' scores for these."""
        used = int(np.bitwise_or.reduce(self.masks[ids]))
        hits = [i for i, x in enumerate(self.m.scripts) if any(self.bit[k] & used for k in x)] or list(range(len(self.m.langs)))
        candidates = np.asarray(hits)
        s = self.rows[ids][:, candidates]
        masks = self.masks[ids]
        for k, i in enumerate(hits):  # a language is far below for words of scripts that it never uses
            own = sum(self.bit[x] for x in self.m.scripts[i])
            if used & ~own:
                s[(masks & ~own) != 0, k] -= 50
        return candidates[self.path(s)], candidates, s

    def spans(self, text: str) -> list[Span]:
        """Runs of words of one language, with the places of their first and last letters."""
        places = letter_runs(text)
        if not places or not self.m.langs:
            return []
        labels, _, _ = self.label(self.ids([text[a:b].lower() for a, b in places]))
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        return [Span(places[a][0], places[b - 1][1], self.m.langs[labels[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def __call__(self, text: str | None) -> tuple[str, float, int]:
        """Language, score (its share of the letters, less doubt about which it is) and number of runs."""
        words = words_of((text or "").lower())
        if not words or not self.m.langs:
            return "und", 0.0, 0
        ids = self.ids(words)
        labels, candidates, s = self.label(ids)
        letters = np.bincount(labels, self.lengths[ids], len(self.m.langs))
        best = int(letters.argmax())
        total = s[labels == best].sum(0, dtype=float)
        odds = np.exp(np.clip(total - total.max(), -700, 0))
        sure = odds[candidates == best][0] / odds.sum()
        return self.m.langs[best], float(min(1.0, letters[best] / letters.sum() * sure)), int((np.diff(labels) != 0).sum()) + 1


def identify(docs: DataFrame, model: Model, **how) -> DataFrame:
    """docs' columns, then lang_pred, score and n_runs under names that docs leaves free; only the text decides.

    A null or empty text, or one without a letter, is ``und`` with score 0. Whole
    texts count, however long; rows that repeat are labelled alike; ties between
    languages go to the first by name. An empty table gives no rows.
    """
    pred, score, runs, every = fresh(docs, "lang_pred", "score", "n_runs", "found")
    # What is broadcast holds no class of this package, and its size is bounded by the sample's.
    blob = docs.sparkSession.sparkContext.broadcast(([*model.langs], [sorted(x) for x in model.scripts], model.gram, model.unseen))

    @F.pandas_udf("lang_pred string, score double, n_runs long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, scripts, gram, unseen = blob.value
        label = Labeller(Model(langs, [frozenset(x) for x in scripts], gram, unseen), **how)
        for texts in batches:
            yield pd.DataFrame([label(t) for t in texts], columns=["lang_pred", "score", "n_runs"])

    found = short_batches(docs).withColumn(every, run(F.col("text")))
    return found.withColumns({pred: F.col(f"{every}.lang_pred"), score: F.col(f"{every}.score"), runs: F.col(f"{every}.n_runs")}).drop(every)


def held_out(doc_id: str = "doc_id", mod: int = 3, rest: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == rest, F.lit(False))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id counts as not held out; ties between languages go to the first by name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    return identify(docs.drop("lang"), fit(docs.where("not held_out"))).select("doc_id", "held_out", "lang_pred", "score", "n_runs")


def keep_clear(docs: DataFrame, least: float = KEEP_SCORE) -> DataFrame:
    """The documents whose language is clear: not ``und``, and of that score at least. Columns stay as they are."""
    pred, score, runs = fresh(docs, "lang_pred", "score", "n_runs")
    return identify(docs, fit(docs)).where((F.col(pred) != "und") & (F.col(score) >= least)).drop(pred, score, runs)
