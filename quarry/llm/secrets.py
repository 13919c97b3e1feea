"""Secret scans by assignment-aware lexing.

Each text is lexed into pairs of a name and an expression of literals and
references: assignments and keyword arguments of programs, keys of JSON, YAML,
INI and shell files, command-line flags, calls of setters, XML elements and the
user part of URLs. A value in brackets, a list, a call or a text over several
lines stands for all its string literals, but not for keys that it looks up. References and concatenations are followed to the literals
they stand for, and each literal is scored by the most sensitive name that it
reaches and by its own form. Three plain patterns run beside, as a base that
the method only adds to.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table

# The base's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "literal")

#: Points of the words of a name; a pair of words counts like one.
NAMES = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "pass": 2, "secret": 3, "token": 2, "apikey": 3, "api key": 3, "access key": 3, "private key": 3, "secret key": 3, "auth key": 3, "encryption key": 3, "signing key": 3, "credential": 2, "credentials": 2, "auth": 1, "authorization": 2, "bearer": 2, "connection string": 2, "key": 1, "salt": 1}
BENIGN = {"file": -2, "path": -2, "dir": -2, "name": -2, "url": -1, "uri": -1, "length": -3, "count": -3, "max": -3, "min": -3, "limit": -3, "type": -2, "public": -3, "field": -2, "label": -2, "hint": -3, "prompt": -3, "regex": -3, "pattern": -3, "header": -2, "primary": -2, "foreign": -2, "size": -3, "expiry": -3, "ttl": -3, "index": -2, "sort": -3}
PLACEHOLDER = re.compile(r"[\W_xX]*|<.*>|\$?\{.*\}|%.*%|(?:null|none|true|false|undefined|string|required|optional)", re.IGNORECASE | re.DOTALL)
#: A value all of whose words are of FILLER, one of MARKS among them, is a placeholder too.
MARKS = frozenset("change changeme example sample placeholder your xxx xxxx dummy".split())
FILLER = MARKS | frozenset("me my the a api key apikey token secret password passwd access auth user value here test insert enter text com org".split())
#: Names whose values may be phrases, and words that tell a sentence from one.
PHRASES = frozenset(("password", "passwd", "pwd", "passphrase", "pass phrase", "mnemonic"))
SENTENCE = frozenset("the a an is are be was must should can cannot not of your you please enter at least to for with or and if this that".split())
LEAST, THRESHOLD = 6, 4.0

_OP = re.compile(r"[:=]")
_NAME = r"[A-Za-z_$][\w$.-]*"
_LEFT = re.compile(rf"""(?:(?P<bare>{_NAME})|(?P<quote>["'])(?P<quoted>[^"'\n]+)(?P=quote)|\[[ \t]*["'](?P<item>[^"'\n]+)["'][ \t]*\])(?P<kind>[ \t]*:[ \t]*[A-Za-z_][\w.\[\]<>]*)?[ \t]*$""")
_TERM = re.compile(rf"""[ \t]*(?:[bBrRfFuUL@]{{0,2}}(?:"(?P<double>(?:[^"\\\n]|\\.)*)"|'(?P<single>(?:[^'\\\n]|\\.)*)'|`(?P<back>[^`\n]*)`)|\$\{{(?P<brace>\w+)[^}}\n]*\}}|\$(?P<dollar>\w+)|(?P<ref>{_NAME})(?=[ \t]*(?:[+;,)\]}}\n]|$))|(?P<bare>[^\s"'`,;)\]}}]+))""")
_JOIN = re.compile(r"[ \t]*(?:\+|&)(?:\s|\\\r?\n)*(?=[\"'`$A-Za-z_(\[])|[ \t]*\.\.?[ \t]*(?=[\"'`$A-Za-z_])|[^\S\n]*\n\s*(?:\+|&|\.\.?)[ \t]*(?=[\"'`])|[ \t]*(?:\\\r?\n[ \t]*)?(?=[\"'])")
_SKIP = re.compile(r"(?:[ \t]|\\\r?\n)*(?:\r?\n\s*(?=[bBrRfFuUL@]{0,2}[\"'`]|[(\[{]))?")
_OPEN = re.compile(r"(?:new[ \t]+|await[ \t]+)*(?:\[\])?(?:[A-Za-z_$][\w$.:]*(?:<[^>\n]*>)?(?:\[\])?!?)?[ \t]*(?P<open>[(\[{])")
_CHAIN = re.compile(r"\s*\.[ \t]*(?=[A-Za-z_]\w*\()")
_TOKEN = re.compile(r"""[bBrRfFuUL@]{0,2}(?:\"{3}(?P<d3>.*?)\"{3}|(?<!\w')'{3}(?P<s3>.*?)'{3}|"(?P<d>(?:[^"\\\n]|\\.)*)"|(?<![A-Za-z0-9]{3}')(?:(?<=\W)|(?<=\b[bBrRfFuUL])|^)'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`\n]*)`)|(?P<open>[(\[{])|(?P<close>[)\]}])""", re.DOTALL)
_TRIPLE = re.compile(r"""[bBrRfFuU]{0,2}(?P<mark>\"{3}|'{3})(?P<value>.*?)(?P=mark)""", re.DOTALL)
_KEYED = re.compile(r"(?:\b(?:get\w*|\w*env\w*|fetch\w*|lookup\w*|read\w*|open|require|input|prompt)\(|\w\[)\s*[bBrRfFuU]{0,2}$", re.IGNORECASE)
_INNER = re.compile(r"""([A-Za-z_][\w-]*)["']?\s*(?::|=>?)\s*[bBrRfFuU]{0,2}$""")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?\d?[ \t]*\r?\n")
_NEXT = re.compile(r"""[ \t]*\r?\n[ \t]+(?P<value>(?=\S*\d)[^\s"'`:{}\[\](),;]+)[ \t]*(?=\r?\n|$)""")
_PHRASE = re.compile(r"[ \t]*(?P<value>(?:[A-Za-z]+[ \t-]+){3,}[A-Za-z]+)[ \t]*(?=[\r\n#;]|$)")
_CALL = re.compile(r"""\b(?P<name>[A-Za-z_]\w*)\([ \t]*(?P<quote>["'])(?P<value>[^"'\n]+)(?P=quote)""")
_FLAG = re.compile(r"""(?<!\S)--?(?P<name>[A-Za-z][\w-]+)[ \t]+["']?(?P<value>[^\s"']+)""")
_XML = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*)>(?P<value>[^<\n]+)</")
_URL = re.compile(r"://[^\s/:@]+:(?P<value>[^\s/@]+)@")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How far back a name is looked for at first; one that may begin earlier is followed to its beginning.
REACH = 256


class Pair(NamedTuple):
    name: str
    literals: tuple[tuple[int, int], ...]
    refs: tuple[str, ...]


class Span(NamedTuple):
    """``inner`` is what to hide: the value in an assignment, else the whole span."""

    kind: str
    start: int
    end: int
    inner: tuple[int, int]


class Brackets:
    """A text's string literals, and where each bracket closes. One without its other half is passed over."""

    def __init__(self, text: str) -> None:
        self.text, self.close, self.strings = text, {}, []
        stack: list[int] = []
        open_ = Counter()
        for m in _TOKEN.finditer(text):
            if m.lastgroup == "open":
                stack.append(m.start())
                open_[m[0]] += 1
            elif m.lastgroup == "close":
                want = "([{"[")]}".index(m[0])]
                while open_[want]:
                    at = stack.pop()
                    open_[text[at]] -= 1
                    if text[at] == want:
                        self.close[at] = m.start()
                        break
            else:
                self.strings.append((m.start(), *m.span(m.lastgroup)))
        self.starts = [x[0] for x in self.strings]

    def any_in(self, a: int, b: int) -> bool:
        return bisect_left(self.starts, b) > bisect_left(self.starts, a)

    def values(self, ranges: set[tuple[int, int]]) -> list[Pair]:
        """A pair for each range: the literals in it that no range within it holds, and references to those next within it.

        Ranges lie within each other or apart, so one pass over ranges and
        literals finds the innermost range of each. Keys of look-ups and objects
        and values of harmless names are left out.
        """
        order = sorted(ranges, key=lambda r: (r[0], -r[1]))
        own: dict[tuple[int, int], list[tuple[int, int]]] = {r: [] for r in order}
        within: dict[tuple[int, int], list[str]] = {r: [] for r in order}
        held: list[tuple[int, int]] = []
        k = 0
        for start, i, j in self.strings:
            while k < len(order) and order[k][0] <= start:
                while held and held[-1][1] <= order[k][0]:
                    held.pop()
                if held:
                    within[held[-1]].append(bracket_name(*order[k]))
                held.append(order[k])
                k += 1
            while held and held[-1][1] <= start:
                held.pop()
            if not held:
                continue
            before = self.text[max(held[-1][0] - 32, start - 64, 0) : start]
            inner = _INNER.search(before)
            if not _KEYED.search(before) and not _COLON.match(self.text, j) and not (inner and name_score(inner[1]) < 0):
                own[held[-1]] += _lines(self.text, i, j)
        return [Pair(bracket_name(*r), tuple(own[r]), tuple(within[r])) for r in order]


def bracket_name(a: int, b: int) -> str:
    """What stands for a bracket among names; it has no word in it, and so no score of its own."""
    return f"\0{a}:{b}"


_COLON = re.compile(r"""["'`]\s*(?::|=>)""")


def _lines(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The span, or where it has several lines those of each, without space around."""
    if "\n" not in text[a:b]:
        return [(a, b)]
    return [(a + m.start(), a + m.end()) for m in re.finditer(r"\S(?:[^\n]*\S)?", text[a:b])]


def phrase_like(name: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(name)]
    return not PHRASES.isdisjoint(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])


def _indented(text: str, i: int, at: int) -> list[tuple[int, int]]:
    """The lines from a place on that are indented deeper than the line of i."""
    head = text[text.rfind("\n", 0, i) + 1 : i]
    depth, out = len(head) - len(head.lstrip()), []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip():
            if len(line) - len(line.lstrip()) <= depth:
                break
            out.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
        at = end + 1
    return out


def _left_name(text: str, line: int, i: int) -> str | None:
    """The name that ends before the sign at i, in the line that begins at line: bare, quoted, or a quoted item, however long."""
    end = i
    while end > line and text[end - 1] in " \t":
        end -= 1
    item = end > line and text[end - 1] == "]"
    close = end - 1 if item else end
    while item and close > line and text[close - 1] in " \t":
        close -= 1
    if close > line and text[close - 1] in "\"'":
        quote, other = text[close - 1], "'" if text[close - 1] == '"' else '"'
        start = text.rfind(quote, line, close - 1)
        if start < 0 or start + 1 == close - 1 or text.find(other, start, close - 1) >= 0:
            return None
        if item:
            before = start
            while before > line and text[before - 1] in " \t":
                before -= 1
            if before == line or text[before - 1] != "[":
                return None
        return text[start + 1 : close - 1]
    reach = REACH
    while True:
        start = max(line, i - reach)
        m = _LEFT.search(text, start, i)
        if not m or start == line or m.start() > start:
            return m and (m["bare"] or m["quoted"] or m["item"])
        reach *= 4


def pairs(text: str) -> list[Pair]:
    """The name-literal pairs of a text, in order."""
    out: list[Pair] = []
    brackets, ranges = None, set()
    line = last = 0
    for m in _OP.finditer(text):
        i, j = m.start(), m.end()
        line = text.rfind("\n", last, i) + 1 or line
        last = i
        before, after = text[i - 1 : i], text[j : j + 1]
        if m[0] == "=" and (before in "=!<>~+*/%^|&" and before or after == "=") or m[0] == ":" and (before == ":" or after == ":" or text.startswith("//", j)):
            continue
        if m[0] == ":" and after == "=":
            j += 1
        elif m[0] == "=" and after == ">":
            j += 1
        elif m[0] == "=" and before == ":":
            continue
        name = _left_name(text, line, i)
        if not name:
            continue
        literals, refs, at = [], [], j
        if m[0] == ":" and (block := _BLOCK.match(text, j)):
            literals += _indented(text, i, block.end())
        elif m[0] == ":" and (below := _NEXT.match(text, j)):
            literals.append(below.span("value"))
        elif phrase_like(name) and (phrase := _PHRASE.match(text, j)):
            literals.append(phrase.span("value"))
        at = _SKIP.match(text, j).end()
        while True:
            here = _SKIP.match(text, at).end() if at != j else at
            if triple := _TRIPLE.match(text, here):
                literals += _lines(text, *triple.span("value"))
                more = _JOIN.match(text, triple.end())
                if not more:
                    break
                at = more.end()
                continue
            if head := _OPEN.match(text, here):
                brackets = brackets or Brackets(text)
                end = brackets.close.get(head.start("open"))
                if end and brackets.any_in(here, end):
                    ranges.add((here, end))
                    refs.append(bracket_name(here, end))
                    more = _CHAIN.match(text, end + 1) or _JOIN.match(text, end + 1)
                    if not more:
                        break
                    at = more.end()
                    continue
            chained = at != j and text[at - 1 : at] == "."
            term = None if chained else _TERM.match(text, at)
            if not term:
                break
            kind = term.lastgroup
            if kind in ("double", "single", "back"):
                literals.append(term.span(kind))
            elif kind in ("brace", "dollar"):
                refs.append(term[kind])
            elif kind == "ref":
                refs.append(term[kind])
                # In configuration files a bare word is a literal too.
                literals.append(term.span(kind))
            else:
                literals.append(term.span(kind))
            more = kind != "bare" and _JOIN.match(text, term.end())
            if not more:
                break
            at = more.end()
        if literals or refs:
            out.append(Pair(name, tuple(literals), tuple(refs)))
    if ranges:
        out += brackets.values(ranges)
    if "(" in text:
        out += [Pair(m["name"], (m.span("value"),), ()) for m in _CALL.finditer(text) if name_score(m["name"]) > 0]
    if "-" in text:
        out += [Pair(m["name"], (m.span("value"),), ()) for m in _FLAG.finditer(text) if name_score(m["name"]) > 0]
    if "</" in text:
        out += [Pair(m["name"], (m.span("value"),), ()) for m in _XML.finditer(text)]
    if "://" in text:
        out += [Pair("password", (m.span("value"),), ()) for m in _URL.finditer(text)]
    return out


def name_score(name: str) -> int:
    words = [w.lower() for w in _WORDS.findall(name)]
    both = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return max((NAMES.get(w, 0) for w in both), default=0) + min((BENIGN.get(w, 0) for w in words), default=0)


def placeholder(value: str) -> bool:
    words = re.findall(r"[a-z]+", value.lower())
    filler = not MARKS.isdisjoint(words) and FILLER.issuperset(words) and sum(c.isdigit() for c in value) <= 3
    return filler or PLACEHOLDER.fullmatch(value) is not None


def literal_score(value: str, phrase: bool = False) -> float:
    """Below 0 for what is no secret at all; up to 3 for long, random text. Many words are one only as a phrase, not as a sentence."""
    words = value.split()
    if len(value) < LEAST or placeholder(value) or len(words) > 3 and (not phrase or not SENTENCE.isdisjoint(value.lower().split())):
        return -9
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    mixed = (any(c.isdigit() for c in value)) + (any(c.isalpha() for c in value)) + (not value.isalnum())
    return (bits >= 2.5) + (bits >= 3.2 and len(value) >= 16) + (mixed >= 2)


def reached(found: list[Pair], score) -> dict[str, int]:
    """For each name the highest score of the names that its literals flow to along references, itself among them.

    Names are taken by falling score, and each hands its score to those it refers
    to, directly or not, that have none yet: every name and reference once.
    """
    refs: dict[str, list[str]] = {}
    for p in found:
        refs.setdefault(p.name, []).extend(p.refs)
    best: dict[str, int] = {}
    own = {n: score(n) for n in refs}
    for n in sorted(refs, key=lambda n: -own[n]):
        todo = [n]
        while todo:
            at = todo.pop()
            if at in refs and at not in best:
                best[at] = own[n]
                todo += refs[at]
    return best


def literals(text: str) -> set[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name and look the part."""
    found = pairs(text)
    if not found:
        return set()
    scores = reached(found, name_score)
    if max(scores.values()) <= 0:
        return set()
    phrase = reached(found, lambda n: int(name_score(n) > 0 and phrase_like(n)))
    best: dict[tuple[int, int], int] = {}
    phrases: set[tuple[int, int]] = set()
    for p in found:
        for x in p.literals:
            best[x] = max(best.get(x, 0), scores[p.name])
            if phrase[p.name]:
                phrases.add(x)
    return {x for x, s in best.items() if s > 0 and text[x[0] : x[1]] not in scores and s + literal_score(text[x[0] : x[1]], x in phrases) >= THRESHOLD}


def base(text: str) -> list[Span]:
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [Span("assign", *m.span(), m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [Span("access", *m.span(), m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Span("hex", *m.span(), m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(s: Span) -> tuple:
    return s.start, KINDS.index(s.kind), s.end


def find(text: str) -> list[Span]:
    """All spans: the base's, and the method's literals."""
    return sorted(base(text) + [Span("literal", a, b, (a, b)) for a, b in literals(text)], key=_order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, mark: str = "<secret>") -> str:
    out, at = [], 0
    for a, b in sorted(s.inner for s in find(text)):
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, whatever its text: a null text is empty and has no spans.

    Whole texts are lexed, however long; rows that repeat give equal rows; a row
    without doc_id keeps a null one; other columns are not read. Spans that begin
    at one place go by kind, then end. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                spans = find(text or "")
                plain = [s for s in spans if s.kind != "literal"]
                n = Counter(s.kind for s in plain)
                rows.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(listed(plain).encode()).hexdigest(), listed(spans), len(spans) - len(plain)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"]).astype({"doc_id": "Int64"})

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


def redacted(text: Column) -> Column:
    """The text with its secrets hidden; null stays null."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t))

    return hide(text)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
