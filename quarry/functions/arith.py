"""Constants of source text: numbers with a base and a width, and plain arithmetic over them."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:(\d*\s*'\s*[sS]?[bBoOdDhH]\s*[0-9a-fA-F_xXzZ?]+|\d[\d_]*)|(<<|>>|\*\*|[-+*/%&|^~()]))")
_BASES = {"b": 2, "o": 8, "d": 10, "h": 16}
#: From the loosest binding to the tightest.
_LEVELS = (("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))


def number(text: str) -> int | None:
    """A literal such as 12, 4'b1010 or 8'hFF; None for unknown or floating bits and for what is no number."""
    text = re.sub(r"[\s_]", "", text or "")
    m = re.fullmatch(r"(?:\d*)'[sS]?([bBoOdDhH])([0-9a-fA-FxXzZ?]+)|(\d+)", text)
    if not m:
        return None
    if m[3]:
        return int(m[3])
    try:
        return int(m[2], _BASES[m[1].lower()])
    except ValueError:
        return None


def evaluate(text: str | None) -> int | None:
    """The value of an expression of literals, or None. Nothing is run: the text is parsed."""
    tokens, at = [], 0
    text = (text or "").strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        tokens.append(m[1] or m[2])
        at = m.end()

    def unary(i: int) -> tuple[int, int]:
        if tokens[i] in ("-", "+", "~"):
            v, j = unary(i + 1)
            return {"-": -v, "+": v, "~": ~v}[tokens[i]], j
        if tokens[i] == "(":
            v, j = binary(i + 1, 0)
            if tokens[j] != ")":
                raise ValueError
            return v, j + 1
        v = number(tokens[i])
        if v is None:
            raise ValueError
        if i + 1 < len(tokens) and tokens[i + 1] == "**":
            e, j = unary(i + 2)
            if not 0 <= e <= 64:
                raise ValueError
            return v**e, j
        return v, i + 1

    def binary(i: int, level: int) -> tuple[int, int]:
        if level == len(_LEVELS):
            return unary(i)
        v, i = binary(i, level + 1)
        while i < len(tokens) and tokens[i] in _LEVELS[level]:
            op = tokens[i]
            w, i = binary(i + 1, level + 1)
            if op in ("<<", ">>") and not 0 <= w <= 1024:
                raise ValueError
            v = {"|": lambda: v | w, "^": lambda: v ^ w, "&": lambda: v & w, "<<": lambda: v << w, ">>": lambda: v >> w, "+": lambda: v + w, "-": lambda: v - w, "*": lambda: v * w, "/": lambda: v // w, "%": lambda: v % w}[op]()
        return v, i

    try:
        value, end = binary(0, 0)
    except (ValueError, IndexError, ZeroDivisionError, RecursionError):
        return None
    return value if end == len(tokens) and abs(value) < 1 << 63 else None
