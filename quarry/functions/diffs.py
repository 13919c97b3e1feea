"""Patches: formats told apart, hunks read, several files split, and hunks applied."""

from __future__ import annotations

import re
from typing import NamedTuple


class Hunk(NamedTuple):
    old_start: int
    old_count: int
    new_start: int
    new_count: int
    removed: list[str]
    added: list[str]
    #: Old and new lines in order, context in both.
    old: list[str]
    new: list[str]


_UNIFIED = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_COMBINED = re.compile(r"^(@@@+) ((?:-\d+(?:,\d+)? )+)\+(\d+)(?:,(\d+))? @@@+")
_NORMAL = re.compile(r"^(\d+)(?:,(\d+))?([acd])(\d+)(?:,(\d+))?$")
_CONTEXT = re.compile(r"^\*\*\* (\d+)(?:,(\d+))? \*\*\*\*$")
_CONTEXT_NEW = re.compile(r"^--- (\d+)(?:,(\d+))? ----$")
#: Headers of one file's part, by dialect.
HEADERS = {
    "git": re.compile(r"^diff --git a/(?:\S+) b/(\S+)$"),
    "index": re.compile(r"^Index: (\S+)"),
    "equals": re.compile(r"^==== (\S+?)(?:#\d+)?(?: .*)?====\s*$"),
    "context": re.compile(r"^\*\*\* (?!\d+(?:,\d+)? \*)(\S+)"),
    "unified": re.compile(r"^\+\+\+ (?:b/)?(\S+)"),
}


def format_of(text: str) -> str:
    """unified, combined, context or normal, by the first hunk header of the first hundred lines; else unknown."""
    for line in text.split("\n")[:100]:
        for name, pattern in (("combined", _COMBINED), ("unified", _UNIFIED), ("context", _CONTEXT), ("normal", _NORMAL)):
            if pattern.match(line):
                return name
    return "unknown"


def hunks(text: str | None) -> list[Hunk]:
    text = (text or "").replace("\r\n", "\n")
    return {"unified": _unified, "combined": _combined, "context": _context, "normal": _normal}.get(format_of(text), lambda lines: [])(text.split("\n"))


def _count(x: str | None) -> int:
    return 1 if x is None else int(x)


def _body(lines: list[str], at: int, n_old: int, n_new: int) -> tuple[list[str], list[str], list[str], list[str], int]:
    removed, added, old, new = [], [], [], []
    while at < len(lines) and (len(old) < n_old or len(new) < n_new):
        mark, rest = lines[at][:1], lines[at][1:]
        if mark == "-":
            removed.append(rest)
            old.append(rest)
        elif mark == "+":
            added.append(rest)
            new.append(rest)
        elif mark in (" ", ""):
            old.append(rest)
            new.append(rest)
        elif mark != "\\":
            break
        at += 1
    return removed, added, old, new, at


def _unified(lines: list[str]) -> list[Hunk]:
    out, at = [], 0
    while at < len(lines):
        m = _UNIFIED.match(lines[at])
        at += 1
        if m:
            a, b = _count(m[2]), _count(m[4])
            removed, added, old, new, at = _body(lines, at, a, b)
            out.append(Hunk(int(m[1]), a, int(m[3]), b, removed, added, old, new))
    return out


def _combined(lines: list[str]) -> list[Hunk]:
    """Against the first parent: a line is added or removed if any parent's column says so."""
    out, at = [], 0
    while at < len(lines):
        m = _COMBINED.match(lines[at])
        at += 1
        if not m:
            continue
        width, first = len(m[1]) - 1, re.match(r"-(\d+)(?:,(\d+))?", m[2])
        removed, added, old, new = [], [], [], []
        while at < len(lines) and not lines[at].startswith(("@@@", "diff ")):
            marks, rest = lines[at][:width], lines[at][width:]
            if "-" in marks:
                removed.append(rest)
                old.append(rest)
            elif "+" in marks:
                added.append(rest)
                new.append(rest)
            elif lines[at]:
                old.append(rest)
                new.append(rest)
            at += 1
        out.append(Hunk(int(first[1]), _count(first[2]), int(m[3]), _count(m[4]), removed, added, old, new))
    return out


def _normal(lines: list[str]) -> list[Hunk]:
    out, at = [], 0
    while at < len(lines):
        m = _NORMAL.match(lines[at])
        at += 1
        if not m:
            continue
        removed, added = [], []
        while at < len(lines) and lines[at][:1] in ("<", ">", "-", "\\"):
            if lines[at][:1] in ("<", ">"):
                (removed if lines[at][0] == "<" else added).append(lines[at][2:])
            at += 1
        # An addition names the old line before it, a deletion the new one.
        out.append(Hunk(int(m[1]), len(removed), int(m[4]), len(added), removed, added, removed, added))
    return out


def _context(lines: list[str]) -> list[Hunk]:
    out, at = [], 0

    def part(at: int) -> tuple[list[tuple[str, str]], int]:
        rows = []
        while at < len(lines) and lines[at][:2] in ("  ", "- ", "+ ", "! "):
            rows.append((lines[at][0], lines[at][2:]))
            at += 1
        return rows, at

    while at < len(lines):
        m = _CONTEXT.match(lines[at])
        at += 1
        if not m:
            continue
        before, at = part(at)
        n = _CONTEXT_NEW.match(lines[at]) if at < len(lines) else None
        if not n:
            continue
        after, at = part(at + 1)
        # A side without changes is left out: it is the other's context.
        before = before or [x for x in after if x[0] == " "]
        after = after or [x for x in before if x[0] == " "]
        removed, added = ([t for mark, t in rows if mark != " "] for rows in (before, after))
        out.append(Hunk(int(m[1]), len(before), int(n[1]), len(after), removed, added, [t for _, t in before], [t for _, t in after]))
    return out


def files(text: str | None) -> list[tuple[str, str, str]]:
    """(path, dialect, part) of a patch of several files, by the dialect that heads most of them."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    found = {k: [(i, m[1]) for i, x in enumerate(lines) if (m := p.match(x))] for k, p in HEADERS.items()}
    if not any(found.values()):
        return []
    # git and index headers come with unified ones, which then are no files of their own.
    kind = max(HEADERS, key=lambda k: (len(found[k]), -list(HEADERS).index(k)))
    heads = found[kind]
    starts = [i - (kind == "unified" and i > 0 and lines[i - 1].startswith("--- ")) for i, _ in heads] + [len(lines)]
    return [(path, kind, "\n".join(lines[a:b])) for (_, path), a, b in zip(heads, starts, starts[1:], strict=False)]


def apply(text: str, found: list[Hunk]) -> str | None:
    """The text with all hunks applied, each placed by its own start and what earlier ones added; None where old lines are not as said."""
    lines, shift = text.split("\n"), 0
    for h in found:
        at = max(0, (h.old_start - 1 if h.old else h.old_start) + shift)  # without old lines the start is the line before
        if lines[at : at + len(h.old)] != h.old:
            return None
        lines[at : at + len(h.old)] = h.new
        shift += len(h.new) - len(h.old)
    return "\n".join(lines)


def balanced(text: str) -> bool:
    """Whether brackets outside strings and comments match."""
    from .hdl_text import masked

    stack = []
    for c in masked(text)[1]:
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and (not stack or "([{".index(stack.pop()) != ")]}".index(c)):
            return False
    return not stack


def chunks(text: str, most: int = 12_000, mark: str = "endmodule") -> list[tuple[int, str]]:
    """(first line, chunk): cut after the last mark within ``most`` letters, else after the last newline, else there."""
    out, at, line = [], 0, 1
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            cut = text.rfind(mark, at, end)
            cut = cut + len(mark) if cut > at else text.rfind("\n", at, end) + 1
            end = cut if cut > at else end
        out.append((line, text[at:end]))
        line += text.count("\n", at, end)
        at = end
    return out


def brace_chunks(text: str, most: int) -> list[tuple[int, int]]:
    """(first, last) lines of chunks of at least ``most`` lines that end where brackets are closed."""
    out, first, depth = [], 1, 0
    rows = text.split("\n")
    for i, row in enumerate(rows, 1):
        depth += sum(row.count(c) for c in "({[") - sum(row.count(c) for c in ")}]")
        if i - first + 1 >= most and depth <= 0:
            out.append((first, i))
            first, depth = i + 1, 0
    if first <= len(rows):
        out.append((first, len(rows)))
    return out
