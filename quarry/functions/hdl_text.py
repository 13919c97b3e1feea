"""Facts of one hardware-description source text, in plain Python for an Arrow function that sees each file once.

``facts`` yields rows (kind, name, scope, line, target, value, n1 to n8);
what the columns mean by kind is listed at ``KINDS``. Comments are blanked with
their newlines kept, so that line numbers hold; strings stay, but what looks
like a comment or bracket inside one is none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

COLUMNS = "kind string, name string, scope string, line int, target string, value string, n1 int, n2 int, n3 int, n4 int, n5 int, n6 int, n7 int, n8 int"
#: kind: target; value; n1 and on.
KINDS = {
    "module": "-; -; ports, parameters, last line",
    "interface": "-; -; ports, parameters, last line",
    "package": "-; -; 0, parameters, last line",
    "task": "-; -; arguments, 0, last line",
    "function": "-; -; arguments, 0, last line",
    "port": "direction; type and width",
    "parameter": "parameter or localparam; default",
    "instance": "type; generate label or none; connections",
    "override": "child type; value; instance's line",
    "include": "quoted or angle; -",
    "import": "symbol or *; -",
    "macro": "-; body",
    "typedef": "-; type",
    "enum": "-; members",
    "struct": "-; members",
    "signal": "wire, reg or logic; width",
    "modport": "-; ports as direction name",
    "binding": "interface type; modport",
    "generate": "explicit, for, if or case; condition",
    "block": "module; clocks; cyclomatic, deepest nesting, cognitive, lines, boolean operators, cases, cases without default, blocking assignments",
    "scope": "-; -; comment lines, blank lines, code lines, directives",
}
#: Words that begin statements and so are no type of an instance.
NO_TYPES = frozenset("module macromodule interface package task function if else for while repeat forever case casex casez begin end initial always always_ff always_comb always_latch assign return input output inout wire reg logic bit integer real time genvar parameter localparam typedef struct enum union generate endgenerate endmodule endcase default posedge negedge and or not nand nor xor buf import export assert assume cover property sequence unique priority wait fork join disable modport".split())
_MASK = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*\"""", re.DOTALL)
_DEFINITION = re.compile(r"\b(module|macromodule|interface|package|program)\s+(?:automatic\s+|static\s+)?([A-Za-z_]\w*)")
_ROUTINE = re.compile(r"\b(task|function)\s+(?:automatic\s+|static\s+)?(?:[\w$:]+(?:\s*\[[^\]]*\])*\s+)?([A-Za-z_]\w*)\s*(?=[(;])")
_INSTANCE = re.compile(r"(?:(?<=[;\n)])|(?<=\bbegin)|(?<=\bend)|^)[ \t]*([A-Za-z_]\w*)(?:\s+(?=[A-Za-z_])|\s*(?=#\s*\())")
_NAME = re.compile(r"\s*([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(?=\()")
_DIRECTION = re.compile(r"^\s*(input|output|inout|ref)\b\s*(.*)$", re.DOTALL)
_LAST_NAME = re.compile(r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*(?:=.*)?$", re.DOTALL)
_INCLUDE = re.compile(r'`\s*include\s+(?:"([^"\n]+)"|<([^>\n]+)>)')
_IMPORT = re.compile(r"\bimport\s+([^;]+);")
_MACRO = re.compile(r"^[ \t]*`define[ \t]+(\w+)(?:\([^)\n]*\))?[ \t]*((?:[^\n\\]|\\(?!\n)|\\\n)*)", re.MULTILINE)
_SIGNAL = re.compile(r"(?:^|;|\bbegin\b|\n)\s*(wire|reg|logic)\b\s*(?:signed\s*)?(\[[^\]]*\])?\s*([A-Za-z_]\w*(?:\s*\[[^\]]*\])?(?:\s*=[^,;]*)?(?:\s*,\s*[A-Za-z_]\w*(?:\s*\[[^\]]*\])?(?:\s*=[^,;]*)?)*)\s*;")
_TYPEDEF = re.compile(r"\btypedef\s+(enum|struct|union)?([^;{]*?)(?:\{([^}]*)\})?\s*\b([A-Za-z_]\w*)\s*;")
_PARAMETER = re.compile(r"\b(parameter|localparam)\b\s*([^;]*);")
_MODPORT = re.compile(r"\bmodport\s+([A-Za-z_]\w*)\s*\(([^)]*)\)")
_BLOCK = re.compile(r"\b(always_ff|always_comb|always_latch|always|initial)\b")
_EDGE = re.compile(r"\b(?:posedge|negedge)\s+([A-Za-z_]\w*)")
_DECISION = re.compile(r"\b(?:if|for|while|repeat|forever|case[xz]?|wait)\b|\?")
_BOOL = re.compile(r"&&|\|\||!(?!=)")
_BLOCKING = re.compile(r"[^<>=!\s]\s*=(?!=)")


def masked(text: str) -> tuple[str, str]:
    """The text without comments, and also without the insides of strings; both of the same length, newlines in place."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    no_comments = _MASK.sub(lambda m: m[0] if m[0][0] == '"' else blank(m[0]), text)
    return no_comments, _MASK.sub(lambda m: '"' + " " * (len(m[0]) - 2) + '"' if m[0][0] == '"' else blank(m[0]), text)


def closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``, or the text's end."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m[0] in "([{" else -1
        if depth == 0:
            return m.start()
    return len(text)


def pieces(text: str) -> list[tuple[int, str]]:
    """The parts of a list at its outermost commas with their places; empty ones are left out."""
    out, start, depth = [], 0, 0
    for m in re.finditer(r"[(\[{}\]),]", text):
        if m[0] == ",":
            if depth == 0:
                out.append((start, text[start : m.start()]))
                start = m.end()
        else:
            depth += 1 if m[0] in "([{" else -1
    out.append((start, text[start:]))
    return [(at, p) for at, p in out if p.strip()]


def line_counts(text: str) -> tuple[int, int, int, int]:
    """Comment, blank, code lines and directives. Code before or after a comment on one line is code."""
    code, _ = masked(text)
    comment = blank = lines = directives = 0
    for raw, rest in zip(text.split("\n"), code.split("\n"), strict=True):
        if rest.strip():
            lines += 1
            directives += rest.lstrip().startswith("`")
        elif raw.strip():
            comment += 1
        else:
            blank += 1
    return comment, blank, lines, directives


def block_end(code: str, at: int) -> int:
    """The end of the statement that begins at ``at``: that of its begin-end or case, else the next semicolon outside brackets (with else branches)."""
    depth, i = 0, at
    pattern = re.compile(r"\b(?:begin|end|case[xz]?|endcase|fork|join\w*)\b|[;(]|\bendmodule\b")
    while m := pattern.search(code, i):
        i = m.end()
        word = m[0]
        if word == "(":
            i = closing(code, m.start()) + 1
        elif word == "endmodule":
            return m.start()
        elif word in ("begin", "fork") or word.startswith("case"):
            depth += 1
        elif word != ";":
            depth -= 1
        if depth <= 0 and (word == ";" or word[0] in "ej"):
            more = re.compile(r"\s*else\b").match(code, i)
            if not more:
                return i
            i = more.end()
    return len(code)


def block_metrics(body: str) -> dict[str, int]:
    """Cyclomatic complexity, deepest begin-end nesting, cognitive complexity (decisions weighted by depth before their line), lines, operators and cases."""
    depth = deepest = cognitive = 0
    for line in body.split("\n"):
        cognitive += len(_DECISION.findall(line)) * (1 + depth)
        for m in re.finditer(r"\b(begin|end)\b", line):
            depth = max(0, depth + (1 if m[0] == "begin" else -1))
            deepest = max(deepest, depth)
    cases = [m.end() for m in re.finditer(r"\bcase[xz]?\b", body)]
    without = 0
    for at in cases:
        level, has = 1, False
        for m in re.compile(r"\b(case[xz]?|endcase|default)\b").finditer(body, at):
            level += m[0].startswith("case") - (m[0] == "endcase")
            has |= m[0] == "default" and level == 1
            if not level:
                break
        without += not has
    return {"cc": 1 + len(_DECISION.findall(body)), "nesting": deepest, "cognitive": cognitive, "loc": sum(1 for x in body.split("\n") if x.strip()), "bool": len(_BOOL.findall(body)), "cases": len(cases), "no_default": without}


def _ports(text: str, at: int) -> Iterator[tuple[str, str, str, int]]:
    """(name, direction, type and width, place) of a port list; a direction carries over to those that follow without one."""
    direction, kind = "", ""
    for start, part in pieces(text):
        m = _DIRECTION.match(part)
        body = m[2] if m else part
        name = _LAST_NAME.search(body.strip())
        if not name:
            continue
        before = body.strip()[: name.start()].strip()
        if m:
            direction, kind = m[1], before
        elif before and "." in before or before and not direction:
            yield name[1], "interface", before, at + start + len(part) - len(part.lstrip())
            continue
        elif before:
            kind = before
        yield name[1], direction, kind, at + start + len(part) - len(part.lstrip())


def _parameters(text: str) -> Iterator[tuple[str, str, str, int]]:
    kind = "parameter"
    for start, part in pieces(text):
        left, _, default = part.partition("=")
        m = re.match(r"\s*(parameter|localparam)\b", left)
        if m:
            kind, left = m[1], left[m.end() :]
        name = _LAST_NAME.search(left.strip())
        if name:
            yield name[1], kind, default.strip(), start + len(part) - len(part.lstrip())


def facts(text: str | None) -> Iterator[tuple]:
    """Rows of COLUMNS, by place in the text. A null or blank text has none but its line counts."""
    text = (text or "").replace("\r\n", "\n")
    code, bare = masked(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    out: list[tuple] = []

    def add(kind, name, scope, at, target=None, value=None, *n):
        out.append((kind, name, scope, line(at), target, value, *n, *[None] * (8 - len(n))))

    out.append(("scope", None, None, 1, None, None, *line_counts(text), *[None] * 4))
    scopes: list[tuple[int, int, str]] = []

    def scope_of(at: int) -> str | None:
        inside = [s for s in scopes if s[0] <= at < s[1]]
        return max(inside)[2] if inside else None

    for m in _DEFINITION.finditer(bare):
        kind, name, at = m[1].replace("macromodule", "module"), m[2], m.end()
        while skip := re.compile(r"\s*import\s[^;]*;").match(bare, at):
            at = skip.end()
        params = ports = ""
        params_at = ports_at = at
        if (h := re.compile(r"\s*#\s*\(").match(bare, at)) is not None:
            end = closing(bare, h.end() - 1)
            params, params_at, at = code[h.end() : end], h.end(), end + 1
        if (h := re.compile(r"\s*\(").match(bare, at)) is not None:
            end = closing(bare, h.end() - 1)
            ports, ports_at, at = code[h.end() : end], h.end(), end + 1
        if not re.compile(r"\s*;").match(bare, at):
            continue  # a mention, such as a virtual interface
        last = re.compile(rf"\bend{kind}\b").search(bare, at)
        end = last.end() if last else len(bare)
        scopes.append((m.start(), end, name))
        found_ports, found_params = list(_ports(ports, ports_at)), list(_parameters(params))
        add(kind, name, None, m.start(), None, None, len(found_ports), len(found_params), line(end - 1 if end else 0))
        for p, direction, what, place in found_ports:
            add("port", p, name, place, direction, what)
            if direction == "interface":
                add("binding", p, name, place, what.partition(".")[0].strip(), what.partition(".")[2].strip() or None)
        for p, what, default, place in found_params:
            add("parameter", p, name, params_at + place, what, default)
        for p in _PARAMETER.finditer(bare, at, end):
            for q, what, default, place in _parameters(code[p.start(1) : p.end(2)]):
                add("parameter", q, name, p.start(1) + place, what, default)
    for m in _ROUTINE.finditer(bare):
        h = re.compile(r"\s*\(").match(bare, m.end())
        end = closing(bare, h.end() - 1) if h else m.end()
        last = re.compile(rf"\bend{m[1]}\b").search(bare, end)
        add(m[1], m[2], scope_of(m.start()), m.start(), None, None, len(pieces(code[h.end() : end])) if h else 0, 0, line(last.start()) if last else line(end))
    for m in _INCLUDE.finditer(code):
        add("include", m[1] or m[2], None, m.start(), "quoted" if m[1] else "angle")
    for m in _IMPORT.finditer(bare):
        for _, part in pieces(m[1]):
            package, found, symbol = part.partition("::")
            if found:
                add("import", package.strip(), scope_of(m.start()), m.start(), symbol.strip())
    for m in _MACRO.finditer(code):
        add("macro", m[1], None, m.start(), None, " ".join(m[2].replace("\\\n", " ").split()))
    bodies = []
    for m in _TYPEDEF.finditer(bare):
        bodies.append(m.span())
        scope, members = scope_of(m.start()), [p.strip() for _, p in pieces((m[3] or "").replace(";", ","))]
        add("typedef", m[4], scope, m.start(), None, m[1] or " ".join(m[2].split()))
        if m[1]:
            names = [(_LAST_NAME.search(x.partition("=")[0].strip()) or [None, x])[1] for x in members]
            add("enum" if m[1] == "enum" else "struct", m[4], scope, m.start(), None, ",".join(names))
    for m in _MODPORT.finditer(bare):
        add("modport", m[1], scope_of(m.start()), m.start(), None, ",".join(f"{d} {p}" for p, d, _, _ in _ports(m[2], 0)))
    for m in _SIGNAL.finditer(bare):
        if any(a <= m.start(1) < b for a, b in bodies):
            continue
        scope = scope_of(m.start(1))
        for _, part in pieces(m[3]):
            name = re.match(r"\s*([A-Za-z_]\w*)\s*(\[[^\]]*\])?", part)
            add("signal", name[1], scope, m.start(1), m[1], ((m[2] or "") + (name[2] or "")) or None)
    labels = _generates(bare, add, scope_of)
    known_interfaces = {r[1] for r in out if r[0] == "interface"}
    for m in _INSTANCE.finditer(bare):
        kind, at = m[1], m.end()
        scope = scope_of(m.start(1))
        if kind in NO_TYPES or scope is None:
            continue
        overrides, over_at = "", at
        if (h := re.compile(r"#\s*\(").match(bare, at)) is not None:
            end = closing(bare, h.end() - 1)
            overrides, over_at, at = code[h.end() : end], h.end(), end + 1
        name = _NAME.match(bare, at)
        if not name or name[1] in NO_TYPES:
            continue
        end = closing(bare, name.end())
        if not re.compile(r"\s*[;,]").match(bare, end + 1):
            continue
        label = next((g for a, b, g in labels if a <= m.start(1) < b), None)
        add("instance", name[1], scope, m.start(1), kind, label, len(pieces(code[name.end() + 1 : end])))
        if kind in known_interfaces:
            add("binding", name[1], scope, m.start(1), kind)
        for i, (place, part) in enumerate(pieces(overrides)):
            named = re.match(r"\s*\.\s*(\w+)\s*\((.*)\)\s*$", part, re.DOTALL)
            add("override", named[1] if named else f"#{i}", scope, over_at + place, kind, (named[2] if named else part).strip(), line(m.start(1)))
    for m in _BLOCK.finditer(bare):
        scope = scope_of(m.start())
        if scope is None:
            continue
        start = m.end()
        if (h := re.compile(r"\s*@\s*(?:\(|\*)").match(bare, start)) is not None:
            start = closing(bare, h.end() - 1) + 1 if bare[h.end() - 1] == "(" else h.end()
        body = bare[m.start() : block_end(bare, start)]
        x = block_metrics(body)
        blocking = len(_BLOCKING.findall(re.sub(r"\([^()]*\)", "", body)))
        add("block", m[1], scope, m.start(), scope, ",".join(sorted(set(_EDGE.findall(body)))), x["cc"], x["nesting"], x["cognitive"], x["loc"], x["bool"], x["cases"], x["no_default"], blocking)
    yield from sorted(out, key=lambda r: (r[3], r[0], r[1] or ""))


def _generates(bare: str, add, scope_of) -> list[tuple[int, int, str]]:
    """Generate blocks: explicit ones, and for, if and case outside procedural blocks; returns the labelled ranges, inner ones first."""
    procedural = [(m.start(), block_end(bare, m.end())) for m in re.finditer(r"\b(?:always(?:_ff|_comb|_latch)?|initial|task|function)\b", bare)]
    routines = [(m.start(), (re.compile(rf"\bend{m[1]}\b").search(bare, m.end()) or m).end()) for m in re.finditer(r"\b(task|function)\b", bare)]
    inside = lambda at: any(a <= at < b for a, b in procedural + routines)
    out = []
    for m in re.finditer(r"\bgenerate\b", bare):
        end = re.compile(r"\bendgenerate\b").search(bare, m.end())
        add("generate", "generate", scope_of(m.start()), m.start(), "explicit", None)
        if end:
            out.append((m.start(), end.start(), "generate"))
    for m in re.finditer(r"\b(for|if|case)\s*\(", bare):
        at = m.start()
        scope = scope_of(at)
        if scope is None or inside(at):
            continue
        end = closing(bare, m.end() - 1)
        label = re.compile(r"\s*begin\s*:\s*(\w+)").match(bare, end + 1)
        name = label[1] if label else f"{m[1]}_{at}"
        add("generate", name if label else None, scope, at, m[1], " ".join(bare[m.end() : end].split()))
        out.append((at, block_end(bare, end + 1), name))
    return sorted(out, key=lambda x: x[1] - x[0])
