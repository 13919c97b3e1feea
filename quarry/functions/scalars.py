"""Scalar expressions that several relations share."""

from __future__ import annotations


from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least score of each grade, severities by weight and by lint level, and the words of severities by rank.
GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 60))
SEVERITY_POINTS = {"critical": 5, "high": 4, "medium": 2, "low": 1}
RISK_POINTS = {"critical": 10, "high": 6, "medium": 3, "low": 1}
PRIORITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def grade(score: Column) -> Column:
    out = F.lit("F")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def points(severity: Column, table: dict[str, float], other: float = 0) -> Column:
    out = F.lit(float(other))
    for name, value in table.items():
        out = F.when(F.lower(severity) == name, float(value)).otherwise(out)
    return out


def ladder(x: Column, steps: Sequence[tuple[float, float]], below: float) -> Column:
    """The value of the first step that x reaches, from the highest down."""
    out = F.lit(float(below))
    for least, value in sorted(steps):
        out = F.when(x >= least, float(value)).otherwise(out)
    return out


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def line_of(text: Column, position: Column) -> Column:
    """The line, from 1, of a position from 1 in a text."""
    before = F.substring(text, F.lit(1), position - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def module_key(path: Column) -> Column:
    """A path without its last extension, with dots for slashes."""
    return F.translate(F.regexp_replace(path, r"\.[^./]*$", ""), "/", ".")


def title(field: Column) -> Column:
    return F.initcap(F.translate(field, "_", " "))


def safe_text(x: Column) -> Column:
    """Trimmed; null and "nan" are empty."""
    return F.when(x.isNull() | (F.lower(F.trim(x)) == "nan"), "").otherwise(F.trim(x))


def filled(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(default))


def truncated(x: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(mark))).otherwise(x)


def node_name(x: Column) -> Column:
    """Letters, digits and underscores only; one that begins with a digit gets an n before it."""
    clean = F.regexp_replace(x, r"[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike(r"^\d"), F.concat(F.lit("n"), clean)).otherwise(clean)


def fingerprint(file: Column, line: Column, category: Column, description: Column) -> Column:
    """File, line in steps of five, category and the description's first 80 letters, in lower case."""
    bucket = (F.floor(line / 5) * 5).cast("string")
    return F.concat_ws("|", F.coalesce(file, F.lit("")), F.coalesce(bucket, F.lit("")), F.lower(F.trim(F.coalesce(category, F.lit("")))), F.substring(F.lower(F.trim(F.coalesce(description, F.lit("")))), 1, 80))


def record_id(fields: Sequence[str]) -> Column:
    """md5 of name=value pairs joined by bars; nulls are left out."""
    return F.md5(F.concat_ws("|", *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f + "="), F.col(f).cast("string"))) for f in sorted(fields)]))


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def is_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), F.lit(False))


def bit_width(text: Column) -> Column:
    """Of the first [high:low] in a text; null without one."""
    pattern = r"\[\s*(\d+)\s*:\s*(\d+)\s*\]"
    high, low = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))
    return F.abs(high - low) + 1


def without_ansi(x: Column) -> Column:
    return F.regexp_replace(x, r"\x1B\[[0-9;]*[A-Za-z]", "")


def retrieval_score(decisions: Column, rules: Column) -> Column:
    return F.least(F.lit(1.0), (decisions + 2 * rules) / 10)


def cyclomatic(code: Column) -> Column:
    return F.regexp_count(code, F.lit(r"\b(?:if|for|while|case[xz]?|repeat|forever)\b|&&|\|\||\?")) + 1


def halstead_volume(code: Column) -> Column:
    """N log2 n over operators and operands, N of all and n of distinct ones."""
    operators = F.regexp_extract_all(code, F.lit(r"(<=|>=|==|!=|&&|\|\||<<|>>|[-+*/%&|^~!<>=?:])"), F.lit(1))
    operands = F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_]\w*|\d[\w']*)\b"), F.lit(1))
    n = F.size(F.array_distinct(operators)) + F.size(F.array_distinct(operands))
    total = F.size(operators) + F.size(operands)
    return F.when(n > 0, total * F.log2(n.cast("double"))).otherwise(0.0)


def maintainability_index(volume: Column, cc: Column, lines: Column) -> Column:
    """Scaled to 0 to 100 and clamped."""
    raw = 171 - 5.2 * F.ln(F.greatest(volume, F.lit(1.0))) - 0.23 * cc - 16.2 * F.ln(F.greatest(lines, F.lit(1)).cast("double"))
    return clamp(raw * 100 / 171)


def cost(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Of tokens at prices a million, to six places."""
    return F.round((prompt * price_in + completion * price_out) / 1_000_000, 6)


