"""Rule catalogs over source text, and the scores that stand on them.

A catalog is a list; one projection tests all its patterns on a text in one
pass, so that no text is joined with rules. Patterns run in the JVM; only
comments are taken out by an Arrow function, which keeps newlines.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import hdl_text, scalars
from ..staging import staged
from . import corpus, facts


class Rule(NamedTuple):
    id: str
    severity: str
    pattern: str


# The catalogs' ids, severities and patterns. Where a pattern as published names a group that it
# lacks, the form that is meant stands here.
QUALITY = (
    Rule("HDL002", "high", r"(?s)always\s*@\s*\*\s*begin.*?<="),
    Rule("HDL003", "medium", r"always\s*@\s*\([a-zA-Z0-9_\s,]*\)\s*begin"),
    Rule("HDL004", "medium", r"initial\s+begin"),
    Rule("HDL005", "low", r"(?s)(?:input|output|wire|reg)\s+[a-zA-Z0-9_]+\s+([a-zA-Z0-9_]+).*?[a-zA-Z0-9_]+\s*="),
    Rule("HDL006", "high", r"#\s*\d+"),
    Rule("HDL007", "critical", r"(?s)assign\s+([a-zA-Z0-9_]+)\b[^;]*;.*?assign\s+\1\b"),
    Rule("HDL008", "medium", r"(?s)case\s*\([^)]+\)(?!.*?default)"),
)
SAFETY = (
    Rule("HDL-DRC-001", "critical", r"(?is)assign\s+(\w+)\s*=[^;]*;\s*assign\s+\w+\s*=[^;]*\b\1\b"),
    Rule("HDL-DRC-002", "high", r"(?is)always\s*@\*.*?(?:if|case).*?(?!else).*?end"),
    Rule("HDL-DRC-003", "high", r"(?is)always\s*@\s*\([^)]*\)(?!.*always\s*@\s*\*)"),
    Rule("HDL-DRC-004", "critical", r"(?is)(posedge|negedge)\s+(\w+).*?(posedge|negedge)\s+(?!\2)"),
    Rule("HDL-DRC-005", "high", r"(?is)reg\s+(\w+)\s*;(?:[^;]*;)*?[^;]*\b\1\s*<=\s*\w+_(?:async|in)\s*;"),
    Rule("HDL-DRC-006", "medium", r"(?is)reg\s+\w+\s*;(?!.*reset)"),
    Rule("HDL-DRC-007", "high", r"(?is)if\s*\(\s*!?reset\s*\)(?!.*negedge.*reset)"),
    Rule("HDL-DRC-008", "high", r"(?is)always\s*@\s*\(posedge.*?[^<]\s*=\s*"),
    Rule("HDL-DRC-009", "high", r"(?is)assign\s+\w+\s*=\s*.*?\s*\?\s*.*?\s*:\s*1'bz"),
    Rule("HDL-DRC-010", "medium", r"(?is)=\s*[1-9]'bx|=\s*'x|=\s*\{.*?'x.*?\}"),
    Rule("HDL-DRC-011", "medium", r"(?is)assign\s+clk_out\s*=\s*clk.*?&.*?enable"),
    Rule("HDL-DRC-012", "high", r"(?is)always\s*@\s*\(posedge.*?\[.*?:.*?\].*?posedge\s+(?!.*gray)"),
    Rule("HDL-DRC-013", "medium", r"(?is)(?:async_fifo|fifo.*clock|read_clk.*write_clk)"),
)
LINT = (
    Rule("HDL-001", "critical", r"always\s*@\s*\((?:posedge|negedge).*?\).*?[^<]="),
    Rule("HDL-002", "high", r"(?:always\s*@\s*\(\*\)|always_comb).*?<="),
    Rule("HDL-003", "high", r"always\s*@.*?\n\s*if\s*\(.*?\)\s*.*?(?!else\s)"),
    Rule("HDL-005", "medium", r"\binitial\s*begin"),
    Rule("HDL-006", "low", r"^\s*(?!.*\b(?:wire|reg|input|output|logic|bit|integer|real|inout)\b)\w+\s+\w+\s*[,;]"),
    Rule("HDL-007", "medium", r"#\s*\d+"),
    Rule("HDL-008", "medium", r"case\s*\(.*?\).*?(?!default)"),
    Rule("HDL-009", "low", r"generate\s*\n\s*for|if\s*\("),
    Rule("HDL-011", "medium", r"always\s*@\s*\(.*?negedge\s+rst"),
    Rule("HDL-012", "high", r"assign\s+\w+\s*=\s*\w+_clk"),
    Rule("HDL-013", "medium", r"=\s*\d+'[xX]"),
    Rule("HDL-014", "low", r"input\s+.*?;(?!\s*//\s*(?:pull|tie|unused))"),
    Rule("HDL-015", "medium", r"=\s*\d+'(?:h|b|d)\d+"),
    Rule("HDL-016", "low", r"signed.*?unsigned|unsigned.*?signed"),
    Rule("HDL-018", "medium", r"always.*?=\s*\w+"),
    Rule("HDL-019", "high", r"data.*?clk|clk.*?data"),
    Rule("HDL-020", "high", r"\.clk\s*\([^c]"),
)
STYLE = (Rule("STYLE-LINELENGTH", "low", r"^.{121}"), Rule("STYLE-TABS", "low", r"\t"), Rule("STYLE-TRAILWS", "low", r"[ \t]+$"), Rule("STYLE-TODO", "low", r"//.*\b(TODO|FIXME|HACK)\b"))
FRAMEWORKS = {
    "uvm": r"(?i)uvm_test\b|uvm_env\b|uvm_agent\b|uvm_driver\b|import\s+uvm_pkg",
    "sva": r"(?i)assert\s+property\b|assume\s+property\b|cover\s+property\b|\$assert\b",
    "cocotb": r"(?i)import\s+cocotb|@cocotb\.test",
    "vunit": r"(?i)run_all_in_parallel|tb_entity_pkg",
}
ASSERTIONS = r"(?i)assert\s+property\b|assume\s+property\b|cover\s+property\b|\$assert\b|\$assume\b"
COVERAGE = r"(?i)covergroup\b|coverpoint\b|cross\b"
#: Marks of the newer language in a source.
MARKS = (
    r"\bclass\s+\w+", r"\binterface\s+\w+", r"\bpackage\s+\w+", r"\bimport\s+\w+\s*::", r"\btypedef\s+", r"\bstruct\s+\{", r"\benum\s+\{", r"\bbit\s+", r"\blogic\s+",
    r"\balways_ff\s+@", r"\balways_comb\s+", r"\balways_latch\s+", r"\bunique\s+case", r"\bpriority\s+case", r"\bassert\s+property", r"\bmodport\s+", r"\bclocking\s+",
    r"\bprogram\s+\w+", r"\bproperty\s+\w+", r"\bsequence\s+\w+", r"\bcoverage\s+\{", r"\brandomize\s*\(", r"\bwith\s*\{",
)
SYSTEM_PACKAGES = ("uvm_pkg", "std", "ovm_pkg", "vmm_pkg")


def uncommented(source: str) -> Column:
    """The column without comments; newlines stay, so that line numbers hold."""

    @F.pandas_udf(StringType())
    def run(sources: pd.Series) -> pd.Series:
        return sources.map(lambda t: t if t is None else hdl_text.masked(t)[0])

    return run(F.col(source))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column, source: Column) -> Column:
    """By suffix; a plain source with a mark of the newer language is of that."""
    s = suffix(path)
    marked = F.coalesce(source, F.lit("")).rlike("(?i)" + "|".join(MARKS))
    return F.when(s.isin(".vhd", ".vhdl"), "vhdl").when(s.isin(".vh", ".svh"), "verilog_header").when(s.isin(".v"), F.when(marked, "systemverilog").otherwise("verilog")).when(s.isin(".sv"), "systemverilog").otherwise("unknown")


def hdl_only(files: DataFrame) -> DataFrame:
    return files.where(suffix(F.col("path")).isin(*corpus.SUFFIXES))


def testbench_name(name: Column) -> Column:
    """Name patterns hold from the name's beginning on."""
    return F.lower(name).rlike(r"^(?:tb_|test_|.*_tb|.*_test|.*testbench)")


def violations(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(file_id, rule, severity, hits, line): the number of matches in a text, and the first one's line."""
    text = F.col("source")
    each = [F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.regexp_count(text, F.lit(r.pattern)).alias("hits"), F.regexp_instr(text, F.lit(r.pattern)).alias("at")) for r in rules]
    found = files.select("file_id", "source", F.explode(F.filter(F.array(*each), lambda x: x["hits"] > 0)).alias("v"))
    return found.select("file_id", "v.rule", "v.severity", "v.hits", scalars.line_of(text, F.col("v.at")).alias("line"))


def quality(files: DataFrame, f: DataFrame) -> DataFrame:
    """The quality catalog; its first rule, a blocking assignment in an edge-triggered block, needs the block's end and so stands on facts."""
    edge = facts.blocks(f).where("clocks <> '' and blocking > 0").groupBy("file_id").agg(F.sum("blocking").cast("int").alias("hits"), F.min("line").alias("line"))
    return violations(files, QUALITY).unionByName(edge.select("file_id", F.lit("HDL001").alias("rule"), F.lit("high").alias("severity"), "hits", "line"))


def by_line(files: DataFrame, rules: tuple[Rule, ...], skip_comments: bool = False) -> DataFrame:
    """(file_id, line_no, rule, severity): the rules that each line breaks; lines that begin as comments may be left out."""
    rows = facts.lines(files)
    if skip_comments:
        rows = rows.where(~F.trim("line").rlike(r"^(//|/\*|\*)"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(r.pattern), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules]))
    return rows.select("file_id", "line_no", F.explode(hits).alias("v")).select("file_id", "line_no", "v.rule", "v.severity")


def crossings(f: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, module, line, clocks): blocks with several clocks and no sign of a synchronizer in their file."""
    plain = files.where(~F.col("source").rlike(r"(?i)sync|meta|gray")).select("file_id")
    return facts.blocks(f).where(F.size(F.split("clocks", ",")) > 1).join(plain, "file_id", "left_semi").select("file_id", "module", "line", "clocks")


def unassigned(f: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, name): registers that nothing in their file assigns."""
    targets = F.regexp_extract_all(uncommented("source"), F.lit(r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?<?=(?!=)"), F.lit(1))
    assigned = files.select("file_id", F.explode(F.array_distinct(targets)).alias("name"))
    ports = f.where("kind = 'port' and target = 'output' and value like 'reg%'")
    regs = f.where("kind = 'signal' and target = 'reg'").unionByName(ports).select("file_id", "name").distinct()
    return regs.join(assigned, ["file_id", "name"], "left_anti")


def drivers(files: DataFrame) -> DataFrame:
    """(file_id, target, drivers): signals of more than one continuous assignment."""
    targets = F.regexp_extract_all(uncommented("source"), F.lit(r"\bassign\s+([a-zA-Z0-9_]+)\s*="), F.lit(1))
    return files.select("file_id", F.explode(targets).alias("target")).groupBy("file_id", "target").agg(F.count(F.lit(1)).alias("drivers")).where("drivers > 1")


def widths(files: DataFrame) -> DataFrame:
    """(file_id, left, right): assignments between slices of unlike widths."""
    pattern = r"([a-zA-Z0-9_]+\[\d+:\d+\])\s*<?=\s*([a-zA-Z0-9_]+\[\d+:\d+\])"
    text = uncommented("source")
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("l"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("r"))
    pairs = files.select("file_id", F.explode(both).alias("x")).select("file_id", F.col("x.l").alias("left"), F.col("x.r").alias("right"))
    return pairs.where(scalars.bit_width(F.col("left")) != scalars.bit_width(F.col("right")))


def maintainability(files: DataFrame) -> DataFrame:
    """Per file: formatting counts, include guard in the first 30 lines, whether a case lacks its default, and the index."""
    code, lines = uncommented("source"), F.split("source", "\n", -1)
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    head = F.array_join(F.slice(lines, 1, 30), "\n")
    x = files.select("file_id", "source", code.alias("code"), n(r"^.{121}").alias("long_lines"), n(r"\t").alias("tabs"), n(r"[ \t]+$").alias("trailing"), n(r"(?i)\b(TODO|FIXME|XXX)\b").alias("todos"), (head.rlike(r"`ifndef\s+\w+") & head.rlike(r"`define\s+\w+")).alias("guard"))
    loc = F.size(F.filter(F.split("code", "\n", -1), lambda y: F.trim(y) != ""))
    return x.select("file_id", "long_lines", "tabs", "trailing", "todos", "guard", scalars.cyclomatic(F.col("code")).alias("cc"), loc.alias("loc"), scalars.halstead_volume(F.col("code")).alias("volume"), F.col("code").rlike(r"(?s)\bcase\b(?!.{0,2000}default)").alias("case_without_default"))


def documentation(files: DataFrame) -> DataFrame:
    """Per file with a module: whether its header and ports are documented, and how many parameters are."""
    lines = F.split("source", "\n", -1)
    head = F.array_join(F.slice(lines, 1, 50), "\n")
    ports = F.regexp_extract("source", r"(?s)module\s+\w+\s*(?:#\s*\([^)]*\)\s*)?\((.*?)\)", 1)
    n_ports = F.when(F.trim(ports) == "", 0).otherwise(F.size(F.split(ports, ",")))
    params = F.regexp_count("source", F.lit(r"parameter\s+"))
    x = files.where(F.col("source").rlike(r"module\s+[a-zA-Z0-9_]+"))
    return x.select("file_id", (head.rlike(r"(?is)/\*.*?(module|purpose|description)") | head.rlike(r"(?i)//\s*(module|purpose|description)")).alias("header"), F.col("source").rlike(r"//\s*(input|output|inout):|(?s)/\*.*?(input|output|inout):").alias("ports_documented"), n_ports.alias("ports"), params.alias("params"), F.least(F.regexp_count("source", F.lit(r"//\s*parameter|/\*\s*parameter")), params).alias("params_documented"))


def verification(files: DataFrame) -> DataFrame:
    """Per testbench file: frameworks, assertions and coverage declarations."""
    tb = files.where(F.lower("path").rlike(r"(^|/)(tb|testbench|test|verification|sim)/|_tb\.|tb_"))
    frameworks = F.array_compact(F.array(*[F.when(F.col("source").rlike(p), F.lit(k)) for k, p in sorted(FRAMEWORKS.items())]))
    return tb.select("file_id", F.array_join(frameworks, ",").alias("frameworks"), F.regexp_count("source", F.lit(ASSERTIONS)).alias("assertions"), F.regexp_count("source", F.lit(COVERAGE)).alias("coverage"))


def mismatches(f: DataFrame) -> DataFrame:
    """(file_id, parent, child, param, value, default): overrides whose literal is of another type than the declared default."""
    defaults = f.where("kind = 'parameter'").select(F.col("scope").alias("child"), F.col("name").alias("param"), F.col("value").alias("default")).groupBy("child", "param").agg(F.min("default").alias("default"))
    text = lambda c: F.col(c).startswith('"')
    hexes = F.length(F.regexp_extract("value", r"'[hH]([0-9a-fA-F_]+)", 1)) * 4
    wide = (hexes > 0) & (scalars.bit_width(F.col("default")) < hexes)
    return facts.overrides(f).join(defaults, ["child", "param"]).where((text("value") != text("default")) | F.coalesce(wide, F.lit(False))).select("file_id", "parent", "child", "param", "value", "default")


# Scores: one row each.


def quality_score(files: DataFrame, f: DataFrame) -> DataFrame:
    v = quality(files, f).select("severity", "hits").unionByName(by_line(files, STYLE).select("severity", F.lit(1).alias("hits")))
    sums = v.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("violations"), F.coalesce(F.sum(F.col("hits") * scalars.points(F.col("severity"), scalars.SEVERITY_POINTS)), F.lit(0.0)).alias("weight"))
    n = files.agg(F.count(F.lit(1)).alias("files"))
    score = scalars.clamp(100 - 2 * F.col("weight") / F.greatest("files", F.lit(1)))
    return sums.crossJoin(F.broadcast(n)).select("files", "violations", "weight", score.alias("score"), scalars.grade(score).alias("grade"))


def safety_score(files: DataFrame) -> DataFrame:
    """Risk points by file, normalized by the root of their mean; any critical finding caps the score at 50."""
    v = violations(files.withColumn("source", uncommented("source")), SAFETY)
    p = scalars.points(F.col("severity"), scalars.RISK_POINTS)
    each = v.groupBy("file_id").agg(F.sum(F.col("hits") * p).alias("points"), F.max(p).alias("worst"))
    sums = each.agg(F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"), F.count(F.when(F.col("worst") >= 6, 1)).alias("risky"), F.count(F.when(F.col("worst") >= 10, 1)).alias("critical"))
    n = files.agg(F.count(F.lit(1)).alias("files"))
    raw = scalars.clamp(100 - 10 * F.sqrt(F.col("points") / F.greatest("files", F.lit(1))))
    return sums.crossJoin(F.broadcast(n)).select("files", "risky", "critical", "points", F.when(F.col("critical") > 0, F.least(raw, F.lit(50.0))).otherwise(raw).alias("score"))


def documentation_score(files: DataFrame) -> DataFrame:
    d = documentation(files)
    as_int = lambda c: F.sum(F.col(c).cast("int"))
    s = d.agg(F.count(F.lit(1)).alias("modules"), as_int("header").alias("headers"), F.sum("ports").alias("ports"), F.sum(F.when(F.col("ports_documented"), F.col("ports")).otherwise(0)).alias("ported"), F.sum("params").alias("params"), F.sum("params_documented").alias("paramed"))
    ratio = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    s = s.withColumns({"items": F.col("modules") + F.col("ports") + F.col("params")})
    steps = ((0.8, 100), (0.6, 85), (0.4, 65), (0.2, 45))
    parts = [scalars.ladder(ratio(a, b), steps, 25) * w for a, b, w in (("headers", "items", 0.4), ("headers", "modules", 0.25), ("ported", "ports", 0.2), ("paramed", "params", 0.15))]
    return s.select("modules", "headers", "ports", "params", (parts[0] + parts[1] + parts[2] + parts[3]).alias("score"))


def verification_score(files: DataFrame) -> DataFrame:
    """Ratio of testbenches, frameworks, assertions, coverage and tools, weighted 30, 25, 20, 15 and 10; 0 without a testbench."""
    v = verification(files)
    tb = v.agg(F.count(F.lit(1)).alias("benches"), F.coalesce(F.sum("assertions"), F.lit(0)).alias("assertions"), F.coalesce(F.sum("coverage"), F.lit(0)).alias("coverage"), F.count(F.when(F.col("frameworks") != "", 1)).alias("framed"))
    s = tb.crossJoin(F.broadcast(files.agg(F.count(F.lit(1)).alias("n")))).withColumn("rtl", F.col("n") - F.col("benches"))
    ratio = F.when(F.col("rtl") > 0, F.col("benches") / F.col("rtl")).otherwise(0.0)
    s_ratio = F.when(ratio == 0, 0.0).otherwise(scalars.ladder(ratio, ((0.8, 100), (0.6, 85), (0.4, 70), (0.2, 50)), 30))
    mean = F.col("assertions") / F.greatest("benches", F.lit(1))
    s_assert = F.when(mean > 0, scalars.ladder(mean, ((5, 100), (2, 80)), 50)).otherwise(20.0)
    score = 0.3 * s_ratio + 0.25 * F.when(F.col("framed") > 0, 100.0).otherwise(40.0) + 0.2 * s_assert + 0.15 * F.when(F.col("coverage") > 0, 100.0).otherwise(0.0) + 0.1 * F.lit(50.0)
    return s.select("rtl", "benches", "assertions", "coverage", F.when(F.col("benches") > 0, score).otherwise(0.0).alias("score"))


def synthesis_score(f: DataFrame, files: DataFrame) -> DataFrame:
    """100 less 20 for each crossing, 15 for each unassigned register or block without a default, 8 for each integrity finding."""
    kinds = crossings(f, files).select(F.lit("cdc").alias("kind")).unionByName(unassigned(f, files).select(F.lit("uninit").alias("kind"))).unionByName(facts.blocks(f).where("no_default > 0").select(F.lit("uninit").alias("kind"))).unionByName(drivers(files).select(F.lit("integrity").alias("kind"))).unionByName(widths(files).select(F.lit("integrity").alias("kind")))
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return kinds.agg(n("cdc").alias("cdc"), n("uninit").alias("uninit"), n("integrity").alias("integrity")).withColumn("score", F.greatest(F.lit(0), 100 - 20 * F.col("cdc") - 15 * F.col("uninit") - 8 * F.col("integrity")))


def lint_score(files: DataFrame) -> DataFrame:
    """Severity counts, and a score with 15, 5, 2 and 0.5 points off for each finding, down to 0."""
    v = by_line(files, LINT, skip_comments=True)
    n = lambda k: F.count(F.when(F.col("severity") == k, 1))
    s = v.agg(n("critical").alias("critical"), n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"))
    return s.withColumn("score", scalars.clamp(100 - 15.0 * F.col("critical") - 5.0 * F.col("high") - 2.0 * F.col("medium") - 0.5 * F.col("low")))


def maintainability_score(files: DataFrame) -> DataFrame:
    m = maintainability(files).select("cc", scalars.maintainability_index(F.col("volume"), F.col("cc"), F.col("loc")).alias("mi"))
    return m.agg(F.count(F.lit(1)).alias("files"), F.avg("cc").alias("avg_cc"), F.avg("mi").alias("avg_mi"), F.min("mi").alias("min_mi"), F.max("mi").alias("max_mi"))


def complexity(f: DataFrame) -> DataFrame:
    """Over all blocks of kept facts: mean, median, lower-nearest 90th percentile by counts of equal values, maxima, thresholds and score."""
    b = facts.blocks(f)
    s = b.agg(F.count(F.lit(1)).alias("blocks"), F.avg("cc").alias("avg_cc"), F.percentile("cc", F.lit(0.5)).alias("median_cc"), F.max("cc").alias("max_cc"), F.max("cognitive").alias("max_cognitive"), F.max("nesting").alias("max_nesting"), F.count(F.when(F.col("loc") >= 80, 1)).alias("long"), F.count(F.when(F.col("bool_ops") >= 8, 1)).alias("bool_heavy"))
    # A row for each distinct complexity, of which there are few.
    counts = b.groupBy("cc").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.agg(F.array_sort(F.collect_list(F.struct("cc", "n"))).alias("all"), F.sum("n").alias("total"))
    p90 = F.expr("aggregate(all, named_struct('left', cast(floor(0.9 * (total - 1)) as bigint), 'cc', cast(null as int)), (a, x) -> named_struct('left', a.left - x.n, 'cc', if(a.cc is null and a.left < x.n, x.cc, a.cc))).cc")
    s = s.crossJoin(F.broadcast(sums.select(p90.alias("p90_cc"))))
    over = F.when(F.col("avg_cc") > 5, F.least(F.lit(30.0), F.round((F.col("avg_cc") - 5) * 2))).otherwise(0.0)
    worst = F.when(F.col("max_cc") > 25, F.least(F.lit(25), F.col("max_cc") - 25)).otherwise(0)
    return s.withColumn("score", scalars.clamp(100.0 - over - worst - F.least(F.lit(10), F.col("long")) - F.least(F.lit(6), F.col("bool_heavy"))))


def health(scores: DataFrame) -> DataFrame:
    """From (metric, score): the mean by weight of those there are, held down by three gates."""
    w = F.element_at(F.create_map(*[F.lit(x) for k, v in WEIGHTS.items() for x in (k, v)]), F.col("metric"))
    least = lambda k, floor, cap: F.coalesce(F.min(F.when((F.col("metric") == k) & (F.col("score") < floor), F.lit(cap))), F.lit(100.0))
    x = scores.where(w.isNotNull()).agg((F.sum(F.col("score") * w) / F.sum(w)).alias("mean"), least("synthesis_risk", 50, 45.0).alias("a"), least("lint", 40, 40.0).alias("b"), least("quality", 40, 50.0).alias("c"))
    score = scalars.clamp(F.least("mean", "a", "b", "c"))
    return x.select(F.round("mean", 6).alias("mean"), F.round(score, 1).alias("score"), scalars.grade(F.round(score, 1)).alias("grade"))


#: Advice by the least overall score that it holds for.
ADVICE = ((90, "ready"), (75, "refine a little"), (60, "look at synthesis risks and lint"), (40, "mend crossings, missing values and quality first"), (0, "not fit for synthesis"))
FAILING, ISSUES_EACH, ISSUES_IN_ALL = 60, 3, 10


def health_report(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """(kind, name, value): each metric's grade and score, the overall score, the gates that hold it down, the issues that come first, and advice.

    scores: (metric, score); issues: (metric, place, text). Of each metric below
    FAILING the first ISSUES_EACH issues by place are taken, texts that repeat
    count once, and the first ISSUES_IN_ALL by text are given.
    """
    row = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    known = scores.where(F.col("metric").isin(*WEIGHTS))
    out = row(known, "metric", F.concat_ws(" ", "metric", scalars.grade(F.col("score"))), F.col("score"))
    total = health(scores)
    out = out.unionByName(row(total, "overall", F.col("grade"), F.col("score"))).unionByName(row(total, "before gates", F.lit(None), F.round("mean", 1)))
    gates = F.create_map(*[F.lit(x) for k, v in (("synthesis_risk", 50), ("lint", 40), ("quality", 40)) for x in (k, v)])
    out = out.unionByName(row(scores.where(F.col("score") < F.element_at(gates, F.col("metric"))), "gate", F.col("metric"), F.col("score")))
    first = issues.join(F.broadcast(scores.where(F.col("score") < FAILING).select("metric")), "metric")  # a row for each metric
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("metric").orderBy("place", "text"))).where(F.col("r") <= ISSUES_EACH)
    out = out.unionByName(row(first.select("text").distinct().orderBy("text").limit(ISSUES_IN_ALL), "issue", F.col("text"), F.lit(None)))
    advice = F.lit(ADVICE[-1][1])
    for least, text in reversed(ADVICE[:-1]):
        advice = F.when(F.col("score") >= least, text).otherwise(advice)
    return out.unionByName(row(total, "advice", advice, F.lit(None)))


def issue_rows(f: DataFrame, files: DataFrame) -> DataFrame:
    """(metric, place, text): what quality, lint and crossings find, by file and line."""
    text = lambda rule, line: F.concat(rule, F.lit(" in file "), F.col("file_id").cast("string"), F.lit(" line "), line.cast("string"))
    row = lambda df, metric, rule, line: df.select(F.lit(metric).alias("metric"), F.struct(F.col("file_id").alias("f"), line.cast("int").alias("l")).alias("place"), text(rule, line).alias("text"))
    out = row(quality(files, f), "quality", F.col("rule"), F.col("line")).unionByName(row(by_line(files, LINT, skip_comments=True), "lint", F.col("rule"), F.col("line_no")))
    return out.unionByName(row(crossings(f, files), "synthesis_risk", F.lit("crossing"), F.col("line")))


def _health_report(s: SparkSession, d: str) -> DataFrame:
    files = _f(s, d)
    f = _kept(s, d)
    return health_report(staged(all_scores(f, files), "scores"), issue_rows(f, files))


#: The metrics' weights.
WEIGHTS = {"synthesis_risk": 0.25, "lint": 0.20, "quality": 0.15, "maintainability": 0.15, "complexity": 0.10, "hierarchy": 0.05, "documentation": 0.05, "verification": 0.05}


def all_scores(f: DataFrame, files: DataFrame) -> DataFrame:
    """(metric, score) of the metrics that stand on texts."""
    named = {"quality": quality_score(files, f), "lint": lint_score(files), "synthesis_risk": synthesis_score(f, files), "documentation": documentation_score(files), "verification": verification_score(files), "complexity": complexity(f)}
    out = None
    for name, df in named.items():
        row = df.select(F.lit(name).alias("metric"), F.col("score").cast("double").alias("score"))
        out = row if out is None else out.unionByName(row)
    return out


def _f(spark: SparkSession, d: str) -> DataFrame:
    return hdl_only(corpus.files(spark, d))


def _kept(s: SparkSession, d: str) -> DataFrame:
    return facts.kept(corpus.files(s, d))


QUERIES = {
    "f01_language": lambda s, d: corpus.files(s, d).select("file_id", language(F.col("path"), F.col("source")).alias("language")),
    "f02_by_language": lambda s, d: corpus.files(s, d).select(language(F.col("path"), F.col("source")).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n")),
    "f03_suffix_filter": lambda s, d: _f(s, d).select("file_id", suffix(F.col("path")).alias("suffix")),
    "f19_comment_lines": lambda s, d: facts.lines(_f(s, d)).where(F.trim("line").rlike(r"^(//|/\*|\*)")).groupBy("file_id").agg(F.count(F.lit(1)).alias("skipped")),
    "f20_testbench": lambda s, d: facts.of(s, d).where("kind = 'module'").select("name", testbench_name(F.col("name")).alias("testbench")),
    "f21_rtl_or_bench": lambda s, d: corpus.files(s, d).select("file_id", F.when(F.lower("path").rlike(r"(^|/)(tb|test|sim)/|_tb\.|tb_"), "testbench").otherwise("rtl").alias("kind")),
    "f22_system_packages": lambda s, d: facts.imports(facts.of(s, d)).where(~F.lower("package").isin(*SYSTEM_PACKAGES)).select("file_id", "package"),
    "f29_header_exclusion": lambda s, d: corpus.files(s, d).where(suffix(F.col("path")) == ".vh").where(~F.col("path").rlike(r"^inc/h\d*2\.vh$")).select("path"),
    "r01_quality": lambda s, d: quality(_f(s, d), facts.of(s, d)),
    "r02_style": lambda s, d: by_line(_f(s, d), STYLE).select("file_id", "line_no", "rule"),
    "r03_safety": lambda s, d: violations(_f(s, d).withColumn("source", uncommented("source")), SAFETY).select("file_id", "rule", "severity", "line"),
    "r04_lint": lambda s, d: by_line(_f(s, d), LINT, True),
    "r05_crossings": lambda s, d: crossings(facts.of(s, d), _f(s, d)),
    "r06_unassigned": lambda s, d: unassigned(facts.of(s, d), _f(s, d)),
    "r06_case_defaults": lambda s, d: facts.blocks(facts.of(s, d)).where("no_default > 0").select("file_id", "line"),
    "r07_drivers": lambda s, d: drivers(_f(s, d)),
    "r08_formatting": lambda s, d: maintainability(_f(s, d)).select("file_id", "long_lines", "tabs", "trailing", "todos", "guard", "case_without_default"),
    "r09_documentation": lambda s, d: documentation(_f(s, d)),
    "r10_verification": lambda s, d: verification(_f(s, d)),
    "r13_complexity_flags": lambda s, d: facts.module_info(facts.of(s, d)).where("cc > 2 or nesting > 4 or ports > 50 or lines > 300").select("module", F.when(F.col("cc") > 20, "critical").when(F.col("cc") > 10, "high").when(F.col("nesting") > 4, "medium").otherwise("low").alias("severity")),
    "r15_type_mismatch": lambda s, d: mismatches(facts.of(s, d)),
    "x13_clocks": lambda s, d: facts.blocks(facts.of(s, d)).select(F.explode(F.split("clocks", ",")).alias("clock")).where("clock <> ''").groupBy("clock").agg(F.count(F.lit(1)).alias("blocks")),
    "x14_drivers": lambda s, d: drivers(_f(s, d)).groupBy("target").agg(F.count(F.lit(1)).alias("files")),
    "a04_quality_score": lambda s, d: quality_score(_f(s, d), facts.of(s, d)),
    "a05_complexity": lambda s, d: complexity(_kept(s, d)),
    "a07_safety_score": lambda s, d: safety_score(_f(s, d)),
    "a08_maintainability_score": lambda s, d: maintainability_score(_f(s, d)).select("files", F.round("avg_cc", 6).alias("avg_cc"), (F.col("min_mi") <= F.col("avg_mi")).alias("low"), (F.col("avg_mi") <= F.col("max_mi")).alias("high")),
    "a09_documentation_score": lambda s, d: documentation_score(_f(s, d)),
    "a10_verification_score": lambda s, d: verification_score(_f(s, d)),
    "a11_synthesis_score": lambda s, d: synthesis_score(_kept(s, d), _f(s, d)),
    "a13_health": lambda s, d: health(all_scores(_kept(s, d), _f(s, d))),
    "a13_health_report": _health_report,
    "a18_lint_score": lambda s, d: lint_score(_f(s, d)),
    "a46_distinct_clocks": lambda s, d: facts.blocks(facts.of(s, d)).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("clocks", ","), lambda x: x != ""))))), ",").alias("clocks")),
}

_R, _H, _P, _I, _T = (f"part WHERE p_partkey % 8 {c}" for c in ("< 4", "= 4", "= 5", "= 6", "= 7"))
_QUALITY = f"""SELECT p_partkey AS file_id, 'HDL001' AS rule, 'high' AS severity, 1 AS hits, 16 AS line FROM {_R} AND p_partkey % 9 = 0 UNION ALL SELECT p_partkey, 'HDL003', 'medium', 1, 16 FROM {_R}
    UNION ALL SELECT p_partkey, 'HDL004', 'medium', 1, 5 FROM {_T} UNION ALL SELECT p_partkey, 'HDL006', 'high', 1, 6 FROM {_T}
    UNION ALL SELECT p_partkey, 'HDL007', 'critical', 1, 25 FROM {_R} AND p_partkey % 6 = 0 UNION ALL SELECT p_partkey, 'HDL008', 'medium', 1, 19 FROM {_R} AND p_partkey % 3 = 1"""
_STYLE = f"SELECT p_partkey AS file_id, 33 AS line_no, 'STYLE-LINELENGTH' AS rule FROM {_R} AND p_partkey % 10 = 0 UNION ALL SELECT p_partkey, 17, 'STYLE-TABS' FROM {_R} AND p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 17, 'STYLE-TODO' FROM {_R} AND p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 26, 'STYLE-TRAILWS' FROM {_R} AND p_partkey % 6 = 0"
_SAFETY = f"SELECT p_partkey AS file_id, 'HDL-DRC-003' AS rule, 'high' AS severity, 16 AS line FROM {_R} UNION ALL SELECT p_partkey, 'HDL-DRC-004', 'critical', 16 FROM {_R} AND p_partkey % 11 = 0 UNION ALL SELECT p_partkey, 'HDL-DRC-006', 'medium', 10 FROM {_R} UNION ALL SELECT p_partkey, 'HDL-DRC-006', 'medium', 2 FROM {_T} UNION ALL SELECT p_partkey, 'HDL-DRC-008', 'high', 16 FROM {_R}"
_LINT = f"""SELECT p_partkey AS file_id, 5 AS line_no, 'HDL-005' AS rule, 'medium' AS severity FROM {_T} UNION ALL SELECT p_partkey, 1, 'HDL-006', 'low' FROM {_T} UNION ALL SELECT p_partkey, 6, 'HDL-007', 'medium' FROM {_T} UNION ALL SELECT p_partkey, 9, 'HDL-006', 'low' FROM {_T} AND p_partkey % 24 = 7
    UNION ALL SELECT p_partkey, 1, 'HDL-006', 'low' FROM {_P} UNION ALL SELECT p_partkey, 9, 'HDL-006', 'low' FROM {_P} AND p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 11, 'HDL-006', 'low' FROM {_P} AND p_partkey % 24 = 5 UNION ALL SELECT p_partkey, 7, 'HDL-014', 'low' FROM {_P}
    UNION ALL SELECT p_partkey, u.l, 'HDL-014', 'low' FROM part, (VALUES (1), (4), (5)) u(l) WHERE p_partkey % 8 = 6 UNION ALL SELECT p_partkey, 4, 'HDL-019', 'high' FROM {_I}
    UNION ALL SELECT p_partkey, 19, 'HDL-008', 'medium' FROM {_R} UNION ALL SELECT p_partkey, 17, 'HDL-009', 'low' FROM {_R} UNION ALL SELECT p_partkey, 32, 'HDL-014', 'low' FROM {_R}
    UNION ALL SELECT p_partkey, 16, 'HDL-011', 'medium' FROM {_R} AND p_partkey % 11 = 0 UNION ALL SELECT p_partkey, 26, 'HDL-015', 'medium' FROM {_R} AND p_partkey % 6 = 0"""
ORACLE = {
    "f01_language": "SELECT p_partkey AS file_id, CASE WHEN p_partkey % 8 IN (4, 6) THEN 'verilog_header' WHEN p_partkey % 8 < 4 AND p_partkey % 2 = 1 THEN 'systemverilog' ELSE 'systemverilog' END AS language FROM part",
    "f02_by_language": "SELECT CASE WHEN p_partkey % 8 IN (4, 6) THEN 'verilog_header' ELSE 'systemverilog' END AS language, count(*) AS n FROM part GROUP BY 1",
    "f03_suffix_filter": "SELECT file_id, regexp_extract(path, '[.][a-z]+$') AS suffix FROM f_path",
    "f19_comment_lines": f"SELECT p_partkey AS file_id, 4 AS skipped FROM {_R}",
    "f20_testbench": "SELECT name, name LIKE 'tb%' AS testbench FROM f_def WHERE kind = 'module'",
    "f21_rtl_or_bench": "SELECT p_partkey AS file_id, CASE WHEN p_partkey % 8 = 7 THEN 'testbench' ELSE 'rtl' END AS kind FROM part",
    "f22_system_packages": "SELECT file_id, package FROM f_imp WHERE package <> 'uvm_pkg'",
    "f29_header_exclusion": "SELECT path FROM f_path WHERE path LIKE 'inc/%' AND path NOT LIKE '%2.vh'",
    "r01_quality": _QUALITY,
    "r02_style": _STYLE,
    "r03_safety": _SAFETY,
    "r04_lint": _LINT,
    "r05_crossings": f"SELECT p_partkey AS file_id, 'm' || p_partkey AS module, 16 AS line, 'clk,rst_n' AS clocks FROM {_R} AND p_partkey % 11 = 0",
    "r06_unassigned": f"SELECT p_partkey AS file_id, 'r1' AS name FROM {_R}",
    "r06_case_defaults": f"SELECT p_partkey AS file_id, 16 AS line FROM {_R} AND p_partkey % 3 = 1",
    "r07_drivers": f"SELECT p_partkey AS file_id, 'w1' AS target, 2 AS drivers FROM {_R} AND p_partkey % 6 = 0",
    "r08_formatting": "SELECT p_partkey AS file_id, CASE WHEN r AND p_partkey % 10 = 0 THEN 1 ELSE 0 END AS long_lines, CASE WHEN r AND p_partkey % 4 = 0 THEN 1 ELSE 0 END AS tabs, CASE WHEN r AND p_partkey % 6 = 0 THEN 1 ELSE 0 END AS trailing, CASE WHEN r AND p_partkey % 4 = 0 THEN 1 ELSE 0 END AS todos, p_partkey % 16 = 4 AS guard, r AND p_partkey % 3 = 1 AS case_without_default FROM (SELECT *, p_partkey % 8 < 4 AS r FROM part)",
    "r09_documentation": f"SELECT p_partkey AS file_id, true AS header, false AS ports_documented, 4 AS ports, 2 AS params, 0 AS params_documented FROM {_R} UNION ALL SELECT p_partkey, false, false, 0, 0, 0 FROM {_T} UNION ALL SELECT p_partkey, false, false, 0, 1, 0 FROM {_P} AND p_partkey % 24 = 5",
    "r10_verification": f"SELECT p_partkey AS file_id, CASE WHEN p_partkey % 16 = 7 THEN 'sva' ELSE '' END AS frameworks, CASE WHEN p_partkey % 16 = 7 THEN 1 ELSE 0 END AS assertions, CASE WHEN p_partkey % 24 = 7 THEN 1 ELSE 0 END AS coverage FROM {_T}",
    "r13_complexity_flags": "SELECT name AS module, 'low' AS severity FROM f_def WHERE kind = 'module' AND name LIKE 'm%'",
    "r15_type_mismatch": f"""SELECT p_partkey AS file_id, 'm' || p_partkey AS parent, 'm' || (2 * p_partkey) AS child, 'W' AS param, '"z"' AS value, '8' AS "default" FROM {_R} AND p_partkey % 7 = 0 AND 2 * p_partkey % 8 < 4 AND 2 * p_partkey <= (SELECT max(p_partkey) FROM part)""",
    "x13_clocks": f"SELECT 'clk' AS clock, count(*) AS blocks FROM {_R} UNION ALL SELECT 'rst_n', count(*) FROM {_R} AND p_partkey % 11 = 0",
    "x14_drivers": f"SELECT 'w1' AS target, count(*) AS files FROM {_R} AND p_partkey % 6 = 0",
    "a04_quality_score": f"WITH v AS (SELECT severity, hits FROM ({_QUALITY}) UNION ALL SELECT 'low', 1 FROM ({_STYLE})), s AS (SELECT sum(hits)::BIGINT AS violations, sum(hits * CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 2 ELSE 1 END)::DOUBLE AS weight FROM v), t AS (SELECT (SELECT count(*) FROM part) AS files, * FROM s) SELECT *, greatest(0, 100 - 2 * weight / files) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM t",
    "a05_complexity": f"WITH b AS (SELECT 3 AS cc FROM {_R} UNION ALL SELECT 1 FROM {_T}), o AS (SELECT cc, row_number() OVER (ORDER BY cc) - 1 AS r, count(*) OVER () AS n FROM b) SELECT count(*) AS blocks, avg(cc) AS avg_cc, median(cc) AS median_cc, max(cc) AS max_cc, 5 AS max_cognitive, 2 AS max_nesting, 0 AS long, 0 AS bool_heavy, max(cc) FILTER (WHERE r = floor(0.9 * (n - 1))) AS p90_cc, 100.0 AS score FROM o",
    "a07_safety_score": f"WITH v AS (SELECT file_id, CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 6 WHEN 'medium' THEN 3 ELSE 1 END AS p FROM ({_SAFETY})), e AS (SELECT file_id, sum(p) AS points, max(p) AS worst FROM v GROUP BY file_id) SELECT (SELECT count(*) FROM part) AS files, count(*) FILTER (WHERE worst >= 6) AS risky, count(*) FILTER (WHERE worst >= 10) AS critical, sum(points)::DOUBLE AS points, least(50.0, greatest(0, 100 - 10 * sqrt(sum(points) / (SELECT count(*) FROM part)))) AS score FROM e",
    "a08_maintainability_score": "SELECT count(*) AS files, round(avg(CASE WHEN p_partkey % 8 < 4 THEN CASE WHEN p_partkey % 4 = 0 THEN 4 ELSE 5 END ELSE 1 END), 6) AS avg_cc, true AS low, true AS high FROM part",
    "a09_documentation_score": f"WITH s AS (SELECT (SELECT count(*) FROM {_R}) AS r, (SELECT count(*) FROM {_T}) AS t, (SELECT count(*) FROM {_R}) AS headers, (SELECT count(*) FROM {_P} AND p_partkey % 24 = 5) AS l) SELECT r + t + l AS modules, headers, 4 * r AS ports, 2 * r + l AS params, 0.4 * CASE WHEN headers / (7 * r + t + 2 * l) >= 0.2 THEN 45 ELSE 25 END + 0.25 * CASE WHEN headers / (r + t + l) >= 0.8 THEN 100 WHEN headers / (r + t + l) >= 0.6 THEN 85 WHEN headers / (r + t + l) >= 0.4 THEN 65 WHEN headers / (r + t + l) >= 0.2 THEN 45 ELSE 25 END + 0.2 * 25 + 0.15 * 25 AS score FROM s",
    "a10_verification_score": f"WITH s AS (SELECT count(*) AS benches, count(*) FILTER (WHERE p_partkey % 16 = 7) AS assertions, count(*) FILTER (WHERE p_partkey % 24 = 7) AS coverage FROM {_T}) SELECT (SELECT count(*) FROM part) - benches AS rtl, benches, assertions, coverage, 0.3 * 30 + 25 + 0.2 * 50 + 15 + 5 AS score FROM s",
    "a11_synthesis_score": f"WITH s AS (SELECT (SELECT count(*) FROM {_R} AND p_partkey % 11 = 0) AS cdc, (SELECT count(*) FROM {_R}) + (SELECT count(*) FROM {_R} AND p_partkey % 3 = 1) AS uninit, (SELECT count(*) FROM {_R} AND p_partkey % 6 = 0) AS integrity) SELECT *, greatest(0, 100 - 20 * cdc - 15 * uninit - 8 * integrity) AS score FROM s",
    "a18_lint_score": f"WITH s AS (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM ({_LINT})) SELECT *, greatest(0.0, 100 - 15 * critical - 5 * high - 2 * medium - 0.5 * low) AS score FROM s",
    "a46_distinct_clocks": "SELECT 'clk,rst_n' AS clocks",
}
_SCORED = " UNION ALL ".join(f"SELECT '{k}' AS metric, score::DOUBLE AS score, {WEIGHTS[k]}::DOUBLE AS w FROM ({ORACLE[q]})" for k, q in (("quality", "a04_quality_score"), ("lint", "a18_lint_score"), ("synthesis_risk", "a11_synthesis_score"), ("documentation", "a09_documentation_score"), ("verification", "a10_verification_score"), ("complexity", "a05_complexity")))
ORACLE["a13_health"] = f"WITH s AS ({_SCORED}), m AS (SELECT sum(score * w) / sum(w) AS mean, min(CASE WHEN metric = 'synthesis_risk' AND score < 50 THEN 45 WHEN metric = 'lint' AND score < 40 THEN 40 WHEN metric = 'quality' AND score < 40 THEN 50 ELSE 100 END) AS cap FROM s), r AS (SELECT round(mean, 6) AS mean, round(least(mean, cap), 1) AS score FROM m) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM r"
ORACLE["a13_health_report"] = f"""
    WITH s AS ({_SCORED}), g AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s),
    h AS ({ORACLE["a13_health"]}),
    i AS (SELECT 'quality' AS metric, file_id, line, rule FROM ({_QUALITY}) UNION ALL SELECT 'lint', file_id, line_no, rule FROM ({_LINT}) UNION ALL SELECT 'synthesis_risk', file_id, line, 'crossing' FROM ({ORACLE["r05_crossings"]})),
    t AS (SELECT metric, file_id, line, rule || ' in file ' || file_id || ' line ' || line AS text FROM i),
    r AS (SELECT text, row_number() OVER (PARTITION BY metric ORDER BY file_id, line, text) AS r FROM t WHERE metric IN (SELECT metric FROM s WHERE score < 60))
    SELECT 'metric' AS kind, metric || ' ' || grade AS name, score AS value FROM g UNION ALL SELECT 'overall', grade, score FROM h UNION ALL SELECT 'before gates', NULL, round(mean, 1) FROM h
    UNION ALL SELECT 'gate', metric, score FROM s WHERE metric = 'synthesis_risk' AND score < 50 OR metric IN ('lint', 'quality') AND score < 40
    UNION ALL (SELECT 'issue', text, NULL FROM (SELECT DISTINCT text FROM r WHERE r <= 3) ORDER BY text LIMIT 10)
    UNION ALL SELECT 'advice', CASE WHEN score >= 90 THEN 'ready' WHEN score >= 75 THEN 'refine a little' WHEN score >= 60 THEN 'look at synthesis risks and lint' WHEN score >= 40 THEN 'mend crossings, missing values and quality first' ELSE 'not fit for synthesis' END, NULL FROM h"""
