"""Reports as flat records and documents, retrieval over decisions and rules, and the tables of a review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import corpus, matching, retrieval
from . import rules as catalog

#: An analyzer takes (file_id, path, source) and gives findings; others may register theirs.
Analyzer = Callable[[DataFrame], DataFrame]
ANALYZERS: dict[str, Analyzer] = {}


def analyzer(name: str) -> Callable[[Analyzer], Analyzer]:
    def add(f: Analyzer) -> Analyzer:
        ANALYZERS[name] = f
        return f

    return add


def analyze(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(analyzer, file_id, rule, severity) of the registered analyzers."""
    out = None
    for name in names if names is not None else sorted(ANALYZERS):
        rows = ANALYZERS[name](files).select(F.lit(name).alias("analyzer"), "file_id", "rule", "severity")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else files.select(F.lit("").alias("analyzer"), "file_id", F.lit("").alias("rule"), F.lit("").alias("severity")).limit(0)


def without_empty(rows: DataFrame) -> DataFrame:
    """Rows of which some value is neither null nor an empty text."""
    return rows.where(F.exists(F.array(*[F.col(c).cast("string") for c in rows.columns]), lambda x: x.isNotNull() & (x != "")))


def flatten(reports: DataFrame) -> DataFrame:
    """(report_id, record_type, id, payload) of (report_id, report): a report is JSON text.

    Each kind of record has a path in the report: an object gives one record, an
    array one for each element. Records without any value are left out.
    """
    out = None
    for kind, (path, many) in RECORDS.items():
        found = F.try_parse_json("report")
        if many:
            items = F.explode(F.try_variant_get(found, path, "array<string>"))
            rows = reports.select("report_id", items.alias("payload"))
        else:
            rows = reports.select("report_id", F.try_variant_get(found, path, "string").alias("payload"))
        rows = rows.where("payload is not null and payload not in ('', '{}', '[]', 'null')").select("report_id", F.lit(kind).alias("record_type"), F.md5(F.concat_ws("|", F.lit(kind), F.col("report_id").cast("string"), "payload")).alias("id"), "payload")
        out = rows if out is None else out.unionByName(rows)
    return out


#: The kinds of records and where a report holds them.
RECORDS = {
    "codebase_summary": ("$.summary", False), "dependency_summary": ("$.dependency_graph.summary", False), "metric_summary": ("$.metrics", True), "documentation_summary": ("$.documentation.summary", False),
    "documentation_item": ("$.documentation.missing", True), "modularization_summary": ("$.modularization.summary", False), "modularization_step": ("$.modularization.steps", True), "validation_summary": ("$.validation.summary", False),
    "validation_check": ("$.validation.checks", True), "quality_violation": ("$.quality.violations", True), "security_violation": ("$.security.violations", True), "complexity_hotspot": ("$.complexity.top_blocks", True),
    "file_health": ("$.files", True), "untested_source": ("$.verification.untested", True), "critical_issue": ("$.critical_issues", True), "dependency_node": ("$.dependency_graph.nodes", True),
    "dependency_edge": ("$.dependency_graph.edges", True), "adapter_summary": ("$.adapters", True), "adapter_finding": ("$.adapter_findings", True),
}


def documents(records: DataFrame) -> DataFrame:
    """(uuid, record_type, page_content): a heading and ``Label: value`` lines, by an id that does not depend on the order of keys."""
    pairs = F.map_entries(F.from_json("payload", "map<string,string>"))
    lines = F.transform(F.array_sort(pairs), lambda e: F.concat(F.initcap(F.translate(e["key"], "_", " ")), F.lit(": "), e["value"]))
    whole = F.when(F.col("payload").startswith("{"), F.array_join(lines, "\n")).otherwise(F.col("payload"))
    content = F.concat(F.lit("# "), F.initcap(F.translate("record_type", "_", " ")), F.lit("\n"), whole)
    return records.select(F.md5(F.concat_ws("|", "record_type", F.col("report_id").cast("string"), whole)).alias("uuid"), "record_type", content.alias("page_content"))


def ingest(rows: DataFrame, table: DataFrame | None, batch: int = 500) -> tuple[DataFrame, DataFrame]:
    """The rows to add (uuids that the table has are left out), and what became of each batch of rows in order of uuid."""
    fresh = rows.dropDuplicates(["uuid"])
    if table is not None:
        fresh = fresh.join(table.select("uuid"), "uuid", "left_anti")
    known = fresh.select("uuid", F.lit(1).alias("new"))
    # Batches by a range of uuids: evenly spread, and no single task numbers all rows.
    number = F.conv(F.substring("uuid", 1, 7), 16, 10).cast("long")
    n = rows.select("uuid").distinct().count()
    marked = rows.select("uuid").distinct().join(known, "uuid", "left").withColumn("batch", F.floor(number * F.lit(max(1, -(-n // batch))) / F.lit(1 << 28)))
    return fresh, marked.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.count("new").alias("added"))


def directives(rows: DataFrame) -> DataFrame:
    """Directives of review rows: empty feedback approves, words tell the action, rows without a file or to be skipped go."""
    text = F.lower(F.concat_ws(" ", scalars.safe_text(F.col("feedback")), scalars.safe_text(F.col("constraints"))))
    action = infer(text, F.col("constraints"))
    file = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("file_path", "file")])
    return rows.select("row_id", file.alias("file_path"), action.alias("action"), scalars.filled(F.col("severity"), "medium").alias("severity")).where("file_path is not null and action <> 'SKIP'")


def infer(text: Column, constraints: Column) -> Column:
    """Words to skip come first, then given constraints, then words of review; else a fix."""
    return F.when(text.rlike(r"\b(skip|ignore|false positive|won't fix|wontfix)\b"), "SKIP").when(scalars.safe_text(constraints) != "", "FIX_WITH_CONSTRAINTS").when(text.rlike(r"\b(review|check|verify|unsure)\b"), "NEEDS_REVIEW").otherwise("FIX")


def issue_blocks(reviews: DataFrame, separator: str = r"\n-{3,}\n") -> DataFrame:
    """(review_id, title, severity, line, code) of (review_id, text, start, source): blocks of labelled fields with fenced code.

    The line is where the code's first line stands in the source, counted from
    ``start``; a snippet that is not there keeps the line that the block states.
    """
    block = reviews.select("review_id", "start", "source", F.posexplode(F.split("text", separator)).alias("n", "block"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("block", rf"(?im)^\s*{name}\s*:\s*(.*)$", 1)), F.lit(""))
    code = fenced(F.col("block"))
    first = F.trim(F.split(code, "\n")[0])
    at = F.when(F.length(first) > 0, F.instr(F.col("source"), first)).otherwise(0)
    stated = field("Line").try_cast("int")
    line = F.when(at > 0, F.col("start") - 1 + scalars.line_of(F.col("source"), at)).otherwise(stated)
    return block.select("review_id", "n", field("Title").alias("title"), F.initcap(field("Severity")).alias("severity"), line.cast("int").alias("line"), code.alias("code")).where("title is not null")


def fenced(text: Column) -> Column:
    """The inside of the first fence, without blank lines around; empty without one."""
    return F.regexp_replace(F.regexp_extract(text, r"(?s)```[\w+-]*[ \t]*\n(.*?)```", 1), r"^(?:[ \t]*\n)+|\s+$", "")


def json_of(text: Column) -> Column:
    """The JSON in a fence or in the text itself as a variant; null where there is none."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n(.*?)```", 1)
    return F.try_parse_json(F.when(F.trim(inside) != "", inside).otherwise(text))


def write_back(table: DataFrame, edits: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """The table with edited values where trimmed keys agree; of several edits the last by order counts; ``matched`` tells which rows."""
    k = [F.trim(F.col(c).cast("string")).alias(f"k{i}") for i, c in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    last = edits.select(*k, F.col(order).alias("o"), F.col(column).alias("v")).groupBy(*names).agg(F.max_by("v", "o").alias("v"), F.lit(True).alias("hit"))
    out = table.select("*", *k).join(last, names, "left")
    return out.select(*[F.coalesce("v", column).alias(column) if c == column else F.col(c) for c in table.columns], F.coalesce("hit", F.lit(False)).alias("matched"))


def layers(files: DataFrame, notes: DataFrame) -> DataFrame:
    """(file_id, text): notes for all, for the codebase and for the file's own stem, in that order with headings."""
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1)
    wanted = files.select("file_id", F.explode(F.array(F.struct(F.lit(1).alias("layer"), F.lit("common").alias("name")), F.struct(F.lit(2).alias("layer"), F.lit("codebase").alias("name")), F.struct(F.lit(3).alias("layer"), stem.alias("name")))).alias("x")).select("file_id", "x.*")
    first = notes.groupBy("name").agg(F.min_by("text", "doc").alias("text"))
    found = wanted.join(first, "name").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("layer", F.concat(F.lit("## "), "name", F.lit("\n"), "text").alias("part")))).alias("parts"))
    return found.select("file_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n").alias("text"))


def applicable(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """(issue_id, rule_id): rules whose id is in the issue's type, or that share a word of four letters or more with it, or a glob of whose fits its path.

    Words meet by equality; ids and globs meet distinct types and paths by their
    grams (see ``matching``).
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]{4,}"), F.lit(0)))
    shared = issues.select("issue_id", F.explode(words("issue_type")).alias("word")).join(rules.select("rule_id", F.explode(words("description")).alias("word")), "word").select("issue_id", "rule_id")
    low = F.lower(F.col("rule_id").cast("string"))
    types = matching.contained(issues.select(F.lower("issue_type").alias("text")), rules.select(low.alias("needle")))
    by_id = issues.join(types, F.lower("issue_type") == F.col("text")).join(rules.withColumn("needle", low), "needle").select("issue_id", "rule_id")
    fits = matching.fitting(issues.select(F.col("path").alias("text")), rules.select(F.col("pattern").alias("glob")))
    by_path = issues.join(fits, F.col("path") == F.col("text")).join(rules, F.col("pattern") == F.col("glob")).select("issue_id", "rule_id")
    return shared.unionByName(by_id).unionByName(by_path).distinct()


def feedback(issues: DataFrame, decisions: DataFrame, rules: DataFrame, k: int = 5) -> DataFrame:
    """(issue_id, decisions, rules, score): decisions of the issue's type or file, those of its severity if there are any, the k best by action and time, and the rules that apply."""
    by_type = issues.join(decisions, "issue_type").select("issue_id", issues["severity"].alias("want"), decisions["id"], decisions["severity"], "action", "decided_at")
    by_file = issues.join(decisions.withColumnRenamed("issue_type", "d_type"), issues["path"] == decisions["file_path"]).select("issue_id", issues["severity"].alias("want"), decisions["id"], decisions["severity"], "action", "decided_at")
    found = by_type.unionByName(by_file).dropDuplicates(["issue_id", "id"])
    same = F.col("severity") == F.col("want")
    found = found.withColumn("any", F.max(same).over(Window.partitionBy("issue_id"))).where(same | ~F.col("any"))
    weight = F.when(F.col("action") == "FIX_WITH_CONSTRAINTS", 3).when(F.col("action") == "FIX", 2).when(F.col("action") == "NEEDS_REVIEW", 1).otherwise(0)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("issue_id").orderBy(F.desc(weight), F.desc("decided_at"), "id"))).where(F.col("r") <= k)
    d = best.groupBy("issue_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("decisions"), F.count(F.lit(1)).alias("n_d"))
    r = applicable(issues, rules).groupBy("issue_id").agg(F.count(F.lit(1)).alias("n_r"))
    out = issues.select("issue_id").join(d, "issue_id", "left").join(r, "issue_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select("issue_id", F.coalesce("decisions", F.lit("")).alias("decisions"), n("n_r").alias("rules"), scalars.retrieval_score(n("n_d"), n("n_r")).alias("score"))


# The queries' relations, from the star schema.


def _runs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet")


def _finds(s: SparkSession, d: str) -> DataFrame:
    li = s.read.parquet(f"{d}/lineitem.parquet")
    severity = F.when(F.col("l_discount") >= 0.08, "critical").when(F.col("l_discount") >= 0.05, "high").when(F.col("l_discount") >= 0.02, "medium").otherwise("low")
    return li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("file_key"), F.col("l_returnflag").alias("category"), severity.alias("severity"))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    l, t = s.read.parquet(f"{d}/labels.parquet"), s.read.parquet(f"{d}/documents.parquet")
    action = F.when(F.col("toxic") == 1, "SKIP").when(F.col("quality") == 1, "FIX").when(F.col("doc_id") % 3 == 0, "NEEDS_REVIEW").otherwise("FIX_WITH_CONSTRAINTS")
    return l.join(t, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("file_path"), F.col("source").alias("issue_type"), action.alias("action"), F.col("n_chars").alias("decided_at"), F.when(F.col("doc_id") % 2 == 0, "high").otherwise("low").alias("severity"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "int"))


def _issues(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("issue_id"), F.concat(F.lit("src"), (F.col("n_nationkey") % 20).cast("string")).alias("issue_type"), F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("xx")), F.col("n_nationkey") % 3 + 1).alias("path"), F.when(F.col("n_nationkey") % 4 == 0, "critical").otherwise("high").alias("severity"))


def _rules(s: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    return s.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("c1"), k.cast("string")).alias("rule_id"), F.concat(F.lit("rule about thing"), k.cast("string")).alias("description"), F.when(k % 2 == 0, F.element_at(F.array(F.lit("e*"), F.lit("f*"), F.lit("x?")), k % 3 + 1)).alias("pattern"))


def _reports(s: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    t = k.cast("string")
    report = F.concat(F.lit('{"summary": {"files": '), t, F.lit(', "name": "n'), t, F.lit('"}, "metrics": [{"metric": "lint", "score": 5}, {"metric": "quality", "score": 9}], "critical_issues": ["stop '), t, F.lit('"], "files": ['), F.when(k % 2 == 0, F.lit('{"file": "a.v"}')).otherwise(""), F.lit('], "validation": {"summary": {}}}'))
    return s.read.parquet(f"{d}/nation.parquet").select(k.alias("report_id"), report.alias("report"))


def _review_rows(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    words = F.when(k % 5 == 0, "Skip this").when(k % 5 == 1, "").when(k % 5 == 2, "please check").otherwise(None)
    return _runs(s, d).select(k.alias("row_id"), words.alias("feedback"), F.when(k % 3 == 0, "keep ports").otherwise("  ").alias("constraints"), F.when(k % 7 == 0, " ").otherwise("a.v").alias("file_path"), F.when(k % 14 == 0, "b.v").alias("file"), F.when(k % 2 == 0, "high").alias("severity"))


def _reviews(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = k.cast("string")
    text = F.concat(F.lit("Title: wide net "), t, F.lit("\nSeverity: HIGH\nLine: 99\n```verilog\n\nassign y"), t, F.lit(" = 1;\n```\n-----\nTitle: lost\nSeverity: low\nLine: 7\n```\nnot there\n```\n----\nno title"))
    return s.read.parquet(f"{d}/part.parquet").select(k.alias("review_id"), F.lit(10).alias("start"), text.alias("text"), F.concat(F.lit("module m;\nwire y;\nassign y"), t, F.lit(" = 1;\nendmodule")).alias("source"))


def _turns(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/conversations.parquet")


def _first(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet")


QUERIES = {
    "s06_records": lambda s, d: s.createDataFrame([("[1, 2]",), ('{"a": 1}',), ("",), ("{",)], "value string").where(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")),
    "s08_report_text": lambda s, d: _reports(s, d).select("report_id", F.try_variant_get(F.try_parse_json("report"), "$.summary.name", "string").alias("name")),
    "s13_csv_cells": lambda s, d: _runs(s, d).select(F.to_csv(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")).alias("line")),
    "s14_metric_reports": lambda s, d: _runs(s, d).groupBy(F.col("o_orderstatus").alias("metric_name")).agg(F.count(F.lit(1)).alias("n")).select("metric_name", F.to_json(F.struct("metric_name", "n")).alias("report")),
    "s15_review_lines": lambda s, d: _finds(s, d).select(F.concat_ws("::", F.col("run_id").cast("string"), F.col("line").cast("string"), "category").alias("id"), F.col("severity").alias("level")),
    "s16_directive_lines": lambda s, d: directives(_review_rows(s, d)).select(F.to_json(F.struct("row_id", "file_path", "action")).alias("line")),
    "s25_llm_calls": lambda s, d: _events(s, d).where("event_type = 'purchase'").select("event_id", (F.col("k") + F.floor("value")).alias("total_tokens"), scalars.cost(F.col("k"), F.floor("value"), F.lit(3), F.lit(15)).alias("cost")),
    "s27_documents_by_type": lambda s, d: documents(flatten(_reports(s, d))).groupBy("record_type").agg(F.count(F.lit(1)).alias("n")),
    "s28_recorded_decisions": lambda s, d: _decisions(s, d).select("id", "action").unionByName(_issues(s, d).select((F.col("issue_id") + 10**9).alias("id"), F.lit("AGENT").alias("action"))),
    "f05_findings_tab": lambda s, d: _finds(s, d).where("severity = 'critical' and category = 'R'").groupBy("run_id").agg(F.count(F.lit(1)).alias("n")),
    "f09_metadata_filter": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("meta")).where((F.col("meta")["lang"] == "en") & (F.col("meta")["source"] == "src1")).select("doc_id"),
    "f11_metadata_projection": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.to_json(F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), lambda k, v: v.isNotNull() & k.isin("lang"))).alias("meta")),
    "f12_compact_metrics": lambda s, d: _finds(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("n")).select("category", F.concat(F.lit("["), F.col("n").cast("string"), F.lit(" items]")).alias("issues"), scalars.grade(F.col("n") % 100).alias("grade")),
    "f15_feedback_rows": lambda s, d: _review_rows(s, d).select("row_id", scalars.filled(F.col("feedback"), "Approve").alias("Feedback"), scalars.filled(F.col("constraints"), "None").alias("Constraints"), scalars.filled(F.col("severity"), "medium").alias("Severity")),
    "f17_directives": lambda s, d: directives(_review_rows(s, d)),
    "f24_sections": lambda s, d: _turns(s, d).where("role = 'user'").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(F.lower("text").contains("the"), "summary"), F.when(F.lower("text").contains("a"), "metrics"), F.when(F.lower("text").contains("e"), "summary"))))), " OR ").alias("sections")),
    "f25_report_figures": lambda s, d: _reports(s, d).select("report_id", F.coalesce(F.try_variant_get(F.try_parse_json("report"), "$.metrics[0].score", "int"), F.lit(0)).alias("lint"), F.coalesce(F.try_variant_get(F.try_parse_json("report"), "$.metrics[7].score", "int"), F.lit(0)).alias("other")),
    "f27_file_fields": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1).alias("file_name")),
    "j22_rules_for_issues": lambda s, d: applicable(_issues(s, d), _rules(s, d)),
    "j24_worst_by_file": lambda s, d: _first(_finds(s, d).groupBy("category", "file_key").agg(F.count(F.lit(1)).alias("n")), ["category"], [F.desc("n"), F.col("file_key")], 1).select("category", "file_key", "n"),
    "j25_merged_edits": lambda s, d: write_back(_review_rows(s, d).select("row_id", "severity"), _review_rows(s, d).where("row_id % 4 = 0").select("row_id", F.lit("edited").alias("severity"), F.lit(1).alias("o")), ["row_id"], "severity", "o"),
    "j27_layers": lambda s, d: layers(s.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("file_id"), F.concat(F.lit("rtl/m"), F.col("r_regionkey").cast("string"), F.lit(".v")).alias("path")), s.createDataFrame([(1, "codebase", "B"), (2, "common", "A"), (3, "m2", "C"), (4, "common", "Z")], "doc int, name string, text string")),
    "j28_feedback_write_back": lambda s, d: write_back(_decisions(s, d).select("id", "file_path", "issue_type", "action"), _decisions(s, d).where("id % 5 = 0").select(F.concat(F.lit(" "), "file_path").alias("file_path"), "issue_type", "action", "id"), ["file_path", "issue_type"], "action", "id").select("id", "action", "matched"),
    "j29_rules_text": lambda s, d: applicable(_issues(s, d), _rules(s, d)).groupBy("issue_id").agg(F.array_join(F.array_sort(F.collect_list("rule_id")), "; ").alias("rules")),
    "j30_second_retrieval": lambda s, d: retrieval.nearest(_vectors(s, d), _vectors(s, d).where("vec_id % 100 = 0"), 3, metric="l2").select("query_id", "vec_id", "rank"),
    "a41_average_priority": lambda s, d: _finds(s, d).groupBy("category").agg(F.avg(scalars.points(F.col("severity"), scalars.PRIORITY)).alias("p")).select("category", F.when(F.col("p") >= 3.5, "critical").when(F.col("p") >= 2.5, "high").when(F.col("p") >= 1.5, "medium").otherwise("low").alias("priority")),
    "a42_failing_metrics": lambda s, d: _finds(s, d).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 100 < 60).groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("severity")), ",").alias("failing")),
    "a43_check_counts": lambda s, d: _finds(s, d).groupBy(F.col("category").alias("check")).agg(F.count(F.when(F.col("severity") != "critical", 1)).alias("passed"), F.count(F.when(F.col("severity") == "critical", 1)).alias("failed")),
    "a47_severity_rollup": lambda s, d: _finds(s, d).groupBy("run_id").pivot("severity", ["critical", "high", "medium", "low"]).agg(F.count(F.lit(1))).na.fill(0),
    "a49_by_file": lambda s, d: directives(_review_rows(s, d)).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first")),
    "a51_review_totals": lambda s, d: _finds(s, d).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.contains(F.lower("severity"), F.lit("critical")), 1)).alias("critical"), F.count(F.when(F.contains(F.lower("severity"), F.lit("high")), 1)).alias("high")),
    "a52_prompt_context": lambda s, d: s.read.parquet(f"{d}/documents.parquet").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first")),
    "a53_flagged_bars": lambda s, d: _events(s, d).select("event_id", F.regexp_extract("props", r"(\d+)", 1).try_cast("int").alias("cc")).where("cc > 0").orderBy("event_id").limit(15).withColumn("width", F.round(F.col("cc") / F.max("cc").over(Window.partitionBy(F.lit(1))), 6)),
    "a54_first_by_severity": lambda s, d: _first(_finds(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("severity"))), ["severity"], [F.col("run_id"), F.col("line"), F.col("file_key")], 10).select("severity", "run_id", "line", F.greatest(F.lit(0), F.col("n") - 10).alias("more")),
    "a55_recommendations": lambda s, d: _finds(s, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n")).where("n > 10").select("severity", F.when(F.col("severity").isin("critical", "high"), "fix first").otherwise("plan").alias("advice")),
    "w16_chat_summary": lambda s, d: _turns(s, d).groupBy("conv_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), 1, 1000).alias("summary")).select("conv_id", F.md5("summary").alias("digest")),
    "o09_missing_docs": lambda s, d: _runs(s, d).select("o_orderkey").orderBy("o_orderkey").limit(200),
    "o10_document_caps": lambda s, d: _finds(s, d).groupBy("category").agg(F.slice(F.array_sort(F.collect_set("file_key")), 1, 10).alias("files")).select("category", F.array_join("files", ",").alias("files")),
    "u05_shared_words": lambda s, d: s.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.array_join(F.array_sort(F.array_intersect(F.split(F.lower("text"), " "), F.array(F.lit("the"), F.lit("a"), F.lit("of")))), ",").alias("words")),
    "x16_issue_blocks": lambda s, d: issue_blocks(_reviews(s, d)).select("review_id", "title", "severity", "line", "code"),
    "x17_json": lambda s, d: _events(s, d).select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note\n```json\n"), "props", F.lit("\n```\nend"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("no json").alias("t")).select("event_id", F.try_variant_get(json_of(F.col("t")), "$.k", "int").alias("k"), json_of(F.col("t")).isNull().alias("parse_error")),
    "x19_fenced_code": lambda s, d: _reviews(s, d).select("review_id", fenced(F.col("text")).alias("code")),
    "v04_compare": lambda s, d: retrieval.nearest(_vectors(s, d), _vectors(s, d).where("vec_id % 100 = 0"), 2).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("hits")),
    "v05_embedding_documents": lambda s, d: documents(flatten(_reports(s, d))).where("record_type = 'critical_issue'").select("page_content"),
    "v06_batches": lambda s, d: ingest(_uuids(s, d), _uuids(s, d).where("doc_id % 2 = 0"), 100)[1].agg(F.sum("rows").alias("rows"), F.sum("added").alias("added")),
    "v07_append": lambda s, d: ingest(_uuids(s, d), None)[0].agg(F.count(F.lit(1)).alias("n")),
    "v08_feedback": lambda s, d: feedback(_issues(s, d), _decisions(s, d), _rules(s, d)),
    "v09_suggestions": lambda s, d: _decisions(s, d).groupBy("issue_type").agg(F.array_join(F.slice(F.array_sort(F.collect_set("action")), 1, 10), ", ").alias("suggestions")),
    "v10_flatten": lambda s, d: flatten(_reports(s, d)).groupBy("report_id", "record_type").agg(F.count(F.lit(1)).alias("n")),
    "v12_sections": lambda s, d: _reports(s, d).select("report_id", F.explode(F.array(F.lit("summary"), F.lit("metrics"), F.lit("files"))).alias("section")).select("report_id", "section", F.md5(F.concat_ws("|", F.col("report_id").cast("string"), "section")).alias("id")),
    "v13_overview": lambda s, d: _finds(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("file_key").alias("files")),
    "v14_diagram": lambda s, d: s.read.parquet(f"{d}/nation.parquet").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(" --> "), scalars.node_name(F.col("n_name"))))), "\n").alias("text")).select("n_regionkey", F.concat(F.lit("graph TD\n"), "text").alias("text")),
    "t03_log_until_mark": lambda s, d: _events(s, d).withColumn("done", F.max(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("done = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("drained")),
    "c01_analyzers": lambda s, d: _analyzed(s, d),
}


def _uuids(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5("text").alias("uuid"))


def _analyzed(s: SparkSession, d: str) -> DataFrame:
    @analyzer("style")
    def style(files: DataFrame) -> DataFrame:
        return catalog.by_line(files, catalog.STYLE)

    return analyze(corpus.files(s, d), ["style"]).groupBy("analyzer", "rule").agg(F.count(F.lit(1)).alias("n"))


_FI = "(SELECT l_orderkey AS run_id, l_linenumber AS line, l_partkey AS file_key, l_returnflag AS category, CASE WHEN l_discount >= 0.08 THEN 'critical' WHEN l_discount >= 0.05 THEN 'high' WHEN l_discount >= 0.02 THEN 'medium' ELSE 'low' END AS severity FROM lineitem)"
_D = "(SELECT doc_id AS id, lang AS file_path, source AS issue_type, CASE WHEN toxic = 1 THEN 'SKIP' WHEN quality = 1 THEN 'FIX' WHEN doc_id % 3 = 0 THEN 'NEEDS_REVIEW' ELSE 'FIX_WITH_CONSTRAINTS' END AS action, n_chars AS decided_at, CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM labels JOIN documents USING (doc_id))"
_I = "(SELECT n_nationkey AS issue_id, 'src' || (n_nationkey % 20) AS issue_type, ['en', 'fr', 'xx'][n_nationkey % 3 + 1] AS path, CASE WHEN n_nationkey % 4 = 0 THEN 'critical' ELSE 'high' END AS severity FROM nation)"
_RULES = "(SELECT 'c1' || r_regionkey AS rule_id, CASE r_regionkey WHEN 0 THEN 'e' WHEN 4 THEN 'f' WHEN 2 THEN 'x?' END AS head FROM region)"
_AP = f"(SELECT DISTINCT i.issue_id, r.rule_id FROM {_I} i, {_RULES} r WHERE contains(i.issue_type, r.rule_id) OR (r.head IN ('e', 'f') AND starts_with(i.path, r.head)) OR (r.head = 'x?' AND i.path GLOB 'x?'))"
_DIR = "(SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'a.v' WHEN o_orderkey % 14 = 0 THEN 'b.v' END AS file_path, CASE WHEN o_orderkey % 5 = 0 THEN 'SKIP' WHEN o_orderkey % 3 = 0 THEN 'FIX_WITH_CONSTRAINTS' WHEN o_orderkey % 5 = 2 THEN 'NEEDS_REVIEW' ELSE 'FIX' END AS action, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'medium' END AS severity FROM orders)"
_DIR = f"(SELECT * FROM {_DIR} WHERE file_path IS NOT NULL AND action <> 'SKIP')"
_V = "SELECT q.vec_id AS query_id, v.vec_id, (list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))) AS score, (sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))))) AS far FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id"
_K = "(props::JSON ->> '$.k')::INT"
ORACLE = {
    "s06_records": "SELECT '{\"a\": 1}' AS value",
    "s08_report_text": "SELECT n_nationkey AS report_id, 'n' || n_nationkey AS name FROM nation",
    "s13_csv_cells": "SELECT o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority AS line FROM orders",
    "s14_metric_reports": "SELECT o_orderstatus AS metric_name, '{\"metric_name\":\"' || o_orderstatus || '\",\"n\":' || count(*) || '}' AS report FROM orders GROUP BY o_orderstatus",
    "s15_review_lines": f"SELECT run_id || '::' || line || '::' || category AS id, severity AS level FROM {_FI}",
    "s16_directive_lines": f"SELECT '{{\"row_id\":' || row_id || ',\"file_path\":\"' || file_path || '\",\"action\":\"' || action || '\"}}' AS line FROM {_DIR}",
    "s25_llm_calls": f"SELECT event_id, {_K} + floor(value)::BIGINT AS total_tokens, round(({_K} * 3 + floor(value) * 15) / 1000000, 6) AS cost FROM events WHERE event_type = 'purchase'",
    "s27_documents_by_type": "SELECT unnest(['codebase_summary', 'metric_summary', 'critical_issue', 'file_health']) AS record_type, unnest([count(*), 2 * count(*), count(*), count(*) FILTER (WHERE n_nationkey % 2 = 0)]) AS n FROM nation",
    "s28_recorded_decisions": f"SELECT id, action FROM {_D} UNION ALL SELECT n_nationkey + 1000000000, 'AGENT' FROM nation",
    "f05_findings_tab": f"SELECT run_id, count(*) AS n FROM {_FI} WHERE severity = 'critical' AND category = 'R' GROUP BY run_id",
    "f09_metadata_filter": "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'",
    "f11_metadata_projection": "SELECT doc_id, CASE WHEN lang IS NULL THEN '{}' ELSE '{\"lang\":\"' || lang || '\"}' END AS meta FROM documents",
    "f12_compact_metrics": f"SELECT category, '[' || count(*) || ' items]' AS issues, CASE WHEN count(*) % 100 >= 90 THEN 'A' WHEN count(*) % 100 >= 80 THEN 'B' WHEN count(*) % 100 >= 70 THEN 'C' WHEN count(*) % 100 >= 60 THEN 'D' ELSE 'F' END AS grade FROM {_FI} GROUP BY category",
    "f15_feedback_rows": "SELECT o_orderkey AS row_id, CASE o_orderkey % 5 WHEN 0 THEN 'Skip this' WHEN 2 THEN 'please check' ELSE 'Approve' END AS \"Feedback\", CASE WHEN o_orderkey % 3 = 0 THEN 'keep ports' ELSE 'None' END AS \"Constraints\", CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'medium' END AS \"Severity\" FROM orders",
    "f17_directives": f"SELECT * FROM {_DIR}",
    "f24_sections": "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN lower(text) LIKE '%a%' THEN 'metrics' END, CASE WHEN lower(text) LIKE '%the%' OR lower(text) LIKE '%e%' THEN 'summary' END], lambda x: x IS NOT NULL))), ' OR ') AS sections FROM conversations WHERE role = 'user'",
    "f25_report_figures": "SELECT n_nationkey AS report_id, 5 AS lint, 0 AS other FROM nation",
    "f27_file_fields": "SELECT page_id, split_part(split_part(url, '?', 1), '#', 1).string_split('/')[-1] AS file_name FROM pages",
    "j22_rules_for_issues": f"SELECT * FROM {_AP}",
    "j24_worst_by_file": f"SELECT category, file_key, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, file_key) AS r FROM (SELECT category, file_key, count(*) AS n FROM {_FI} GROUP BY ALL)) WHERE r = 1",
    "j25_merged_edits": "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 4 = 0 THEN 'edited' WHEN o_orderkey % 2 = 0 THEN 'high' END AS severity, o_orderkey % 4 = 0 AS matched FROM orders",
    "j27_layers": "SELECT r_regionkey AS file_id, '## common' || chr(10) || 'A' || chr(10) || '## codebase' || chr(10) || 'B' || CASE WHEN r_regionkey = 2 THEN chr(10) || '## m2' || chr(10) || 'C' ELSE '' END AS text FROM region",
    "j28_feedback_write_back": f"SELECT d.id, coalesce(e.action, d.action) AS action, e.action IS NOT NULL AS matched FROM {_D} d LEFT JOIN (SELECT file_path, issue_type, arg_max(action, id) AS action FROM {_D} WHERE id % 5 = 0 GROUP BY ALL) e USING (file_path, issue_type)",
    "j29_rules_text": f"SELECT issue_id, string_agg(rule_id, '; ' ORDER BY rule_id) AS rules FROM {_AP} GROUP BY issue_id",
    "j30_second_retrieval": f"SELECT query_id, vec_id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far, vec_id) AS r FROM ({_V})) WHERE r <= 3",
    "a41_average_priority": f"SELECT category, CASE WHEN p >= 3.5 THEN 'critical' WHEN p >= 2.5 THEN 'high' WHEN p >= 1.5 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT category, avg(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS p FROM {_FI} GROUP BY category)",
    "a42_failing_metrics": f"SELECT category, string_agg(severity, ',' ORDER BY severity) AS failing FROM (SELECT category, severity, count(*) AS n FROM {_FI} GROUP BY ALL HAVING n % 100 < 60) GROUP BY category",
    "a43_check_counts": f"SELECT category AS \"check\", count(*) FILTER (WHERE severity <> 'critical') AS passed, count(*) FILTER (WHERE severity = 'critical') AS failed FROM {_FI} GROUP BY category",
    "a47_severity_rollup": f"SELECT run_id, {', '.join(f'''count(*) FILTER (WHERE severity = '{x}') AS {x}''' for x in ('critical', 'high', 'medium', 'low'))} FROM {_FI} GROUP BY run_id",
    "a49_by_file": f"SELECT file_path, count(*) AS n, min(row_id) AS first FROM {_DIR} GROUP BY file_path",
    "a51_review_totals": f"SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high FROM {_FI}",
    "a52_prompt_context": "SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first FROM documents GROUP BY lang",
    "a53_flagged_bars": f"SELECT event_id, cc, round(cc / max(cc) OVER (), 6) AS width FROM (SELECT event_id, {_K} AS cc FROM events WHERE {_K} > 0 ORDER BY event_id LIMIT 15)",
    "a54_first_by_severity": f"SELECT severity, run_id, line, greatest(0, n - 10) AS more FROM (SELECT *, count(*) OVER (PARTITION BY severity) AS n, row_number() OVER (PARTITION BY severity ORDER BY run_id, line, file_key) AS r FROM {_FI}) WHERE r <= 10",
    "a55_recommendations": f"SELECT severity, CASE WHEN severity IN ('critical', 'high') THEN 'fix first' ELSE 'plan' END AS advice FROM {_FI} GROUP BY severity HAVING count(*) > 10",
    "w16_chat_summary": "SELECT conv_id, md5(substr(string_agg(text, chr(10) ORDER BY turn, text), 1, 1000)) AS digest FROM conversations GROUP BY conv_id",
    "o09_missing_docs": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 200",
    "o10_document_caps": f"SELECT category, array_to_string(list_sort(list(DISTINCT file_key))[1:10], ',') AS files FROM {_FI} GROUP BY category",
    "u05_shared_words": "SELECT item_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w IN ('the', 'a', 'of')))), ','), '') AS words FROM benchmark",
    "x16_issue_blocks": "SELECT p_partkey AS review_id, 'wide net ' || p_partkey AS title, 'High' AS severity, 12 AS line, 'assign y' || p_partkey || ' = 1;' AS code FROM part UNION ALL SELECT p_partkey, 'lost', 'Low', 7, 'not there' FROM part",
    "x17_json": f"SELECT event_id, CASE WHEN event_id % 3 < 2 THEN {_K} END AS k, event_id % 3 = 2 AS parse_error FROM events",
    "x19_fenced_code": "SELECT p_partkey AS review_id, 'assign y' || p_partkey || ' = 1;' AS code FROM part",
    "v04_compare": f"SELECT query_id, string_agg(vec_id::VARCHAR, ',' ORDER BY r) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({_V})) WHERE r <= 2 GROUP BY query_id",
    "v05_embedding_documents": "SELECT '# Critical Issue' || chr(10) || 'stop ' || n_nationkey AS page_content FROM nation",
    "v06_batches": "SELECT count(DISTINCT md5(text)) AS rows, count(DISTINCT md5(text)) - count(DISTINCT md5(text)) FILTER (WHERE doc_id % 2 = 0) AS added FROM documents",
    "v07_append": "SELECT count(DISTINCT md5(text)) AS n FROM documents",
    "v08_feedback": f"WITH f AS (SELECT DISTINCT i.issue_id, i.severity = d.severity AS same, d.id, d.action, d.decided_at FROM {_I} i JOIN {_D} d ON d.issue_type = i.issue_type OR d.file_path = i.path), g AS (SELECT *, bool_or(same) OVER (PARTITION BY issue_id) AS anyone FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY CASE action WHEN 'FIX_WITH_CONSTRAINTS' THEN 3 WHEN 'FIX' THEN 2 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 0 END DESC, decided_at DESC, id) AS r FROM g WHERE same OR NOT anyone), d AS (SELECT issue_id, string_agg(id::VARCHAR, ',' ORDER BY r) AS decisions, count(*) AS n FROM r WHERE r <= 5 GROUP BY issue_id), p AS (SELECT issue_id, count(*) AS n FROM {_AP} GROUP BY issue_id) SELECT i.issue_id, coalesce(d.decisions, '') AS decisions, coalesce(p.n, 0) AS rules, least(1.0, (coalesce(d.n, 0) + 2 * coalesce(p.n, 0)) / 10) AS score FROM {_I} i LEFT JOIN d USING (issue_id) LEFT JOIN p USING (issue_id)",
    "v09_suggestions": f"SELECT issue_type, string_agg(DISTINCT action, ', ' ORDER BY action) AS suggestions FROM {_D} GROUP BY issue_type",
    "v10_flatten": "SELECT n_nationkey AS report_id, u.t AS record_type, u.n FROM nation, (VALUES ('codebase_summary', 1), ('metric_summary', 2), ('critical_issue', 1)) u(t, n) UNION ALL SELECT n_nationkey, 'file_health', 1 FROM nation WHERE n_nationkey % 2 = 0",
    "v12_sections": "SELECT n_nationkey AS report_id, u.s AS section, md5(n_nationkey || '|' || u.s) AS id FROM nation, (VALUES ('summary'), ('metrics'), ('files')) u(s)",
    "v13_overview": f"SELECT category, count(*) AS issues, count(DISTINCT file_key) AS files FROM {_FI} GROUP BY category",
    "v14_diagram": "SELECT n_regionkey, 'graph TD' || chr(10) || string_agg('r' || n_regionkey || ' --> ' || regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g'), chr(10) ORDER BY 'r' || n_regionkey || ' --> ' || regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g')) AS text FROM nation GROUP BY n_regionkey",
    "t03_log_until_mark": "WITH m AS (SELECT user_id, min((ts, event_id)) AS stop FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT e.user_id, count(*) AS drained FROM events e LEFT JOIN m ON e.user_id = m.user_id WHERE m.stop IS NULL OR (e.ts, e.event_id) < m.stop GROUP BY e.user_id",
    "c01_analyzers": f"SELECT 'style' AS analyzer, rule, count(*) AS n FROM ({catalog.ORACLE['r02_style']}) GROUP BY rule",
}
