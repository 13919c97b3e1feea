"""Stored telemetry and feedback: runs, decisions, rules and usage reports as keyed tables, and appended findings and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.keyed import FILL, NEW, KeyedTable
from ..staging import new_folder

RUNS = """run_id string, created_at timestamp, finished_at timestamp, mode string, status string, codebase_path string, files_analyzed int, total_chunks int,
    issues_total int, issues_critical int, issues_high int, issues_medium int, issues_low int, issues_fixed int, issues_skipped int, issues_failed int,
    llm_provider string, llm_model string, total_llm_calls int, total_prompt_tokens int, total_completion_tokens int, total_llm_latency_ms int, use_ccls boolean, use_hitl boolean,
    constraints_used string, duration_seconds double, metadata string"""
DECISIONS = """id long, created_at timestamp, source string, file_path string, line_number int, code_snippet string, issue_type string, severity string, human_action string,
    human_feedback_text string, applied_constraints string, remediation_notes string, agent_that_flagged string, run_id string"""
RULES = "rule_id string, description string, standard_remediation string, llm_action string, reasoning string, example_allowed string, example_prohibited string, applies_to_patterns string, source_file string"
RUN_METADATA = "run_id string, config_snapshot string"
REPORTS = "report_date date, report_type string, total_runs long, total_files long, total_findings long, total_fixes long, total_tokens long, micro_cost long, top_issue_types string, top_files string"

#: What the end of a run says: counts that it leaves out are zero.
COUNTS = ("files_analyzed", "total_chunks", "issues_total", "issues_critical", "issues_high", "issues_medium", "issues_low", "issues_fixed", "issues_skipped", "issues_failed", "total_llm_calls", "total_prompt_tokens", "total_completion_tokens", "total_llm_latency_ms")
BULK = ("human_action", "human_feedback_text", "applied_constraints", "remediation_notes")
#: Days before a report's own that it covers.
SPANS = {"daily": 1, "weekly": 7}


def runs_table(spark: SparkSession, folder: str, **how) -> KeyedTable:
    return KeyedTable(spark, folder, RUNS, ("run_id",), **how)


def decisions_table(spark: SparkSession, folder: str, **how) -> KeyedTable:
    return KeyedTable(spark, folder, DECISIONS, ("id",), **how)


def start_runs(table: KeyedTable, runs: DataFrame, token: str) -> dict[str, int]:
    """Insert the heads of runs with status started and zero counts; a run that is there stays as it is."""
    heads = runs.withColumns({"status": F.lit("started"), **{c: F.lit(0) for c in COUNTS}})
    return table.merge(heads, token, update={})


def finish_runs(table: KeyedTable, ends: DataFrame, token: str) -> dict[str, int]:
    """Update known runs by key: nineteen columns, counts zero where the end has none, and metadata only where it has some; unknown runs are passed over."""
    have = set(ends.columns)
    ends = ends.withColumns({c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0) for c in COUNTS})
    ends = ends.withColumn("status", F.coalesce("status", F.lit("completed")) if "status" in have else F.lit("completed"))
    rules = {c: NEW for c in (*COUNTS, "finished_at", "status", "constraints_used", "duration_seconds")} | {"metadata": FILL}
    return table.merge(ends, token, update=rules, insert=False)


def save_decisions(table: KeyedTable, decisions: DataFrame, token: str) -> dict[str, int]:
    """Insert decisions, or update all thirteen other columns of known ones."""
    return table.merge(decisions, token, latest=F.col("created_at"))


def bulk_save_decisions(table: KeyedTable, decisions: DataFrame, token: str) -> dict[str, int]:
    """Insert decisions, or update only what a reviewer writes in known ones."""
    return table.merge(decisions, token, update=dict.fromkeys(BULK, NEW), latest=F.col("created_at"))


def usage_reports(runs: DataFrame, calls: DataFrame, findings: DataFrame, top: int = 10) -> DataFrame:
    """Reports of REPORTS for every day with a run: totals of the days that each covers, and its commonest issue types and files.

    Inputs: runs (day, files, findings, fixes, tokens), calls (day, micro_cost),
    findings (day, category, file_path). Rows meet by day first; only sums of days
    are repeated for the reports that cover them.
    """
    days = runs.select("day").distinct()

    def covered(sums: DataFrame) -> DataFrame:
        out = None
        for kind, span in SPANS.items():
            each = sums.withColumn("report_date", F.explode(F.expr(f"transform(sequence(0, {span}), i -> date_add(day, i))"))).withColumn("report_type", F.lit(kind))
            out = each if out is None else out.unionByName(each)
        return out.join(days.select(F.col("day").alias("report_date")), "report_date", "left_semi").drop("day")

    by = ["report_date", "report_type"]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    daily = runs.groupBy("day").agg(F.count(F.lit(1)).alias("total_runs"), total("files").alias("total_files"), total("findings").alias("total_findings"), total("fixes").alias("total_fixes"), total("tokens").alias("total_tokens"))
    sums = covered(daily).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("total_runs", "total_files", "total_findings", "total_fixes", "total_tokens")])
    cost = covered(calls.groupBy("day").agg(F.sum("micro_cost").alias("micro_cost"))).groupBy(*by).agg(F.sum("micro_cost").alias("micro_cost"))

    def commonest(column: str, name: str) -> DataFrame:
        counts = findings.where(F.col(column).isNotNull()).groupBy("day", column).agg(F.count(F.lit(1)).alias("n"))
        n = covered(counts).groupBy(*by, column).agg(F.sum("n").alias("n"))
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), column))
        pair = F.concat(F.lit('"'), F.col(column), F.lit('": '), F.col("n").cast("string"))
        listed = n.withColumn("place", place).where(F.col("place") <= top).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", pair.alias("pair")))).alias("all"))
        return listed.select(*by, F.concat(F.lit("{"), F.concat_ws(", ", F.transform("all", lambda x: x["pair"])), F.lit("}")).alias(name))

    out = sums.join(cost, by, "left").join(commonest("category", "top_issue_types"), by, "left").join(commonest("file_path", "top_files"), by, "left")
    return out.withColumn("micro_cost", F.coalesce("micro_cost", F.lit(0))).fillna("{}", ["top_issue_types", "top_files"])


def append(rows: DataFrame, folder: str, token: str) -> None:
    """Add rows to an appended table; a try under the same token replaces what that token wrote before."""
    rows.write.mode("overwrite").parquet(f"{folder}/token={token}")


def appended(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with total tokens and cost in millionths; a model without a price costs nothing."""
    rate = calls.join(F.broadcast(prices), ["provider", "model"], "left")  # a row for each model
    cost = F.col("prompt_tokens") * F.coalesce("price_in", F.lit(0)) + F.col("completion_tokens") * F.coalesce("price_out", F.lit(0))
    return rate.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"), "micro_cost": cost.cast("long")}).drop("price_in", "price_out")


def traceability(feedback: DataFrame, audit: DataFrame, fixes: DataFrame) -> DataFrame:
    """feedback's rows with what became of them: ``fixer_status`` and ``lines_changed``, by (file, issue).

    The audit's status counts, unless it has none or an empty one; then that of
    the fixes; else PENDING. Of several rows of one file and issue the last by
    ``at`` counts. Lines come from the audit alone, and are 0 without it. Nulls
    in a file or issue are the empty text.
    """
    key = [F.coalesce(c, F.lit("")).alias(c) for c in ("file", "issue")]
    last = lambda df, *c: df.select(*key, "at", *c).groupBy("file", "issue").agg(*[F.max_by(x, "at").alias(x) for x in c])
    a = last(audit.withColumn("audit_status", F.coalesce("status", F.lit(""))), "audit_status", "lines_changed")
    f = last(fixes.withColumn("fix_status", F.coalesce("status", F.lit(""))), "fix_status")
    rows = feedback.withColumns({c: F.coalesce(c, F.lit("")) for c in ("file", "issue")})
    out = rows.join(a, ["file", "issue"], "left").join(f, ["file", "issue"], "left")
    status = F.when(F.col("audit_status") != "", F.col("audit_status")).otherwise(F.coalesce("fix_status", F.lit("PENDING")))
    return out.withColumns({"fixer_status": status, "lines_changed": F.coalesce("lines_changed", F.lit(0))}).drop("audit_status", "fix_status")


def call_detail(calls: DataFrame) -> DataFrame:
    """calls with their place in their run by time, and the run's tokens and cost up to and including each, and in all."""
    by = Window.partitionBy("run_id").orderBy("created_at", "call_id")
    upto, all_ = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("run_id")
    return calls.withColumns({"place": F.row_number().over(by), "tokens_so_far": F.sum("total_tokens").over(upto), "cost_so_far": F.sum("micro_cost").over(upto), "run_tokens": F.sum("total_tokens").over(all_), "run_cost": F.sum("micro_cost").over(all_)})


def latency_counts(calls: DataFrame) -> DataFrame:
    """(run_id, latency_ms, calls): how often each latency occurs in a run."""
    return calls.groupBy("run_id", "latency_ms").agg(F.count(F.lit(1)).alias("calls"))


# The star schema as telemetry.


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _runs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    mode = F.element_at(F.array(F.lit("analysis"), F.lit("fixer"), F.lit("patch")), (k % 3 + 1).cast("int"))
    return s.read.parquet(f"{d}/orders.parquet").select(_text("run-", k).alias("run_id"), F.col("o_orderdate").alias("created_at"), mode.alias("mode"), _text("src/", k % 20).alias("codebase_path"), F.when(k % 4 == 0, _text('{"from": ', k, "}")).alias("metadata"))


def _run_lifecycle(s: SparkSession, d: str) -> DataFrame:
    """Runs begin; two thirds of them end, in two merges of which the second is tried twice; ends of unknown runs are among them."""
    t = runs_table(s, new_folder(s, "runs"), buckets=8)
    start_runs(t, _runs(s, d), "start")
    line = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).cast("int").alias("issues_total"), F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("int").alias("issues_high"), F.sum("l_quantity").alias("duration_seconds"), F.max("l_shipdate").alias("finished_at"))
    ends = line.withColumns({"run_id": _text("run-", F.col("k")), "metadata": F.when(F.col("k") % 5 == 0, F.lit('{"end": 1}')), "status": F.when(F.col("k") % 7 == 0, F.lit("failed")), "total_chunks": F.when(F.col("k") % 2 == 0, F.lit(3))})
    ends = ends.unionByName(ends.withColumn("run_id", _text("none-", F.col("k"))))
    finish_runs(t, ends.where("k % 3 = 0"), "end-1")
    for _ in range(2):
        finish_runs(t, ends.where("k % 3 = 1"), "end-2")
    return t.read().select("run_id", "mode", "status", "codebase_path", "finished_at", "total_chunks", "issues_total", "issues_high", "issues_low", "total_llm_calls", "duration_seconds", "metadata")


def _decisions(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    k = F.col("doc_id")
    return docs.select(
        k.alias("id"), F.timestamp_seconds(k * 60).alias("created_at"), F.col("source"), _text(F.col("lang"), "/", k % 50, ".sv").alias("file_path"), (k % 900).cast("int").alias("line_number"), F.md5("text").alias("code_snippet"), F.col("source").alias("issue_type"),
        F.when(k % 3 == 0, "high").otherwise("low").alias("severity"), F.lit("FIX").alias("human_action"), F.lit(None).cast("string").alias("human_feedback_text"), F.lit("[]").alias("applied_constraints"), F.lit("first").alias("remediation_notes"), F.lit("lint").alias("agent_that_flagged"), _text("run-", k % 40).alias("run_id"),
    )


def _decision_merges(s: SparkSession, d: str) -> DataFrame:
    """Decisions are saved, some again one by one (all columns), some in bulk (four columns), each once more; a key comes twice in one batch."""
    t, rows = decisions_table(s, new_folder(s, "decisions"), buckets=8), _decisions(s, d)
    save_decisions(t, rows.where("id % 10 < 8"), "first")
    changed = rows.withColumns({"severity": F.lit("critical"), "human_action": F.lit("SKIP"), "remediation_notes": F.lit("second"), "human_feedback_text": F.lit("no")})
    later = changed.where("id % 10 >= 6 and id % 10 < 9")
    older = later.withColumns({"created_at": F.lit(None).cast("timestamp"), "human_action": F.lit("OLD")})
    for _ in range(2):
        save_decisions(t, later.unionByName(older), "second")
        bulk_save_decisions(t, changed.where("id % 10 in (0, 9)"), "bulk")
    return t.read().drop("created_at")


def _rule_merges(s: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id")
    rules = s.read.parquet(f"{d}/benchmark.parquet").select(_text("R", k % 25).alias("rule_id"), F.col("text").alias("description"), _text("act", k).alias("llm_action"), F.lit('["*.sv"]').alias("applies_to_patterns"), k)
    t = KeyedTable(s, new_folder(s, "rules"), RULES, ("rule_id",), buckets=4)
    t.merge(rules.where("item_id % 2 = 0"), "even", latest=k)
    t.merge(rules.where("item_id % 3 = 0").withColumn("reasoning", F.lit("again")), "third", latest=k)
    m = KeyedTable(s, new_folder(s, "run-metadata"), RUN_METADATA, ("run_id",), buckets=4)
    for step in (1, 2):
        m.merge(rules.where(f"item_id % {step} = 0").select(F.col("rule_id").alias("run_id"), _text('{"step": ', F.lit(step), "}").alias("config_snapshot")), f"step-{step}")
    return t.read().select("rule_id", "llm_action", "reasoning").join(m.read().withColumnRenamed("run_id", "rule_id"), "rule_id", "left")


def _report_merges(s: SparkSession, d: str) -> DataFrame:
    """Reports on half of the runs, then on all: the second replaces the first where they have the same day and kind."""
    o, c = s.read.parquet(f"{d}/orders.parquet"), F.col
    runs = o.select(F.to_date("o_orderdate").alias("day"), (c("o_custkey") % 9).alias("files"), (c("o_custkey") % 7).alias("findings"), (c("o_custkey") % 5).alias("fixes"), (c("o_orderkey") % 1000).alias("tokens"), c("o_orderkey").alias("k"))
    calls = o.select(F.to_date("o_orderdate").alias("day"), (c("o_orderkey") % 1000 * 3).alias("micro_cost"))
    found = s.read.parquet(f"{d}/lineitem.parquet").select(F.to_date("l_shipdate").alias("day"), c("l_returnflag").alias("category"), _text("f", c("l_partkey") % 100).alias("file_path"))
    t = KeyedTable(s, new_folder(s, "reports"), REPORTS, ("report_date", "report_type"), buckets=4)
    t.merge(usage_reports(runs.where("k % 2 = 0"), calls, found), "half")
    for _ in range(2):
        t.merge(usage_reports(runs, calls, found), "all")
    return t.read()


def _appends(s: SparkSession, d: str) -> DataFrame:
    """Calls are appended by day with their cost; one day's append is tried again."""
    e = s.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    calls = e.select(F.col("event_id").alias("call_id"), F.to_date("ts").alias("day"), _text("p", F.col("user_id") % 3).alias("provider"), _text("m", F.col("user_id") % 2).alias("model"), (F.col("event_id") % 500).alias("prompt_tokens"), (F.col("event_id") % 90).alias("completion_tokens"))
    prices = s.createDataFrame([("p0", "m0", 3, 15), ("p0", "m1", 1, 5), ("p1", "m0", 2, 8)], "provider string, model string, price_in long, price_out long")
    folder, rows = new_folder(s, "calls"), priced(calls, prices)
    for token, part in (("a", "call_id % 2 = 0"), ("b", "call_id % 2 = 1"), ("b", "call_id % 2 = 1")):
        append(rows.where(part), folder, token)
    return appended(s, folder).select("call_id", "provider", "model", "total_tokens", "micro_cost")


def _trace(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = s.read.parquet(f"{d}/orders.parquet").select(k.alias("at"), F.when(k % 50 != 7, _text("f", F.col("o_custkey") % 150)).alias("file"), F.col("o_orderpriority").alias("issue"))
    k = F.col("at")
    audit = o.where("at % 3 = 0").withColumns({"status": F.element_at(F.array(F.lit(""), F.lit("FIXED"), F.lit("FAILED"), F.lit(None)), (k % 4 + 1).cast("int")), "lines_changed": (k % 30).cast("int")})
    fixes = o.where("at % 5 = 0").withColumn("status", F.when(k % 2 == 0, "ok").otherwise("skipped"))
    return traceability(o.where("at % 7 = 0").withColumnRenamed("at", "row_id"), audit, fixes)


def _calls(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").where("event_type in ('purchase', 'click')")
    i = F.col("event_id")
    return e.select(i.alias("call_id"), _text("run-", F.col("user_id") % 40).alias("run_id"), F.col("ts").alias("created_at"), (i % 700).alias("total_tokens"), (i % 90 * 3).alias("micro_cost"), (i % 25 * 10).alias("latency_ms"))


QUERIES = {"j20_feedback_trace": _trace, "a38_call_detail": lambda s, d: call_detail(_calls(s, d)).drop("created_at"), "a38_latency_counts": lambda s, d: latency_counts(_calls(s, d)), "s26_run_lifecycle": _run_lifecycle, "a21_decision_merges": _decision_merges, "a22_rule_merges": _rule_merges, "a20_report_merges": _report_merges, "s25_appended_calls": _appends}
_COVER = "SELECT d.day AS report_date, s.kind AS report_type, {} FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) d, (VALUES ('daily', 1), ('weekly', 7)) s(kind, span), {} x WHERE x.day BETWEEN d.day - s.span::INT AND d.day GROUP BY ALL"
_CALLS = "(SELECT event_id AS call_id, 'run-' || (user_id % 40) AS run_id, ts AS created_at, event_id % 700 AS total_tokens, event_id % 90 * 3 AS micro_cost, event_id % 25 * 10 AS latency_ms FROM events WHERE event_type IN ('purchase', 'click'))"
ORACLE = {
    "j20_feedback_trace": """
        WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 <> 7 THEN 'f' || (o_custkey % 150) ELSE '' END AS file, o_orderpriority AS issue FROM orders),
        a AS (SELECT file, issue, max(k) AS k FROM o WHERE k % 3 = 0 GROUP BY ALL), f AS (SELECT file, issue, max(k) AS k FROM o WHERE k % 5 = 0 GROUP BY ALL)
        SELECT o.k AS row_id, o.file, o.issue, coalesce(a.k % 30, 0)::INT AS lines_changed,
          CASE WHEN a.k % 4 = 1 THEN 'FIXED' WHEN a.k % 4 = 2 THEN 'FAILED' WHEN f.k % 2 = 0 THEN 'ok' WHEN f.k % 2 = 1 THEN 'skipped' ELSE 'PENDING' END AS fixer_status
        FROM o LEFT JOIN a USING (file, issue) LEFT JOIN f USING (file, issue) WHERE o.k % 7 = 0""",
    "a38_call_detail": f"""SELECT call_id, run_id, total_tokens, micro_cost, latency_ms, row_number() OVER w AS place, (sum(total_tokens) OVER w)::BIGINT AS tokens_so_far, (sum(micro_cost) OVER w)::BIGINT AS cost_so_far,
          (sum(total_tokens) OVER (PARTITION BY run_id))::BIGINT AS run_tokens, (sum(micro_cost) OVER (PARTITION BY run_id))::BIGINT AS run_cost FROM {_CALLS} WINDOW w AS (PARTITION BY run_id ORDER BY created_at, call_id ROWS UNBOUNDED PRECEDING)""",
    "a38_latency_counts": f"SELECT run_id, latency_ms, count(*) AS calls FROM {_CALLS} GROUP BY ALL",
    "s26_run_lifecycle": """
        WITH l AS (SELECT l_orderkey AS k, count(*)::INT AS issues_total, count(*) FILTER (l_returnflag = 'R')::INT AS issues_high, sum(l_quantity) AS duration_seconds, max(l_shipdate) AS finished_at FROM lineitem WHERE l_orderkey % 3 < 2 GROUP BY l_orderkey)
        SELECT 'run-' || o.o_orderkey AS run_id, ['analysis', 'fixer', 'patch'][(o.o_orderkey % 3 + 1)::INT] AS mode, CASE WHEN l.k IS NULL THEN 'started' WHEN l.k % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, 'src/' || (o.o_orderkey % 20) AS codebase_path, l.finished_at,
          CASE WHEN l.k % 2 = 0 THEN 3 ELSE 0 END AS total_chunks, coalesce(l.issues_total, 0) AS issues_total, coalesce(l.issues_high, 0) AS issues_high, 0 AS issues_low, 0 AS total_llm_calls, l.duration_seconds,
          CASE WHEN l.k % 5 = 0 THEN '{"end": 1}' WHEN o.o_orderkey % 4 = 0 THEN '{"from": ' || o.o_orderkey || '}' END AS metadata FROM orders o LEFT JOIN l ON l.k = o.o_orderkey""",
    "a21_decision_merges": """
        WITH x AS (SELECT *, doc_id % 10 AS m FROM documents)
        SELECT doc_id AS id, source, lang || '/' || (doc_id % 50) || '.sv' AS file_path, (doc_id % 900)::INT AS line_number, md5(text) AS code_snippet, source AS issue_type, CASE WHEN m IN (6, 7, 8, 9) THEN 'critical' WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS severity,
          CASE WHEN m IN (0, 6, 7, 8, 9) THEN 'SKIP' ELSE 'FIX' END AS human_action, CASE WHEN m IN (0, 6, 7, 8, 9) THEN 'no' END AS human_feedback_text, '[]' AS applied_constraints, CASE WHEN m IN (0, 6, 7, 8, 9) THEN 'second' ELSE 'first' END AS remediation_notes,
          'lint' AS agent_that_flagged, 'run-' || (doc_id % 40) AS run_id FROM x""",
    "a22_rule_merges": """
        WITH e AS (SELECT item_id % 25 AS r, max(item_id) FILTER (item_id % 2 = 0) AS even, max(item_id) FILTER (item_id % 3 = 0) AS third, count(*) FILTER (item_id % 2 = 0) AS n2 FROM benchmark GROUP BY 1)
        SELECT 'R' || r AS rule_id, 'act' || coalesce(third, even) AS llm_action, CASE WHEN third IS NOT NULL THEN 'again' END AS reasoning, CASE WHEN n2 > 0 THEN '{"step": 2}' ELSE '{"step": 1}' END AS config_snapshot FROM e WHERE even IS NOT NULL OR third IS NOT NULL""",
    "a20_report_merges": f"""
        WITH r AS (SELECT CAST(o_orderdate AS DATE) AS day, * FROM orders), f AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS category, 'f' || (l_partkey % 100) AS file_path FROM lineitem),
        s AS ({_COVER.format("count(*) AS total_runs, sum(o_custkey % 9)::BIGINT AS total_files, sum(o_custkey % 7)::BIGINT AS total_findings, sum(o_custkey % 5)::BIGINT AS total_fixes, sum(o_orderkey % 1000)::BIGINT AS total_tokens, sum(o_orderkey % 1000 * 3)::BIGINT AS micro_cost", "r")}),
        c AS ({_COVER.format("category AS v, sum(n) AS n", "(SELECT day, category, count(*) AS n FROM f GROUP BY ALL)")}), p AS ({_COVER.format("file_path AS v, sum(n) AS n", "(SELECT day, file_path, count(*) AS n FROM f GROUP BY ALL)")}),
        ct AS (SELECT report_date, report_type, '{{' || string_agg('"' || v || '": ' || n, ', ' ORDER BY k) || '}}' AS t FROM (SELECT *, row_number() OVER (PARTITION BY report_date, report_type ORDER BY n DESC, v) AS k FROM c) WHERE k <= 10 GROUP BY ALL),
        pt AS (SELECT report_date, report_type, '{{' || string_agg('"' || v || '": ' || n, ', ' ORDER BY k) || '}}' AS t FROM (SELECT *, row_number() OVER (PARTITION BY report_date, report_type ORDER BY n DESC, v) AS k FROM p) WHERE k <= 10 GROUP BY ALL)
        SELECT s.*, coalesce(ct.t, '{{}}') AS top_issue_types, coalesce(pt.t, '{{}}') AS top_files FROM s LEFT JOIN ct USING (report_date, report_type) LEFT JOIN pt USING (report_date, report_type)""",
    "s25_appended_calls": """
        SELECT event_id AS call_id, 'p' || (user_id % 3) AS provider, 'm' || (user_id % 2) AS model, event_id % 500 + event_id % 90 AS total_tokens,
          CASE WHEN user_id % 3 = 0 AND user_id % 2 = 0 THEN event_id % 500 * 3 + event_id % 90 * 15 WHEN user_id % 3 = 0 THEN event_id % 500 + event_id % 90 * 5 WHEN user_id % 3 = 1 AND user_id % 2 = 0 THEN event_id % 500 * 2 + event_id % 90 * 8 ELSE 0 END AS micro_cost FROM events WHERE event_type = 'purchase'""",
}
