"""Patch review: hunks as rows, ranges around them, findings held against them, and checks of fixes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import diffs, scalars
from . import corpus, facts, rules

HUNK = "file_id long, hunk int, old_start int, old_count int, new_start int, new_count int, removed array<string>, added array<string>"


def hunks(patches: DataFrame) -> DataFrame:
    """Rows of (file_id, patch), by an Arrow function, as dialects need a parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *h[:6]) for i, t in zip(batch["file_id"], batch["patch"], strict=True) for n, h in enumerate(diffs.hunks(t), 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HUNK.split(", ")])

    return patches.select("file_id", "patch").mapInPandas(run, HUNK)


def split_files(patches: DataFrame) -> DataFrame:
    """(patch_id, path, dialect, patch): the files of patches of several."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch["patch_id"], batch["patch"], strict=True) for x in diffs.files(t)]
            yield pd.DataFrame(rows, columns=["patch_id", "path", "dialect", "patch"])

    return patches.select("patch_id", "patch").mapInPandas(run, "patch_id long, path string, dialect string, patch string")


# Headers of one file's part in patches of several.
_TRIPLE, _QUAD = r"^===\s+(.+?)\s+[\x{2014}\-]+\s+(.+)$", r"^====\s+(.+?)\s+[\x{2014}\-]+\s+(.+?)\s*={0,4}$"
_GIT, _PLAIN = r"^diff\s+--git\s+a/(.+?)\s+b/(.+)$", r"^diff\s+(?:-\S+\s+)*([^\s-]\S*)\s+(\S+)$"
_MINUS, _PLUS = r"^---\s+(?:a/)?(.+?)(?:\t.*)?$", r"^\+\+\+\s+(?:b/)?(.+?)(?:\t.*)?$"
_META = r"^(---|\+\+\+|index |old mode|new mode|new file|deleted file)"


def entries(patches: DataFrame) -> DataFrame:
    """(patch_id, entry, dialect, server, local, body): the files of patches of several, in order.

    The kind of the first header decides how a text is cut: at lines of three or
    of four equal signs, or at ``diff`` lines; lines of minus and plus signs that
    name files begin a part only before the first ``diff`` line. After that they,
    with other lines about the file, belong to the header, and the plus line's
    name is the local one. Parts without a body, and texts without a header, give
    nothing.
    """
    lines = patches.select("patch_id", F.posexplode(F.split(F.regexp_replace("patch", "\r\n", "\n"), "\n", -1)).alias("at", "line"))
    by = Window.partitionBy("patch_id").orderBy("at")
    up_to = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line, after = F.col("line"), F.col("after")
    kind = F.when(line.rlike(_QUAD), "quad").when(line.rlike(_TRIPLE), "triple").when(line.rlike(_GIT), "git").when(line.rlike(_PLAIN), "plain").when(line.rlike(_MINUS) & F.coalesce(after.rlike(_PLUS), F.lit(False)), "unified")
    x = lines.withColumn("after", F.lead("line").over(by)).withColumn("kind", kind)
    family = F.when(F.col("kind").isin("quad", "triple"), F.col("kind")).when(F.col("kind").isNotNull(), "diff")
    x = x.withColumns({"family": F.first(family, ignorenulls=True).over(Window.partitionBy("patch_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "own": family})
    diffs_so_far = F.count(F.when(F.col("kind").isin("git", "plain"), 1)).over(up_to)
    x = x.withColumn("head", (F.col("own") == F.col("family")) & ((F.col("kind") != "unified") | (diffs_so_far == 0)))
    x = x.withColumn("head", F.coalesce("head", F.lit(False))).withColumn("entry", F.count(F.when(F.col("head"), 1)).over(up_to)).where("entry > 0")
    part = Window.partitionBy("patch_id", "entry").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("dialect", F.first("kind").over(part))
    # Lines about the file follow its header without a break; a pair of names is its header's own second line.
    about = ~F.col("head") & (F.col("dialect").isin("git", "plain") & line.rlike(_META) | (F.col("dialect") == "unified") & line.rlike(_PLUS) & F.lag("head").over(by))
    x = x.withColumn("about", about).withColumn("lead_in", F.sum(F.when(F.col("head") | F.col("about"), 0).otherwise(1)).over(part) == 0)
    pick = lambda i: F.when(F.col("dialect") == "quad", F.regexp_extract("line", _QUAD, i)).when(F.col("dialect") == "triple", F.regexp_extract("line", _TRIPLE, i)).when(F.col("dialect") == "git", F.regexp_extract("line", _GIT, i)).when(F.col("dialect") == "plain", F.regexp_extract("line", _PLAIN, i)).otherwise(F.regexp_extract("line", _MINUS, 1))
    named = F.max(F.when(F.col("lead_in") & line.rlike(_PLUS), F.struct("at", F.regexp_extract("line", _PLUS, 1).alias("name"))))
    out = x.groupBy("patch_id", "entry").agg(
        F.first("dialect").alias("dialect"), F.max(F.when(F.col("head"), F.trim(pick(1)))).alias("server"), F.coalesce(named["name"], F.max(F.when(F.col("head"), F.trim(pick(2))))).alias("local"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("lead_in"), F.struct("at", "line")))), lambda r: r["line"]), "\n").alias("body"),
    )
    return out.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).where("body <> ''")


def patched(files: DataFrame, patches: DataFrame) -> DataFrame:
    """(file_id, source, fixed): the sources with their patches applied; null where a patch does not fit."""

    @F.pandas_udf("string")
    def run(sources: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([diffs.apply(s, diffs.hunks(t)) for s, t in zip(sources, texts, strict=True)])

    return files.join(patches.select("file_id", "patch"), "file_id").select("file_id", "source", run("source", "patch").alias("fixed"))


def near_hunks(findings: DataFrame, h: DataFrame, pad: int = 0) -> DataFrame:
    """Findings within pad lines of a hunk's new range of their file; those of files without any hunk stay if there is no padding.

    Ranges meet findings by file and block of 64 lines, so that the join is by
    equality whatever the number of hunks.
    """
    a, b = F.col("new_start") - pad, F.col("new_start") + F.greatest(F.col("new_count"), F.lit(1)) - 1 + pad
    spans = h.select("file_id", a.alias("a"), b.alias("b")).withColumn("block", F.explode(F.sequence(F.floor(F.greatest("a", F.lit(0)) / 64), F.floor(F.greatest("b", F.lit(0)) / 64))))
    f = findings.withColumn("block", F.floor(F.col("line") / 64))
    spans = spans.withColumnsRenamed({"file_id": "h_file", "block": "h_block"})
    hit = f.join(spans, (F.col("file_id") == F.col("h_file")) & (F.col("block") == F.col("h_block")) & (F.col("line") >= F.col("a")) & (F.col("line") <= F.col("b")), "left_semi").drop("block")
    return hit if pad else hit.unionByName(findings.join(h.select("file_id").distinct(), "file_id", "left_anti"))


def new_findings(after: DataFrame, before: DataFrame) -> DataFrame:
    """Findings of the new version whose fingerprint the old one does not have."""
    mark = scalars.fingerprint(F.col("file_id").cast("string"), F.col("line"), F.col("category"), F.col("description"))
    return after.withColumn("mark", mark).join(before.select(mark.alias("mark")).distinct(), "mark", "left_anti").drop("mark")


def windows(h: DataFrame, lengths: DataFrame, pad: int = 20) -> DataFrame:
    """(file_id, hunk, first, last): ranges padded and clipped to their files."""
    return h.join(lengths, "file_id").select("file_id", "hunk", F.greatest(F.lit(1), F.col("new_start") - pad).alias("first"), F.least("n_lines", F.col("new_start") + F.col("new_count") + pad).alias("last"))


def offsets(h: DataFrame) -> DataFrame:
    """(file_id, hunk, shift): lines that the hunks before add to the text."""
    before = Window.partitionBy("file_id").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1)
    delta = F.size("added") - F.size("removed")
    return h.select("file_id", "hunk", F.coalesce(F.sum(delta).over(before), F.lit(0)).alias("shift"))


def summary(h: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.size(c))
    return h.groupBy("file_id").agg(F.count(F.lit(1)).alias("hunks"), n("added").alias("added"), n("removed").alias("removed"), (n("added") - n("removed")).alias("net"))


def resolved(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(entry, path, found): the file that a patch's path means: itself, else the one that shares its longest tail of up to five parts, least by name."""
    parts = F.split("path", "/")
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.least(F.lit(5), F.size(c))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(c, F.size(c) - n + 1, n), "/").alias("tail")))
    wanted = entries.select("entry", "path", F.explode(tails(parts)).alias("t")).select("entry", "path", "t.n", "t.tail")
    there = files.select(F.col("path").alias("found"), F.explode(tails(parts)).alias("t")).select("found", F.col("t.tail").alias("tail"))
    best = wanted.join(there, "tail").groupBy("entry", "path").agg(F.min(F.struct((-F.col("n")).alias("less"), "found")).alias("b"))
    return entries.select("entry", "path").join(best.select("entry", "path", F.col("b.found").alias("found")), ["entry", "path"], "left")


def validated(pairs: DataFrame) -> DataFrame:
    """(file_id, fails, warnings) of (file_id, source, fixed): a fix must keep 80 % of the size and the brackets' balance; softer marks are warnings."""

    @F.pandas_udf("boolean")
    def balanced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and diffs.balanced(t))

    fails = F.array_compact(F.array(F.when(F.col("fixed").isNull(), F.lit("does not apply")), F.when(F.length("fixed") < 0.8 * F.length("source"), F.lit("size")), F.when(balanced("source") & ~balanced("fixed"), F.lit("balance"))))
    macro = lambda c: F.regexp_extract_all(c, F.lit(r"(?m)^\s*`define\s+(\w+)"), F.lit(1))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    soft = F.array_compact(F.array(F.when(count("fixed", r"\bmodule\b") != count("source", r"\bmodule\b"), F.lit("modules")), F.when(F.size(F.array_except(macro("fixed"), macro("source"))) > 0, F.lit("new macros")), F.when(count("fixed", r"\balways") < count("source", r"\balways"), F.lit("blocks lost"))))
    return pairs.select("file_id", F.array_join(fails, ",").alias("fails"), F.array_join(soft, ",").alias("warnings"))


def integrity(files: DataFrame) -> DataFrame:
    """(file_id, empty, nul, balanced): checks of stored sources."""

    @F.pandas_udf("boolean")
    def balanced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: diffs.balanced(t or ""))

    text = F.coalesce("source", F.lit(""))
    return files.select("file_id", (F.trim(text) == "").alias("empty"), F.contains(text, F.lit("\0")).alias("nul"), balanced(text).alias("balanced"))


def chunked(files: DataFrame, most: int = 12_000) -> DataFrame:
    """(file_id, chunk, first, text): sources cut at module ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, line, part) for i, t in zip(batch["file_id"], batch["source"], strict=True) for n, (line, part) in enumerate(diffs.chunks(t or "", most), 1)]
            yield pd.DataFrame(rows, columns=["file_id", "chunk", "first", "text"])

    return files.select("file_id", "source").mapInPandas(run, "file_id long, chunk int, first int, text string")


def tails(chunks: DataFrame, n: int = 5) -> DataFrame:
    """(file_id, chunk, before): the last lines of the chunk before, which go along with each chunk."""
    lines = F.split("text", "\n", -1)
    last = F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), n), "\n")
    return chunks.select("file_id", "chunk", F.lag(last).over(Window.partitionBy("file_id").orderBy("chunk")).alias("before"))


def tasks_of_chunks(tasks: DataFrame, chunks: DataFrame, slack: int = 5) -> DataFrame:
    """(file_id, line, chunk): tasks within slack lines of a chunk; a task may be in two."""
    last = F.col("first") + F.size(F.split("text", "\n", -1)) - 1
    c = chunks.select(F.col("file_id").alias("c_file"), "chunk", "first", last.alias("last"))
    return tasks.join(c, (F.col("file_id") == F.col("c_file")) & (F.col("line") >= F.col("first") - slack) & (F.col("line") <= F.col("last") + slack)).select("file_id", "line", "chunk")


def context_definitions(chunks: DataFrame, f: DataFrame) -> DataFrame:
    """(file_id, chunk, definition): macros and enums that a chunk names, enums also by a member."""
    words = chunks.select("file_id", "chunk", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("word"))
    macros = f.where("kind = 'macro'").select(F.col("name").alias("word"), F.col("name").alias("definition"))
    enums = f.where("kind = 'enum'").select(F.explode(F.concat(F.array("name"), F.split("value", ","))).alias("word"), F.col("name").alias("definition"))
    return words.join(macros.unionByName(enums).distinct(), "word").select("file_id", "chunk", "definition").distinct()


def numbered(text: Column, marked: Column) -> Column:
    """Lines with numbers of five places and a bar; those whose numbers are in ``marked`` get a sign."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.concat(F.when(F.array_contains(marked, i + 1), ">>> ").otherwise(""), F.format_string("%5d | ", i + 1), x)), "\n")


# The queries' inputs: a patch for each module of the made design, and findings in it.


def _patches(s: SparkSession, d: str) -> DataFrame:
    k = F.col("file_id")
    row26 = F.when(k % 6 == 0, "  assign w1 = 4'b0;  ").otherwise("")
    name = F.concat(F.lit("rtl/m"), k.cast("string"), F.when(k % 2 == 0, ".sv").otherwise(".v"))
    lines = [F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name), F.lit("@@ -9,2 +9,1 @@"), F.lit("   wire [3:0] w1;"), F.lit("-  reg r1;"), F.lit("@@ -24,3 +23,4 @@"), F.lit("   end"), F.lit("-  assign w1 = a[3:0];"), F.lit("+  assign w1 = b;"), F.when(k % 9 == 1, "+`define EXTRA 1").otherwise("+  assign w2 = c;"), F.concat(F.lit(" "), row26)]
    return corpus.files(s, d).where("file_id % 8 < 4").select("file_id", F.concat_ws("\n", *lines).alias("patch"))


def _finds(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet").where("p_partkey % 8 < 4")
    k = F.col("p_partkey")
    return p.select(k.alias("file_id"), F.explode(F.array(F.lit(5), F.lit(9), F.lit(20), F.lit(24), F.lit(30))).alias("line"), F.lit("Style").alias("category"), F.concat(F.lit("issue "), (k % 3).cast("string")).alias("description"))


def _h(s: SparkSession, d: str) -> DataFrame:
    return hunks(_patches(s, d))


def _many(s: SparkSession, d: str) -> DataFrame:
    """Patches of two files each, in five dialects."""
    k = F.col("file_id")
    head = lambda x: F.when(k % 5 == 0, F.concat(F.lit("diff --git a/"), x, F.lit(" b/"), x)).when(k % 5 == 1, F.concat(F.lit("Index: "), x)).when(k % 5 == 2, F.concat(F.lit("==== "), x, F.lit("#3 ===="))).when(k % 5 == 3, F.concat(F.lit("*** "), x, F.lit("\n--- "), x)).otherwise(F.concat(F.lit("--- a/"), x, F.lit("\n+++ b/"), x))
    return corpus.files(s, d).where("file_id % 8 = 1").select(k.alias("patch_id"), F.concat_ws("\n", head(F.lit("x/one.v")), F.lit("@@ -1 +1 @@"), F.lit("-a"), F.lit("+b"), head(F.lit("y/two.v")), F.lit("@@ -2 +2 @@"), F.lit("-c"), F.lit("+d")).alias("patch"))


def _dialects(s: SparkSession, d: str) -> DataFrame:
    """Patches of two files each by the number of a part, in the five dialects, some with a path with a blank, without a body or without a header."""
    k = F.col("p_partkey")
    n = k.cast("string")
    name = F.when(k % 7 == 0, F.concat(F.lit("rtl/a b"), n, F.lit(".v"))).otherwise(F.concat(F.lit("rtl/m"), n, F.lit(".v")))
    one, two = name, F.concat(F.lit("y/"), n, F.lit(".sv"))
    t = lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in x])
    forms = [
        lambda p: t("=== //depot/", p, " \u2014 ", p), lambda p: t("==== //depot/", p, "#3 - ", p, " ===="), lambda p: t("diff --git a/old/", p, " b/", p, "\nindex 12..34\n--- a/old/", p, "\n+++ b/new/", p, "\t2024"),
        lambda p: t("diff -u -r ", F.replace(p, F.lit(" "), F.lit("_")), ".orig ", F.replace(p, F.lit(" "), F.lit("_"))), lambda p: t("--- a/", p, "\t2024\n+++ b/", p),
    ]
    head = lambda p: F.element_at(F.array(*[f(p) for f in forms]), (k % 5 + 1).cast("int"))
    body = lambda i: t(f"@@ -{i} +{i} @@\n-a", n, "\n+b", n)
    text = F.when(k % 11 == 0, body(1)).otherwise(t("note\n", head(one), F.when(k % 13 == 0, "\n  ").otherwise(t("\n", body(1))), "\r\n", head(two), "\n", body(2), "\n"))
    return s.read.parquet(f"{d}/part.parquet").select(k.alias("patch_id"), text.alias("patch"))


QUERIES = {
    "s22_patch_entries": lambda s, d: entries(_dialects(s, d)),
    "x18_hunks": lambda s, d: _h(s, d).select("file_id", "hunk", "old_start", "old_count", "new_start", "new_count", F.size("removed").alias("removed"), F.size("added").alias("added")),
    "s22_patch_files": lambda s, d: split_files(_many(s, d)).select("patch_id", "path", "dialect"),
    "w09_patch_offsets": lambda s, d: offsets(_h(s, d)),
    "w09_patched_texts": lambda s, d: patched(corpus.files(s, d), _patches(s, d)).select("file_id", F.size(F.split("fixed", "\n", -1)).alias("n_lines"), F.contains("fixed", F.lit("assign w1 = b;")).alias("has")),
    "w11_line_buckets": lambda s, d: _finds(s, d).select("file_id", "line", scalars.fingerprint(F.col("file_id").cast("string"), F.col("line"), F.col("category"), F.col("description")).alias("mark")),
    "w17_windows": lambda s, d: windows(_h(s, d), _lengths(s, d)),
    "j15_new_findings": lambda s, d: near_hunks(_finds(s, d), _h(s, d), 3).select("file_id", "line"),
    "j16_fingerprints": lambda s, d: new_findings(_finds(s, d), _finds(s, d).where("file_id % 2 = 0 or line > 20")).select("file_id", "line"),
    "j17_in_ranges": lambda s, d: near_hunks(_finds(s, d), _h(s, d).where("file_id % 2 = 0")).select("file_id", "line"),
    "j18_task_chunks": lambda s, d: tasks_of_chunks(_finds(s, d), chunked(corpus.files(s, d), 400)).groupBy("file_id", "line").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 0").select("file_id", "line"),
    "j19_context": lambda s, d: context_definitions(chunked(corpus.files(s, d)), facts.of(s, d)).where("definition = 'state_t'").select("file_id", "definition"),
    "j23_paths": lambda s, d: resolved(corpus.files(s, d).where("file_id % 8 = 2").select(F.col("file_id").alias("entry"), F.concat(F.lit("work/copy/"), F.col("path")).alias("path")), corpus.files(s, d)),
    "w08_chunk_tails": lambda s, d: tails(chunked(corpus.files(s, d).where("file_id % 8 < 4"), 400), 2).where("before is null").select("file_id", "chunk"),
    "x20_numbered": lambda s, d: corpus.files(s, d).where("file_id % 8 = 6").select("file_id", F.split(numbered(F.col("source"), F.array(F.lit(2))), "\n")[1].alias("second")),
    "x21_chunks": lambda s, d: chunked(corpus.files(s, d), 12_000).groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("letters")).join(corpus.files(s, d), "file_id").select("file_id", "chunks", (F.col("letters") == F.length("source")).alias("whole")),
    "r16_fix_checks": lambda s, d: validated(patched(corpus.files(s, d), _patches(s, d))),
    "r17_integrity": lambda s, d: integrity(corpus.files(s, d)),
    "u01_all_findings": lambda s, d: _finds(s, d).select("category").unionByName(rules.by_line(corpus.files(s, d), rules.STYLE).select(F.col("rule").alias("category"))).groupBy("category").agg(F.count(F.lit(1)).alias("n")),
    "u03_identifiers": lambda s, d: corpus.files(s, d).where("file_id % 8 = 6").select("file_id", F.array_join(F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all("source", F.lit(r"[A-Za-z_]\w*"), F.lit(0))), F.array(*[F.lit(w) for w in ("interface", "parameter", "input", "logic", "modport", "output", "endinterface")]))), ",").alias("names")),
    "u04_new_macros": lambda s, d: validated(patched(corpus.files(s, d), _patches(s, d))).where(F.contains("warnings", F.lit("new macros"))).select("file_id"),
    "u06_exported": lambda s, d: facts.packages(facts.of(s, d)).groupBy("package").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("exported")),
    "a48_patch_summary": lambda s, d: summary(_h(s, d)),
    "a50_patch_outcomes": lambda s, d: validated(patched(corpus.files(s, d), _patches(s, d))).groupBy(F.when(F.col("fails") == "", "patched").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n")),
}


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return facts.lines(corpus.files(s, d)).groupBy("file_id").agg(F.max("line_no").alias("n_lines"))


_R = "part WHERE p_partkey % 8 < 4"
_F = "(SELECT p_partkey AS file_id, u.line FROM part, (VALUES (5), (9), (20), (24), (30)) u(line) WHERE p_partkey % 8 < 4)"
ORACLE = {
    "s22_patch_entries": """
        WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS f, CASE WHEN p_partkey % 7 = 0 THEN 'rtl/a b' ELSE 'rtl/m' END || p_partkey || '.v' AS one, 'y/' || p_partkey || '.sv' AS two FROM part WHERE p_partkey % 11 <> 0),
        e AS (SELECT k, f, 1 AS entry, one AS path FROM p WHERE k % 13 <> 0 UNION ALL SELECT k, f, 2, two FROM p)
        SELECT k AS patch_id, entry::BIGINT AS entry, ['triple', 'quad', 'git', 'plain', 'unified'][(f + 1)::INT] AS dialect,
          CASE f WHEN 0 THEN '//depot/' || path WHEN 1 THEN '//depot/' || path || '#3' WHEN 2 THEN 'old/' || path WHEN 3 THEN replace(path, ' ', '_') || '.orig' ELSE path END AS server,
          CASE f WHEN 2 THEN 'new/' || path WHEN 3 THEN replace(path, ' ', '_') ELSE path END AS local,
          '@@ -' || entry || ' +' || entry || ' @@' || chr(10) || '-a' || k || chr(10) || '+b' || k AS body FROM e""",
    "x18_hunks": f"SELECT p_partkey AS file_id, 1 AS hunk, 9 AS old_start, 2 AS old_count, 9 AS new_start, 1 AS new_count, 1 AS removed, 0 AS added FROM {_R} UNION ALL SELECT p_partkey, 2, 24, 3, 23, 4, 1, 2 FROM {_R}",
    "s22_patch_files": "SELECT p_partkey AS patch_id, u.path, ['git', 'index', 'equals', 'context', 'unified'][(p_partkey % 5 + 1)::INT] AS dialect FROM part, (VALUES ('x/one.v'), ('y/two.v')) u(path) WHERE p_partkey % 8 = 1",
    "w09_patch_offsets": f"SELECT p_partkey AS file_id, 1 AS hunk, 0 AS shift FROM {_R} UNION ALL SELECT p_partkey, 2, -1 FROM {_R}",
    "w09_patched_texts": f"SELECT p_partkey AS file_id, 35 AS n_lines, true AS has FROM {_R}",
    "w11_line_buckets": f"SELECT file_id, line, file_id || '|' || (line // 5 * 5) || '|style|issue ' || (file_id % 3) AS mark FROM {_F}",
    "w17_windows": f"SELECT p_partkey AS file_id, 1 AS hunk, 1 AS first, 30 AS last FROM {_R} UNION ALL SELECT p_partkey, 2, 3, 35 FROM {_R}",
    "j15_new_findings": f"SELECT file_id, line FROM {_F} WHERE line BETWEEN 6 AND 12 OR line BETWEEN 20 AND 29",
    "j16_fingerprints": f"SELECT file_id, line FROM {_F} WHERE file_id % 2 = 1 AND line < 20",
    "j17_in_ranges": f"SELECT file_id, line FROM {_F} WHERE file_id % 2 = 1 OR line IN (9, 24)",
    "j18_task_chunks": f"SELECT file_id, line FROM {_F}",
    "j19_context": "SELECT p_partkey AS file_id, 'state_t' AS definition FROM part WHERE p_partkey % 8 = 5",
    "j23_paths": "SELECT file_id AS entry, 'work/copy/' || path AS path, path AS found FROM f_path WHERE file_id % 8 = 2",
    "w08_chunk_tails": f"SELECT p_partkey AS file_id, 1 AS chunk FROM {_R}",
    "x20_numbered": "SELECT p_partkey AS file_id, '>>>     2 |   logic [N-1:0] data;' AS second FROM part WHERE p_partkey % 8 = 6",
    "x21_chunks": "SELECT p_partkey AS file_id, 1 AS chunks, true AS whole FROM part",
    "r16_fix_checks": f"SELECT p_partkey AS file_id, '' AS fails, CASE WHEN p_partkey % 9 = 1 THEN 'new macros' ELSE '' END AS warnings FROM {_R}",
    "r17_integrity": "SELECT p_partkey AS file_id, false AS empty, false AS nul, true AS balanced FROM part",
    "u01_all_findings": f"SELECT 'Style' AS category, count(*) AS n FROM {_F} UNION ALL SELECT rule, count(*) FROM ({rules.ORACLE['r02_style']}) GROUP BY rule",
    "u03_identifiers": "SELECT p_partkey AS file_id, 'N,clk,data,dst,i' || p_partkey || ',src,valid' AS names FROM part WHERE p_partkey % 8 = 6",
    "u04_new_macros": f"SELECT p_partkey AS file_id FROM {_R} AND p_partkey % 9 = 1",
    "u06_exported": "SELECT 'p' || p_partkey AS package, 'DEPTH,MASK,byte_t,' || CASE WHEN p_partkey % 3 = 0 THEN 'idle,' ELSE '' END || 'pair_t,state_t,twice' AS exported FROM part WHERE p_partkey % 8 = 5",
    "a48_patch_summary": f"SELECT p_partkey AS file_id, 2 AS hunks, 2 AS added, 2 AS removed, 0 AS net FROM {_R}",
    "a50_patch_outcomes": f"SELECT 'patched' AS status, count(*) AS n FROM {_R}",
}
