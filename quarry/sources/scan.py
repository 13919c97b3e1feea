"""Trees of source files, sheets, sidecar hashes, tool output and rule tables as relations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import paths, scalars
from ..operators import corpus, rules

#: Folders and names that a scan passes over, and files that tell a build system.
PRUNED = (".git", ".svn", "__pycache__", "node_modules", "build", "dist", ".venv", "venv", ".pytest_cache")
BUILD_FILES = {"makefile": "make", "cmakelists.txt": "cmake", "fusesoc.core": "fusesoc", "build.xml": "ant", "meson.build": "meson", "bender.yml": "bender"}


def with_defaults(directories: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The default folders and the given ones, once each."""
    return tuple(dict.fromkeys(PRUNED + tuple(directories)))


def _inside(path: Column, root: str) -> Column:
    """A file's path below root, from the encoded form that readers give; root itself if it is a file: its name."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    top = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    below = F.regexp_replace(plain, r"^\w+:/+(?:[^/]+:\d+/+)?", "/")
    return F.when(F.contains(below, F.lit(top)), F.substring(below, F.locate(top, below) + len(top), F.length(below))).otherwise(F.element_at(F.split(below, "/"), -1))


def names(spark: SparkSession, root: str, suffixes: tuple[str, ...] = corpus.SUFFIXES, directories: tuple[str, ...] = PRUNED, globs: tuple[str, ...] = ()) -> DataFrame:
    """(path, size_bytes) of the files under root that a scan keeps: from the listing alone, no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listed.where(_kept(F.col("_metadata.file_path"), root, suffixes, directories, globs)).select(_inside(F.col("_metadata.file_path"), root).alias("path"), F.col("length").alias("size_bytes"))


def _kept(path: Column, root: str, suffixes: tuple[str, ...], directories: tuple[str, ...], globs: tuple[str, ...]) -> Column:
    inside = _inside(path, root)
    return (rules.suffix(inside).isin(*suffixes) if suffixes else F.lit(True)) & ~paths.excluded(inside, directories, globs)


def tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = corpus.SUFFIXES, directories: tuple[str, ...] = PRUNED, globs: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(path, source, size_bytes) of the files under root, or of root itself if it is a file.

    Which files are kept is asked of their names while the scan is planned, so
    that what is passed over is never opened, and the rest goes to tasks by size.
    ``most``, if given, keeps the first files by path: their last name is found
    first, among names alone. Bytes that are no UTF-8 are left out. Spark's
    listing leaves out files without a byte and names that begin with a dot or an
    underscore, and so do these relations.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = listed.where(_kept(F.col("_metadata.file_path"), root, suffixes, directories, globs))
    if most is not None:
        last = names(spark, root, suffixes, directories, globs).orderBy("path").limit(most).agg(F.max("path")).first()[0] if most > 0 else None
        kept = kept.where(_inside(F.col("_metadata.file_path"), root) <= F.lit(last)) if last is not None else kept.where("false")

    @F.pandas_udf(StringType())
    def text(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: bytes(b).decode("utf-8", "ignore").replace("\r\n", "\n"))

    return kept.select(_inside(F.col("_metadata.file_path"), root).alias("path"), text("content").alias("source"), F.col("length").alias("size_bytes"))


def regular(cached: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """The cached rows (by path) that are still regular files with a byte at least under root; no file is opened."""
    there = names(spark, root, (), ()).select("path").distinct()
    return cached.join(there, "path", "left_semi")


def changed(files: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Files whose md5 is not the one stored for their path."""
    return files.withColumn("digest", F.md5("source")).join(sidecar.select("path", "digest"), ["path", "digest"], "left_anti")


def build_systems(files: DataFrame) -> DataFrame:
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    known = F.create_map(*[F.lit(x) for kv in BUILD_FILES.items() for x in kv])
    return files.where(~F.contains("path", F.lit("/"))).select(F.element_at(known, name).alias("build_system")).where("build_system is not null").distinct()


def lint_output(lines: DataFrame, line: str = "value") -> DataFrame:
    """(severity, code, file, line, column, message) of a linter's text: two published forms."""
    first = r"^%(Error|Warning)(?:-([A-Z0-9_]+))?:\s*([^:\s]+):(\d+)(?::(\d+))?:\s*(.*)$"
    second = r"^([^:\s]+):(\d+):(\d+)(?:-\d+)?:\s*(.*?)\s*\[([\w-]+)\]\s*$"
    c = F.col(line)
    a = lambda i: F.regexp_extract(c, first, i)
    b = lambda i: F.regexp_extract(c, second, i)
    is_first = c.rlike(first)
    return lines.where(is_first | c.rlike(second)).select(
        F.when(is_first, F.lower(a(1))).otherwise("warning").alias("severity"), F.when(is_first, a(2)).otherwise(b(5)).alias("code"), F.when(is_first, a(3)).otherwise(b(1)).alias("file"),
        F.when(is_first, a(4)).otherwise(b(2)).try_cast("int").alias("line"), F.when(is_first, a(5)).otherwise(b(3)).try_cast("int").alias("column"), F.when(is_first, a(6)).otherwise(b(4)).alias("message"),
    )


def rule_tables(documents: DataFrame, marker: str = "Rule ID") -> DataFrame:
    """(doc, table_no, rule_id, description, action) of markdown tables whose header holds the marker.

    Columns are found by words of their heads, a table ends at the first line
    without a bar; a document may hold several.
    """
    rows = documents.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    bar = F.trim("line").startswith("|")
    head = bar & F.contains("line", F.lit(marker))
    by = Window.partitionBy("doc").orderBy("at")
    # A stretch of lines with bars is a table from its header on.
    t = rows.withColumns({"bar": bar, "head": head}).withColumn("stretch", F.sum((~F.col("bar")).cast("int")).over(by)).where("bar")
    in_stretch = Window.partitionBy("doc", "stretch").orderBy("at")
    t = t.withColumn("header", F.max(F.when(F.col("head"), F.col("line"))).over(in_stretch)).where("header is not null and not head").where(~F.col("line").rlike(r"^\s*\|[\s:|-]+$"))
    cells = lambda c: F.transform(F.split(F.regexp_replace(F.trim(c), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    place = lambda word: F.array_position(F.transform(cells(F.col("header")), lambda h: F.lower(h).contains(word)), True)
    cell = lambda word: F.when(place(word) > 0, F.try_element_at(cells(F.col("line")), place(word).cast("int")))
    n = F.dense_rank().over(Window.partitionBy("doc").orderBy("stretch"))
    return t.select("doc", n.alias("table_no"), cell("rule id").alias("rule_id"), cell("description").alias("description"), cell("action").alias("action"))


def section(text: Column, keyword: str) -> Column:
    """The body of the first second-level section whose head holds the keyword; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, rf"(?ims)^##[ \t]+[^\n]*{keyword}[^\n]*\n(.*?)(?=^##[ \t]|\z)", 1), r"^\s+|\s+$", ""), F.lit(""))


def sheets(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows of the sheet Analysis and of every sheet with the prefix, empty rows left out, with a readable name."""
    return rows.where((F.col("sheet") == "Analysis") | F.col("sheet").startswith(prefix)).withColumn("title", scalars.title(F.regexp_replace("sheet", "^" + prefix, "")))


def with_summary(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows, then one that sums numeric columns and counts filled cells of the others, all as text."""
    sums = [F.coalesce(F.sum(F.col(c).cast("string").try_cast("double")).cast("string"), F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1)).cast("string")).alias(c) for c in columns]
    return rows.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("string").alias(c) for c in columns]).unionByName(rows.agg(*sums).select(F.lit("TOTAL").alias(key), *columns))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/benchmark.parquet")


def _lint(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("%Warning-WIDTH: rtl/m"), k.cast("string"), F.lit(".v:12:5: wide"))).when(k % 3 == 1, F.concat(F.lit("rtl/m"), k.cast("string"), F.lit(".v:7:3-9: no tabs [no-tabs]"))).otherwise("... Use lint_off")
    return s.read.parquet(f"{d}/part.parquet").select(line.alias("value"))


def _tables(s: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id").cast("string")
    text = F.concat_ws("\n", F.lit("# Notes"), F.lit("| Rule ID | Description | Standard Action |"), F.lit("|---|---|---|"), F.concat(F.lit("| R"), k, F.lit(" | keep it | FIX |")), F.concat(F.lit("| S"), k, F.lit(" | leave it | SKIP |")), F.lit("text"), F.lit("| Other | Head |"), F.lit("| a | b |"), F.lit(""), F.lit("| Action | Rule ID |"), F.lit("|:--|--:|"), F.concat(F.lit("| FIX | T"), k, F.lit(" |")), F.lit("## Naming constraints"), F.concat(F.lit("use m"), k), F.lit("## Other"), F.lit("x"))
    return _pages(s, d).select(F.col("item_id").alias("doc"), text.alias("text"))


def _sheets(s: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey") % 4
    sheet = F.when(o == 0, "Analysis").when(o == 1, "static_lint_report").when(o == 2, "static_cdc").otherwise("Summary")
    return s.read.parquet(f"{d}/orders.parquet").select(sheet.alias("sheet"), F.col("o_orderkey").alias("row_id"), F.when(o == 2, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("cell"))


def _cached(s: SparkSession, d: str) -> DataFrame:
    """Cached entries: all files of the folder, and as many names that are none."""
    there = names(s, d, (".parquet",)).withColumn("size", F.col("size_bytes")).drop("size_bytes")
    cached = there.unionByName(there.withColumn("path", F.concat(F.lit("gone/"), "path"))).unionByName(s.read.parquet(f"{d}/region.parquet").select(F.concat("r_name", F.lit(".sv")).alias("path"), F.lit(1).cast("long").alias("size")))
    return regular(cached, s, d).select(F.regexp_replace("path", r"\.parquet.*$", "").alias("name")).distinct()


QUERIES = {
    "s01_scan": lambda s, d: tree(s, d, (".parquet",)).select(F.regexp_replace("path", r"\.parquet.*$", "").alias("name")).distinct(),
    "s03_single_file": lambda s, d: tree(s, f"{d}/region.parquet", (".parquet",)).select("path"),
    "s04_regular_files": _cached,
    "s09_analysis_sheets": lambda s, d: sheets(_sheets(s, d), "static_").groupBy("sheet").agg(F.count(F.lit(1)).alias("n")),
    "s10_renamed_columns": lambda s, d: _sheets(s, d).withColumnsRenamed({"cell": "Feedback"}).select("row_id", scalars.filled(F.col("Feedback"), "APPROVE").alias("Action")),
    "s11_static_titles": lambda s, d: sheets(_sheets(s, d), "static_").where("sheet <> 'Analysis' and cell is not null").select("title").distinct(),
    "s12_summary_row": lambda s, d: with_summary(s.read.parquet(f"{d}/nation.parquet"), "n_name", ["n_nationkey", "n_regionkey"]),
    "s17_rule_tables": lambda s, d: rule_tables(_tables(s, d)),
    "s18_sections": lambda s, d: _tables(s, d).select("doc", section(F.col("text"), "constraints").alias("body")),
    "s20_passthrough": lambda s, d: s.sql("SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey", nation=s.read.parquet(f"{d}/nation.parquet")),
    "s21_changed_files": lambda s, d: changed(corpus.files(s, d), corpus.files(s, d).where("file_id % 3 <> 0").select("path", F.md5("source").alias("digest"))).select("path"),
    "s23_lint_output": lambda s, d: lint_output(_lint(s, d)),
    "s24_build_systems": lambda s, d: build_systems(corpus.files(s, d).select("path").unionByName(s.createDataFrame([("Makefile",), ("sub/CMakeLists.txt",), ("meson.build",)], "path string"))),
    "s29_audit_sheet": lambda s, d: _sheets(s, d).select(F.when(F.lower("sheet").rlike("audit.*log|log.*audit"), "log").when(F.lower("sheet").contains("decision"), "decisions").when(F.lower("sheet").contains("summary"), "summary").otherwise("other").alias("role"), "sheet").distinct(),
    "u07_exclusions": lambda s, d: s.createDataFrame([(x,) for x in with_defaults(("build", "sim_out"))], "directory string"),
}
_NAMES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()
ORACLE = {
    "s01_scan": f"SELECT unnest({_NAMES}) AS name",
    "s03_single_file": "SELECT 'region.parquet' AS path",
    "s04_regular_files": f"SELECT unnest({_NAMES}) AS name",
    "s09_analysis_sheets": "SELECT ['Analysis', 'static_lint_report', 'static_cdc'][(o_orderkey % 4 + 1)::INT] AS sheet, count(*) AS n FROM orders WHERE o_orderkey % 4 < 3 GROUP BY 1",
    "s10_renamed_columns": "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 4 = 2 THEN 'APPROVE' ELSE o_orderpriority END AS \"Action\" FROM orders",
    "s11_static_titles": "SELECT 'Lint Report' AS title",
    "s12_summary_row": "SELECT n_name, n_nationkey::VARCHAR AS n_nationkey, n_regionkey::VARCHAR AS n_regionkey FROM nation UNION ALL SELECT 'TOTAL', sum(n_nationkey)::DOUBLE::VARCHAR, sum(n_regionkey)::DOUBLE::VARCHAR FROM nation",
    "s17_rule_tables": "SELECT item_id AS doc, 1 AS table_no, 'R' || item_id AS rule_id, 'keep it' AS description, 'FIX' AS action FROM benchmark UNION ALL SELECT item_id, 1, 'S' || item_id, 'leave it', 'SKIP' FROM benchmark UNION ALL SELECT item_id, 2, 'T' || item_id, NULL, 'FIX' FROM benchmark",
    "s18_sections": "SELECT item_id AS doc, 'use m' || item_id AS body FROM benchmark",
    "s20_passthrough": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL",
    "s21_changed_files": "SELECT path FROM f_path WHERE file_id % 3 = 0",
    "s23_lint_output": "SELECT 'warning' AS severity, 'WIDTH' AS code, 'rtl/m' || p_partkey || '.v' AS file, 12 AS line, 5 AS \"column\", 'wide' AS message FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'warning', 'no-tabs', 'rtl/m' || p_partkey || '.v', 7, 3, 'no tabs' FROM part WHERE p_partkey % 3 = 1",
    "s24_build_systems": "SELECT 'make' AS build_system UNION ALL SELECT 'meson'",
    "s29_audit_sheet": "SELECT 'summary' AS role, 'Summary' AS sheet UNION ALL SELECT 'other', unnest(['Analysis', 'static_lint_report', 'static_cdc'])",
    "u07_exclusions": f"SELECT unnest({[*PRUNED, 'sim_out']}) AS directory",
}
