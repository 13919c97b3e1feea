"""Signal integrity of sources: several drivers, unlike widths, inouts that are always driven, indexes out of range, memories that nothing sets.

Each detector turns a text into small rows by patterns, and what it compares
meets by file and name: an index and the declared range of its array, a port or
memory and the names that are driven or set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules

_RANGE = r"\b(?:reg|wire|logic)\s+(?:signed\s+)?(?:\[\s*\d+\s*:\s*\d+\s*\]\s*)?(\w+)\s*\[\s*(\d+)\s*:\s*(\d+)\s*\]"
_INDEX = r"(\w+)\s*\[\s*(\d+)\s*\]"
_MEMORY = r"\breg\s+(?:signed\s+)?\[[^\]\n]*\]\s*(\w+)\s*\[\s*\d+\s*:\s*\d+\s*\]"
_INOUT = r"\binout\s+(?:(?:wire|reg|logic|tri)\s+)?(?:signed\s+)?(?:\[[^\]\n]*\]\s*)?(\w+)"
_TRISTATE = r"(\w+)\s*=[^=;][^;]*\?[^;]*:\s*\d*'[bB]z"


def _found(files: DataFrame, pattern: str, *names: str) -> DataFrame:
    """(file_id, a column for each group): all matches in the texts' code."""
    all_ = [F.regexp_extract_all("code", F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    return files.select("file_id", F.explode(F.arrays_zip(*all_)).alias("x")).select("file_id", "x.*")


def _shuffled(df: DataFrame) -> DataFrame:
    """df as a join's side that is sorted and merged. Spark plans by the size of the files that names were made from, not by what comes out of texts, and would gather millions of names in the driver to broadcast them."""
    return df.hint("merge")


def code(files: DataFrame) -> DataFrame:
    """(file_id, code): texts without comments, for all detectors."""
    return files.select("file_id", rules.uncommented("source").alias("code"))


def out_of_range(c: DataFrame) -> DataFrame:
    """(file_id, name, detail): literal indexes outside the declared range of their array, whichever end is named first. Of several ranges of one name each is held against."""
    ranges = _found(c, _RANGE, "name", "a", "b").select("file_id", "name", *[F.col(x).cast("decimal(38,0)").alias(x) for x in "ab"])
    ranges = ranges.select("file_id", "name", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    index = _found(c, _INDEX, "name", "at").select("file_id", "name", F.col("at").cast("decimal(38,0)").alias("at")).distinct()
    hits = index.join(_shuffled(ranges), ["file_id", "name"]).where((F.col("at") < F.col("low")) | (F.col("at") > F.col("high")))
    return hits.select("file_id", "name", F.format_string("%s outside %s:%s", F.col("at").cast("string"), F.col("low").cast("string"), F.col("high").cast("string")).alias("detail"))


def unset_memories(c: DataFrame) -> DataFrame:
    """(file_id, name): memories that no line sets to a zero literal or names beside a reset."""
    memories = _found(c, _MEMORY, "name").distinct()
    lines = c.select("file_id", F.explode(F.split("code", "\n", -1)).alias("line")).where(F.col("line").rlike(r"'0|reset"))
    # What stands before the last zero literal that is assigned, or before the last word of reset.
    before = F.array(F.regexp_extract("line", r"^(.*)=.*'0", 1), F.regexp_extract("line", r"^(.*)reset", 1))
    names = F.array_distinct(F.flatten(F.transform(before, lambda x: F.regexp_extract_all(x, F.lit(r"\w+"), F.lit(0)))))
    return memories.join(_shuffled(lines.select("file_id", F.explode(names).alias("name")).distinct()), ["file_id", "name"], "left_anti")


def driven_inouts(c: DataFrame) -> DataFrame:
    """(file_id, name): inout ports without an assignment that can let go of the wire."""
    return _found(c, _INOUT, "name").distinct().join(_shuffled(_found(c, _TRISTATE, "name").distinct()), ["file_id", "name"], "left_anti")


def findings(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, detail) of all five detectors. A null or empty text has none."""
    c = code(files)
    row = lambda df, kind, name, detail: df.select("file_id", F.lit(kind).alias("kind"), name.alias("name"), detail.cast("string").alias("detail"))
    none, name = F.lit(None), F.col("name")
    out = row(rules.drivers(files), "drivers", F.col("target"), F.col("drivers"))
    out = out.unionByName(row(rules.widths(files), "width", F.col("left"), F.col("right")))
    out = out.unionByName(row(driven_inouts(c), "inout", name, none)).unionByName(row(out_of_range(c), "range", name, F.col("detail")))
    return out.unionByName(row(unset_memories(c), "memory", name, none))


def _made(s: SparkSession, d: str) -> DataFrame:
    """Sources made from the rows of part, with every detector's faults and their opposites by the number of the part."""
    k = F.col("p_partkey")
    text = lambda *x: F.concat(*[v.cast("string") if isinstance(v, Column) else F.lit(v) for v in x])
    when = lambda cond, a, b: F.when(cond, a if isinstance(a, Column) else F.lit(a)).otherwise(b if isinstance(b, Column) else F.lit(b))
    lines = [
        text("module m", k, "("), F.lit("  inout wire [3:0] pad,"), F.lit("  inout bus);"), F.lit("  reg [7:0] ram [0:15];"), F.lit("  reg [7:0] rom[31:16];"), F.lit("  wire w [2:0]; // reg [1:0] fake [0:1];"),
        when(k % 2 == 0, "  assign pad = en ? data : 4'bz;", "  assign pad = data;"), when(k % 3 == 0, "  assign bus = en\n    ? d : 1'bz;", "  // assign bus = en ? d : 1'bz;"),
        text("  assign q = ram[", k % 20, "] + rom [ ", k % 40, " ] + w[", k % 4, "];"), when(k % 5 == 0, "  assign q = 0;", ""),
        when(k % 7 == 0, "  always @(posedge c) ram[0] <= '0;", "  always @(posedge c) ram[0] <= x;"), when(k % 4 == 1, "  if (x) rom[16] <= y; else if (reset) z <= 1;", "  if (reset) rom[17] <= y;"),
        when(k % 6 == 0, "  assign lo[3:0] = hi[7:0];", "  assign lo[3:0] = hi[3:0];"), F.lit("endmodule"),
    ]
    return s.read.parquet(f"{d}/part.parquet").select(k.alias("file_id"), F.concat_ws("\n", *lines).alias("source"))


QUERIES = {
    "r07_integrity": lambda s, d: findings(_made(s, d)),
    "x14_ranges": lambda s, d: _found(code(_made(s, d)), _RANGE, "name", "a", "b").groupBy("name", "a", "b").agg(F.count(F.lit(1)).alias("files")),
}
_P = "FROM part WHERE p_partkey"
ORACLE = {
    "r07_integrity": f"""
        SELECT p_partkey AS file_id, 'drivers' AS kind, 'q' AS name, '2' AS detail {_P} % 5 = 0
        UNION ALL SELECT p_partkey, 'width', 'lo[3:0]', 'hi[7:0]' {_P} % 6 = 0
        UNION ALL SELECT p_partkey, 'inout', 'pad', NULL {_P} % 2 = 1 UNION ALL SELECT p_partkey, 'inout', 'bus', NULL {_P} % 3 <> 0
        UNION ALL SELECT p_partkey, 'range', 'ram', (p_partkey % 20) || ' outside 0:15' {_P} % 20 > 15
        UNION ALL SELECT p_partkey, 'range', 'rom', (p_partkey % 40) || ' outside 16:31' {_P} % 40 NOT BETWEEN 16 AND 31
        UNION ALL SELECT p_partkey, 'range', 'w', '3 outside 0:2' {_P} % 4 = 3
        UNION ALL SELECT p_partkey, 'memory', 'ram', NULL {_P} % 7 <> 0 UNION ALL SELECT p_partkey, 'memory', 'rom', NULL {_P} % 4 <> 1""",
    "x14_ranges": "SELECT u.name, u.a, u.b, count(*) AS files FROM part, (VALUES ('ram', '0', '15'), ('rom', '31', '16'), ('w', '2', '0')) u(name, a, b) GROUP BY ALL",
}
