"""Facts of sources as one table, read from each text once, and the relations that stand on it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arith, hdl_text
from ..staging import staged
from . import corpus

SCHEMA = f"file_id long, {hdl_text.COLUMNS}"


def extract(files: DataFrame) -> DataFrame:
    """All facts of (file_id, source): one pass over each text in an Arrow function, as brackets and nesting need a parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *row) for i, text in zip(batch["file_id"], batch["source"], strict=True) for row in hdl_text.facts(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({f"n{i}": "Int32" for i in range(1, 9)})

    return files.select("file_id", "source").mapInPandas(run, SCHEMA)


def of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(corpus.files(spark, sf_dir))


def kept(files: DataFrame) -> DataFrame:
    """The facts of files for what reads them more than once: parsed in one pass, and staged."""
    return staged(extract(files), "facts")


def definitions(f: DataFrame) -> DataFrame:
    kinds = ["module", "interface", "package", "task", "function"]
    return f.where(F.col("kind").isin(kinds)).select("file_id", "kind", "name", "line", F.col("n1").alias("ports"), F.col("n2").alias("params"), F.col("n3").alias("last"))


def instances(f: DataFrame) -> DataFrame:
    return f.where("kind = 'instance'").select("file_id", F.col("scope").alias("parent"), F.col("target").alias("child"), F.col("name").alias("instance"), "line", F.col("n1").alias("connections"), F.col("value").alias("label"))


def includes(f: DataFrame) -> DataFrame:
    return f.where("kind = 'include'").select("file_id", F.col("name").alias("target"), "line", F.col("target").alias("form"))


def imports(f: DataFrame) -> DataFrame:
    return f.where("kind = 'import'").select("file_id", F.col("name").alias("package"), F.col("target").alias("symbol"), "line", "scope")


def dependencies(f: DataFrame) -> DataFrame:
    """Includes and wildcard imports by line."""
    wild = imports(f).where("symbol = '*'").select("file_id", "line", F.lit("package_import").alias("kind"), F.col("package").alias("target"))
    return includes(f).select("file_id", "line", F.lit("include").alias("kind"), "target").unionByName(wild)


def packages(f: DataFrame) -> DataFrame:
    """(package, kind, name): what a package declares."""
    names = f.where("kind = 'package'").select("file_id", F.col("name").alias("scope"))
    inside = f.where(F.col("kind").isin("parameter", "typedef", "enum", "struct", "function", "task"))
    return inside.join(names, ["file_id", "scope"], "left_semi").select(F.col("scope").alias("package"), "kind", "name")


def overrides(f: DataFrame) -> DataFrame:
    return f.where("kind = 'override'").select("file_id", F.col("scope").alias("parent"), F.col("target").alias("child"), F.col("name").alias("param"), F.col("value"), "line")


def modports(f: DataFrame) -> DataFrame:
    """(interface, modport, direction, port), in rows."""
    each = f.where("kind = 'modport'").select(F.col("scope").alias("interface"), F.col("name").alias("modport"), F.explode(F.split("value", ",")).alias("p"))
    return each.select("interface", "modport", F.split("p", " ")[0].alias("direction"), F.split("p", " ")[1].alias("port"))


def generates(f: DataFrame) -> DataFrame:
    return f.where("kind = 'generate'").select("file_id", F.col("target").alias("form"), "name", F.col("value").alias("condition"), "line")


def symbols(f: DataFrame) -> DataFrame:
    """(file_id, kind, qualified): everything that has a name."""
    kinds = ["port", "signal", "parameter", "macro", "function", "task", "typedef", "enum", "struct"]
    return f.where(F.col("kind").isin(kinds)).select("file_id", "kind", F.concat_ws(".", "scope", "name").alias("qualified"))


def blocks(f: DataFrame) -> DataFrame:
    """Procedural blocks with their metrics, a row each, however many a line holds."""
    n = ("cc", "nesting", "cognitive", "loc", "bool_ops", "cases", "no_default", "blocking")
    return f.where("kind = 'block'").select("file_id", F.col("scope").alias("module"), F.col("name").alias("block"), "line", F.col("value").alias("clocks"), *[F.col(f"n{i}").alias(c) for i, c in enumerate(n, 1)])


def module_info(f: DataFrame) -> DataFrame:
    """(file_id, module, lines, ports, params, blocks, cc, nesting) of every module."""
    m = f.where("kind = 'module'").select("file_id", F.col("name").alias("module"), (F.col("n3") - F.col("line") + 1).alias("lines"), F.col("n1").alias("ports"), F.col("n2").alias("params"))
    b = f.where("kind = 'block'").groupBy("file_id", F.col("scope").alias("module")).agg(F.count(F.lit(1)).alias("blocks"), (F.sum(F.col("n1") - 1) + 1).alias("cc"), F.max("n2").alias("nesting"))
    return m.join(b, ["file_id", "module"], "left").withColumns({"blocks": F.coalesce("blocks", F.lit(0).cast("long")), "cc": F.coalesce("cc", F.lit(1).cast("long")), "nesting": F.coalesce("nesting", F.lit(0))})


def macros(f: DataFrame) -> DataFrame:
    """(file_id, macro, body, value): continued lines are joined, constants worked out."""

    @F.pandas_udf("long")
    def value(bodies: pd.Series) -> pd.Series:
        return bodies.map(arith.evaluate).astype("Int64")

    return f.where("kind = 'macro'").select("file_id", F.col("name").alias("macro"), F.col("value").alias("body"), value("value").alias("value"))


def line_counts(f: DataFrame) -> DataFrame:
    return f.where("kind = 'scope'").select("file_id", F.col("n1").alias("comment"), F.col("n2").alias("blank"), F.col("n3").alias("code"), F.col("n4").alias("directives"))


def lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no from 1, line)."""
    return files.select("file_id", F.posexplode(F.split("source", "\n", -1)).alias("at", "line")).select("file_id", (F.col("at") + 1).alias("line_no"), "line")


QUERIES = {
    "x01_includes": lambda s, d: dependencies(of(s, d)),
    "x02_definitions": lambda s, d: definitions(of(s, d)),
    "x03_ports": lambda s, d: of(s, d).where("kind = 'port'").select("file_id", F.col("scope").alias("module"), "name", F.col("target").alias("direction"), F.col("value").alias("type"), "line"),
    "x03_instances": lambda s, d: instances(of(s, d)).drop("label"),
    "x04_include_forms": lambda s, d: includes(of(s, d)).select("file_id", "target", "form"),
    "x05_packages": lambda s, d: packages(of(s, d)),
    "x05_imports": lambda s, d: imports(of(s, d)).drop("scope"),
    "x06_overrides": lambda s, d: overrides(of(s, d)),
    "x07_modports": lambda s, d: modports(of(s, d)),
    "x08_generates": lambda s, d: generates(of(s, d)),
    "x08_generate_instances": lambda s, d: instances(of(s, d)).where("label is not null").select("file_id", "label", "instance"),
    "x09_symbols": lambda s, d: symbols(of(s, d)),
    "x10_module_info": lambda s, d: module_info(of(s, d)).select("file_id", "module", "lines", "ports", "params", "blocks"),
    "x11_module_complexity": lambda s, d: module_info(of(s, d)).select("module", "cc", "nesting"),
    "x12_blocks": lambda s, d: blocks(of(s, d)).drop("blocking"),
    "x15_macros": lambda s, d: macros(of(s, d)),
    "w01_lines": lambda s, d: lines(corpus.files(s, d)).groupBy("file_id").agg(F.max("line_no").alias("n_lines")),
    "w02_comment_state": lambda s, d: line_counts(of(s, d)),
    "w03_depth": lambda s, d: blocks(of(s, d)).groupBy("file_id").agg(F.max("nesting").alias("deepest"), F.sum("cognitive").alias("cognitive")),
    "w04_block_ranges": lambda s, d: blocks(of(s, d)).select("file_id", "block", "line", "loc"),
    "g11_blocks_by_module": lambda s, d: blocks(of(s, d)).groupBy("module").agg(F.array_join(F.array_sort(F.collect_list("block")), ",").alias("blocks")),
    "g10_modport_usage": lambda s, d: modports(of(s, d)).groupBy("port").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "interface", "modport"))), ",").alias("used_by")),
}

_R, _P, _I, _T = (f"part WHERE p_partkey % 8 {c}" for c in ("< 4", "= 5", "= 6", "= 7"))
_M = "'m' || p_partkey"
ORACLE = {
    "x01_includes": "SELECT file_id, line, 'include' AS kind, target FROM f_inc UNION ALL SELECT file_id, line, 'package_import', package FROM f_imp",
    "x02_definitions": f"SELECT * FROM f_def UNION ALL SELECT p_partkey, 'function', 'f' || p_partkey, 32, 1, 0, 34 FROM {_R} UNION ALL SELECT p_partkey, 'function', 'twice', 7, 1, 0, 8 FROM {_P} UNION ALL SELECT p_partkey, 'task', 'idle', 9, 0, 0, 10 FROM {_P} AND p_partkey % 3 = 0",
    "x03_ports": f"SELECT p_partkey AS file_id, {_M} AS module, u.* FROM part, (VALUES ('clk', 'input', '', 5), ('rst_n', 'input', '', 5), ('a', 'input', '[7:0]', 6), ('q', 'output', 'reg [W-1:0]', 7)) u(name, direction, type, line) WHERE p_partkey % 8 < 4 UNION ALL SELECT p_partkey, 'i' || p_partkey, 'clk', 'input', '', 1 FROM {_I}",
    "x03_instances": "SELECT file_id, parent, child, instance, line, connections FROM f_inst",
    "x04_include_forms": "SELECT file_id, target, 'quoted' AS form FROM f_inc",
    "x05_packages": f"SELECT 'p' || p_partkey AS package, u.* FROM part, (VALUES ('parameter', 'DEPTH'), ('parameter', 'MASK'), ('typedef', 'state_t'), ('typedef', 'pair_t'), ('typedef', 'byte_t'), ('enum', 'state_t'), ('struct', 'pair_t'), ('function', 'twice')) u(kind, name) WHERE p_partkey % 8 = 5 UNION ALL SELECT 'p' || p_partkey, 'task', 'idle' FROM {_P} AND p_partkey % 3 = 0",
    "x05_imports": "SELECT file_id, package, '*' AS symbol, line FROM f_imp",
    "x06_overrides": f"""SELECT p_partkey AS file_id, {_M} AS parent, 'm' || (2 * p_partkey) AS child, 'W' AS param, CASE WHEN p_partkey % 7 = 0 THEN '"z"' ELSE '16' END AS value, 14 AS line FROM {_R}""",
    "x07_modports": "SELECT 'i' || p_partkey AS interface, u.* FROM part, (VALUES ('src', 'input', 'clk'), ('src', 'output', 'data'), ('src', 'output', 'valid'), ('dst', 'input', 'data'), ('dst', 'input', 'valid')) u(modport, direction, port) WHERE p_partkey % 8 = 6",
    "x08_generates": f"SELECT p_partkey AS file_id, 'explicit' AS form, 'generate' AS name, NULL AS condition, 27 AS line FROM {_R} UNION ALL SELECT p_partkey, 'for', 'g_loop', 'genvar i = 0; i < 4; i = i + 1', 28 FROM {_R}",
    "x08_generate_instances": f"SELECT p_partkey AS file_id, 'g_loop' AS label, 'u_gen' AS instance FROM {_R}",
    "x09_symbols": f"""SELECT p_partkey AS file_id, u.kind, {_M} || '.' || u.n AS qualified FROM part, (VALUES ('port', 'clk'), ('port', 'rst_n'), ('port', 'a'), ('port', 'q'), ('parameter', 'W'), ('parameter', 'NAME'), ('signal', 'w1'), ('signal', 'r1')) u(kind, n) WHERE p_partkey % 8 < 4
        UNION ALL SELECT p_partkey, 'function', {_M} || '.f' || p_partkey FROM {_R}
        UNION ALL SELECT p_partkey, u.kind, u.n || p_partkey FROM part, (VALUES ('macro', 'WIDTH'), ('macro', 'LONG')) u(kind, n) WHERE p_partkey % 8 = 4 UNION ALL SELECT p_partkey, 'macro', 'GUARD' FROM part WHERE p_partkey % 16 = 4
        UNION ALL SELECT p_partkey, u.kind, 'p' || p_partkey || '.' || u.n FROM part, (VALUES ('parameter', 'DEPTH'), ('parameter', 'MASK'), ('typedef', 'state_t'), ('typedef', 'pair_t'), ('typedef', 'byte_t'), ('enum', 'state_t'), ('struct', 'pair_t'), ('function', 'twice')) u(kind, n) WHERE p_partkey % 8 = 5
        UNION ALL SELECT p_partkey, 'task', 'p' || p_partkey || '.idle' FROM {_P} AND p_partkey % 3 = 0
        UNION ALL SELECT p_partkey, u.kind, 'i' || p_partkey || '.' || u.n FROM part, (VALUES ('port', 'clk'), ('parameter', 'N'), ('signal', 'data'), ('signal', 'valid')) u(kind, n) WHERE p_partkey % 8 = 6
        UNION ALL SELECT p_partkey, 'signal', 'tb_m' || (p_partkey // 8 * 8) || '.clk' FROM {_T} UNION ALL SELECT p_partkey, 'signal', 'tb_m' || (p_partkey // 8 * 8) || '.bus' FROM {_T} AND p_partkey % 5 = 2""",
    "x10_module_info": "SELECT file_id, name AS module, last - line + 1 AS lines, ports, params, CASE WHEN name LIKE 'lone%' THEN 0 ELSE 1 END AS blocks FROM f_def WHERE kind = 'module'",
    "x11_module_complexity": "SELECT name AS module, CASE WHEN name LIKE 'm%' THEN 3 ELSE 1 END AS cc, CASE WHEN name LIKE 'tb%' THEN 1 WHEN name LIKE 'lone%' THEN 0 ELSE 2 END AS nesting FROM f_def WHERE kind = 'module'",
    "x12_blocks": f"SELECT p_partkey AS file_id, {_M} AS module, 'always' AS block, 16 AS line, CASE WHEN p_partkey % 11 = 0 THEN 'clk,rst_n' ELSE 'clk' END AS clocks, 3 AS cc, 2 AS nesting, 5 AS cognitive, 9 AS loc, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS bool_ops, 1 AS cases, CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS no_default FROM {_R} UNION ALL SELECT p_partkey, 'tb_m' || (p_partkey // 8 * 8), 'initial', 5, '', 1, 1, 0, 3, 0, 0, 0 FROM {_T}",
    "x15_macros": "SELECT p_partkey AS file_id, 'WIDTH' || p_partkey AS macro, '8' AS body, 8 AS value FROM part WHERE p_partkey % 8 = 4 UNION ALL SELECT p_partkey, 'LONG' || p_partkey, '(1 + 2)', 3 FROM part WHERE p_partkey % 8 = 4 UNION ALL SELECT p_partkey, 'GUARD', '', NULL FROM part WHERE p_partkey % 16 = 4",
    "w01_lines": "SELECT p_partkey AS file_id, CASE WHEN p_partkey % 8 < 4 THEN 35 WHEN p_partkey % 8 = 4 THEN 7 WHEN p_partkey % 8 = 5 THEN CASE WHEN p_partkey % 3 = 0 OR p_partkey % 24 = 5 THEN 11 ELSE 10 END WHEN p_partkey % 8 = 6 THEN 6 ELSE 10 END AS n_lines FROM part",
    "w02_comment_state": """SELECT p_partkey AS file_id, CASE WHEN p_partkey % 8 < 4 THEN 5 ELSE 0 END AS comment,
        CASE WHEN p_partkey % 8 < 4 THEN CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1 END WHEN p_partkey % 8 = 4 THEN CASE WHEN p_partkey % 16 = 4 THEN 0 ELSE 3 END WHEN p_partkey % 8 = 5 THEN CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END WHEN p_partkey % 8 = 6 THEN 0 ELSE (p_partkey % 16 <> 7)::INT + (p_partkey % 24 <> 7)::INT END AS blank,
        CASE WHEN p_partkey % 8 < 4 THEN 30 - CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1 END WHEN p_partkey % 8 = 4 THEN CASE WHEN p_partkey % 16 = 4 THEN 7 ELSE 4 END WHEN p_partkey % 8 = 5 THEN CASE WHEN p_partkey % 3 = 0 THEN 11 WHEN p_partkey % 24 = 5 THEN 10 ELSE 9 END WHEN p_partkey % 8 = 6 THEN 6 ELSE 10 - (p_partkey % 16 <> 7)::INT - (p_partkey % 24 <> 7)::INT END AS code,
        CASE WHEN p_partkey % 8 < 4 THEN 1 WHEN p_partkey % 8 = 4 THEN CASE WHEN p_partkey % 16 = 4 THEN 6 ELSE 3 END ELSE 0 END AS directives FROM part""",
    "w03_depth": f"SELECT p_partkey AS file_id, 2 AS deepest, 5 AS cognitive FROM {_R} UNION ALL SELECT p_partkey, 1, 0 FROM {_T}",
    "w04_block_ranges": f"SELECT p_partkey AS file_id, 'always' AS block, 16 AS line, 9 AS loc FROM {_R} UNION ALL SELECT p_partkey, 'initial', 5, 3 FROM {_T}",
    "g11_blocks_by_module": "SELECT name AS module, CASE WHEN name LIKE 'tb%' THEN 'initial' ELSE 'always' END AS blocks FROM f_def WHERE kind = 'module' AND name NOT LIKE 'lone%'",
    "g10_modport_usage": "SELECT u.port, string_agg('i' || p_partkey || '.' || u.m, ',' ORDER BY 'i' || p_partkey || '.' || u.m) AS used_by FROM part, (VALUES ('clk', 'src'), ('data', 'src'), ('valid', 'src'), ('data', 'dst'), ('valid', 'dst')) u(port, m) WHERE p_partkey % 8 = 6 GROUP BY u.port",
}
