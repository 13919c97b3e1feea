"""Where results go, and how they come back: lines of JSON, a file for each metric, tables with commas, and databases."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..staging import filesystem, new_folder
from .ndjson import read_ndjson, split_lines, write_ndjson

NULL = "\\N"


def write_metrics(rows: DataFrame, folder: str, metric: str = "metric") -> None:
    """A folder for each metric with one file of JSON lines; rows of one metric are one report, and are written by one task."""
    rows.repartition(metric).write.mode("overwrite").partitionBy(metric).json(folder)


def read_metrics(spark: SparkSession, folder: str, schema: str, metrics: list[str] | None = None) -> DataFrame:
    """The reports with their metric; of some metrics, if named, only their folders are read."""
    found = spark.read.schema(f"{schema}, metric string").json(folder)
    return found if metrics is None else found.where(F.col("metric").isin(*metrics))


def write_csv(rows: DataFrame, folder: str) -> int:
    """Lines with commas under a head, in UTF-8; what holds a comma, a quote or a line's end is quoted, and a null is not an empty text. Returns the number of rows."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").csv(folder, header=True, escape='"', nullValue=NULL)
    return seen.get["n"]


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(folder, header=True, multiLine=True, escape='"', nullValue=NULL, enforceSchema=False)


def write_findings(findings: DataFrame, folder: str, text: Column) -> dict[str, int]:
    """Findings twice, as metric lines and as documents for vectors, and counts by severity from the passes that write them."""
    level = F.upper(F.trim("severity"))
    known = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    seen = Observation()
    counts = [F.count(F.when(level == s, 1)).alias(s.lower()) for s in known] + [F.count(F.when(~level.isin(*known) | level.isNull(), 1)).alias("other"), F.count(F.lit(1)).alias("total")]
    findings.withColumn("severity", level).observe(seen, *counts).write.mode("overwrite").json(f"{folder}/metrics")
    documents = findings.select(F.to_json(F.struct(level.alias("severity"))).alias("metadata"), text.alias("page_content"), F.md5(text).alias("uuid"))
    write_ndjson(documents, f"{folder}/vectors", F.trim("page_content") != "")
    return dict(seen.get)


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "overwrite", **options) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def read_jdbc(spark: SparkSession, url: str, table: str, by: str | None = None, parts: int = 8, **options) -> DataFrame:
    """A table of a database; with a numeric column ``by`` it is read in parts of equal ranges between the least and greatest value, which the database is asked for. Nulls are in the first part."""
    ask = lambda **o: spark.read.format("jdbc").options(url=url, **options, **o).load()
    if by is None:
        return ask(dbtable=table)
    low, high = ask(query=f'SELECT MIN("{by}") AS a, MAX("{by}") AS b FROM {table}').first()
    return ask(dbtable=table) if low is None else ask(dbtable=table, partitionColumn=by, lowerBound=low, upperBound=int(high) + 1, numPartitions=parts)


def _documents(rows: DataFrame, query: str) -> DataFrame:
    """(uuid, page_content, metadata): each row as a document of its fields."""
    body = F.to_json(F.struct(*[F.col(c).alias(c.lower()) for c in rows.columns]))
    return rows.select(F.md5(body).alias("uuid"), body.alias("page_content"), F.to_json(F.struct(F.lit("sql").alias("source"), F.lit(query).alias("query"))).alias("metadata"))


def sql_documents(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """(uuid, page_content, metadata): each row that a query gives the database as a document of its fields."""
    return _documents(spark.read.format("jdbc").options(url=url, query=query, **options).load(), query)


# Databases that Python connects to. ``connect`` makes a connection as in PEP 249, with ? for values; it is called
# in the driver and in tasks on all executors, so it has to reach one database from everywhere.

ROWS = 10_000


def write_rows(rows: DataFrame, connect: Callable, table: str, columns: str) -> int:
    """Rows into a new table, each task's in one transaction, which also notes the task's part: one that runs again adds nothing. Returns the number of rows."""
    names, parts = ", ".join(f'"{c}"' for c in rows.columns), f"{table}_parts"
    con = connect()
    con.execute(f"CREATE TABLE {table} ({columns})")
    con.execute(f"CREATE TABLE {parts} (part INTEGER PRIMARY KEY)")
    con.commit()
    con.close()
    insert = f"INSERT INTO {table} ({names}) VALUES ({', '.join('?' * len(rows.columns))})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, n, part = connect(), 0, TaskContext.get().partitionId()
        try:
            con.execute("BEGIN IMMEDIATE")  # tasks write one after another; each waits here
            new = con.execute(f"SELECT COUNT(*) FROM {parts} WHERE part = ?", (part,)).fetchone()[0] == 0
            if new:
                con.execute(f"INSERT INTO {parts} VALUES (?)", (part,))
            for batch in batches:
                n += batch.num_rows
                if new:
                    con.executemany(insert, zip(*[c.to_pylist() for c in batch.columns], strict=True))
            con.commit()
        finally:
            con.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def ask_rows(questions: DataFrame, connect: Callable, query: str, schema: str) -> DataFrame:
    """What a query gives for each row of questions, whose first column only numbers it and whose others are the query's values in order; names and types as in schema, rows in batches."""
    names = [f.name for f in questions.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for values in batch.astype(object).itertuples(index=False, name=None):
                con = connect()
                try:
                    found = con.execute(query, values[1:])
                    while got := found.fetchmany(ROWS):
                        yield pd.DataFrame(got, columns=names, dtype=object)
                finally:
                    con.close()

    return questions.mapInPandas(run, schema)


def read_rows(spark: SparkSession, connect: Callable, table: str, by: str, schema: str, where: str = "TRUE", rows: int = 500_000) -> DataFrame:
    """The columns of schema of a table's rows that fit a condition, both of which are the database's work; read in parts of equal ranges of an integer column that is never null, of about the number of rows if its values are dense."""
    names = ", ".join(f'"{f.name}"' for f in spark.createDataFrame([], schema).schema)
    con = connect()
    low, high = con.execute(f"SELECT MIN({by}), MAX({by}) FROM {table}").fetchone()
    con.close()
    if low is None:
        return spark.createDataFrame([], schema)
    parts = max(8, -(-(high - low + 1) // rows))
    step = -(-(high - low + 1) // parts)
    ranges = spark.range(0, parts, 1, parts).select("id", (F.lit(low) + F.col("id") * step).alias("a"), (F.lit(low) + (F.col("id") + 1) * step).alias("b"))
    return ask_rows(ranges, connect, f"SELECT {names} FROM {table} WHERE {by} >= ? AND {by} < ? AND ({where})", schema)


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _database(s: SparkSession) -> Callable:
    """A new database, in one file of the folder that the driver and all executors share, for queries that show the way there and back. Writers wait for each other up to an hour."""
    folder = new_folder(s, "database")
    at, files = filesystem(s, folder)
    files.mkdirs(at)
    if at.toUri().getScheme() not in (None, "file"):
        raise RuntimeError(f"a database file needs a shared folder that is mounted, not {folder}")
    path = f"{at.toUri().getPath()}/rows.db"
    return lambda: sqlite3.connect(path, timeout=3600, isolation_level=None)


def _filtered(s: SparkSession, d: str) -> DataFrame:
    """Orders written as lines, some left out and one column made anew, and read back."""
    o, path = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"), new_folder(s, "lines")
    write_ndjson(o, path, F.col("o_orderstatus") != "F", {"o_orderstatus": F.lower("o_orderstatus"), "cents": F.round(F.col("o_totalprice") * 100).cast("long")})
    get = lambda c, kind: F.expr(f"variant_get(record, '$.{c}', '{kind}')").alias(c)
    return read_ndjson(s, path).select(get("o_orderkey", "bigint"), get("o_orderstatus", "string"), get("cents", "bigint"))


def _csv(s: SparkSession, d: str) -> DataFrame:
    """Texts with commas, quotes and line ends, nulls and empty ones, there and back."""
    docs, path = s.read.parquet(f"{d}/documents.parquet"), new_folder(s, "csv")
    k = F.col("doc_id")
    text = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.lit("")).otherwise(_text('say "', F.substring("text", 1, 40), '",\n', k))
    write_csv(docs.select("doc_id", text.alias("note"), "n_chars"), path)
    back = read_csv(s, path, "doc_id long, note string, n_chars long")
    return back.select("doc_id", F.md5(F.coalesce("note", F.lit("-"))).alias("digest"), "n_chars")


def _metrics(s: SparkSession, d: str) -> DataFrame:
    """Counts of findings by kind as a file for each, of which two are read back."""
    li, path = s.read.parquet(f"{d}/lineitem.parquet"), new_folder(s, "metrics")
    write_metrics(li.groupBy(F.concat(F.lit("m_"), "l_returnflag").alias("metric"), F.col("l_linestatus").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").cast("date").alias("last")), path)
    return read_metrics(s, path, "state string, n long, last date", ["m_R", "m_A"])


def _finding_lines(s: SparkSession, d: str) -> DataFrame:
    """Findings as lines and documents; what both hold, beside the counts from writing."""
    li, path = s.read.parquet(f"{d}/lineitem.parquet"), new_folder(s, "findings")
    level = F.when(F.col("l_discount") >= 0.08, " critical").when(F.col("l_discount") >= 0.05, "High").when(F.col("l_discount") >= 0.02, "medium").when(F.col("l_tax") >= 0.04, "info")
    counts = write_findings(li.select("l_orderkey", "l_linenumber", level.alias("severity")), path, F.when(F.col("l_linenumber") < 6, _text("line ", F.col("l_linenumber"), " of ", F.col("l_orderkey"))).otherwise(" "))
    lines = s.read.schema("severity string").json(f"{path}/metrics").groupBy(F.coalesce("severity", F.lit("-")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    said = s.createDataFrame([(f"count {k}", v) for k, v in counts.items()], "severity string, n long")
    documents = s.read.schema("uuid string, page_content string").json(f"{path}/vectors").agg(F.lit("documents").alias("severity"), F.countDistinct("uuid").alias("n"))
    return lines.unionByName(said).unionByName(documents)


def _directives(s: SparkSession, d: str) -> DataFrame:
    """Directives as lines among which are broken ones; good and bad come back apart."""
    e, path = s.read.parquet(f"{d}/events.parquet"), new_folder(s, "directives")
    k = F.col("event_id")
    good = F.to_json(F.struct(k.alias("id"), _text("rtl/m", k % 50, ".sv").alias("file_path"), F.upper("event_type").alias("action")))
    line = F.when(k % 9 == 0, F.substring(good, 1, 20)).when(k % 9 == 1, F.lit("[1]")).when(k % 9 == 2, F.lit(" ")).when(k % 9 == 3, F.lit('{"id": "x"}')).otherwise(good)
    e.select(line.alias("value")).write.text(path)
    rows, bad = split_lines(s.read.text(path), "id long, file_path string, action string")
    return rows.select("id", "file_path", "action").unionByName(bad.groupBy(F.lit(None).cast("long").alias("id"), F.col("value").alias("file_path")).agg(F.lit("bad").alias("action")))


def _jdbc(s: SparkSession, d: str) -> DataFrame:
    """Orders into a database and back in parts; a filter and columns are the database's work."""
    connect = _database(s)
    write_rows(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), connect, "orders", "o_orderkey INTEGER, o_custkey INTEGER, o_orderstatus TEXT, o_totalprice REAL")
    return read_rows(s, connect, "orders", "rowid", "o_orderkey long, o_custkey long, o_totalprice double", "o_orderstatus <> 'P'")


def _sql_documents(s: SparkSession, d: str) -> DataFrame:
    connect, query = _database(s), "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey"
    write_rows(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment"), connect, "customer", "c_custkey INTEGER, c_nationkey INTEGER, c_mktsegment TEXT")
    return _documents(ask_rows(s.range(0, 1, 1, 1), connect, query, "c_nationkey int, n long"), query).select("page_content", "metadata")


QUERIES = {"s07_filtered_lines": _filtered, "s13_csv": _csv, "s14_metric_files": _metrics, "s15_finding_lines": _finding_lines, "s16_directives": _directives, "s19_jdbc": _jdbc, "s20_sql_documents": _sql_documents}
_LEVEL = "CASE WHEN l_discount >= 0.08 THEN 'CRITICAL' WHEN l_discount >= 0.05 THEN 'HIGH' WHEN l_discount >= 0.02 THEN 'MEDIUM' WHEN l_tax >= 0.04 THEN 'INFO' END"
ORACLE = {
    "s07_filtered_lines": "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, round(o_totalprice * 100)::BIGINT AS cents FROM orders WHERE o_orderstatus <> 'F'",
    "s13_csv": """SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN '-' WHEN doc_id % 4 = 1 THEN '' ELSE 'say "' || substring(text, 1, 40) || '",' || chr(10) || doc_id END) AS digest, n_chars FROM documents""",
    "s14_metric_files": "SELECT 'm_' || l_returnflag AS metric, l_linestatus AS state, count(*) AS n, max(l_shipdate)::DATE AS last FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2",
    "s15_finding_lines": f"""
        WITH f AS (SELECT *, {_LEVEL} AS severity FROM lineitem)
        SELECT coalesce(severity, '-') AS severity, count(*) AS n FROM f GROUP BY 1
        UNION ALL SELECT 'count ' || lower(s), (SELECT count(*) FROM f WHERE severity = s) FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) v(s)
        UNION ALL SELECT 'count other', count(*) FROM f WHERE severity = 'INFO' OR severity IS NULL UNION ALL SELECT 'count total', count(*) FROM f
        UNION ALL SELECT 'documents', count(DISTINCT (l_linenumber, l_orderkey)) FROM f WHERE l_linenumber < 6""",
    "s16_directives": """
        WITH e AS (SELECT event_id AS id, 'rtl/m' || (event_id % 50) || '.sv' AS file_path, upper(event_type) AS action FROM events)
        SELECT * FROM e WHERE id % 9 > 3 UNION ALL SELECT NULL, substring('{"id":' || id || ',"file_path":"' || file_path || '"', 1, 20), 'bad' FROM e WHERE id % 9 = 0
        UNION ALL SELECT DISTINCT NULL::BIGINT, CASE id % 9 WHEN 1 THEN '[1]' ELSE '{"id": "x"}' END, 'bad' FROM e WHERE id % 9 IN (1, 3)""",
    "s19_jdbc": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'",
    "s20_sql_documents": """SELECT '{"c_nationkey":' || c_nationkey || ',"n":' || count(*) || '}' AS page_content, '{"source":"sql","query":"SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey"}' AS metadata FROM customer GROUP BY c_nationkey""",
}
