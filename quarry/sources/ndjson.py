"""Records as one JSON object a line: tolerant reading, an array fallback, and counted writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def objects(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with ``record``, a variant; blank lines, broken ones and those that hold no object go."""
    record = F.try_parse_json(line)
    return lines.withColumn("record", record).where(F.schema_of_variant("record").startswith("OBJECT"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return objects(spark.read.text(path)).select("record")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the elements of files that hold one JSON array, else the objects of their lines; each file decides for itself.

    A file with an array is one record to its reader, as such files are; the
    others are read again by lines, so that they split.
    """
    first = F.regexp_extract("value", r"^\s*(\S)", 1)
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    arrays = whole.where(first == "[").withColumn("all", F.try_parse_json("value")).where(F.schema_of_variant("all").startswith("ARRAY"))
    elements = arrays.select("file", F.explode(F.expr("try_variant_get(all, '$', 'array<variant>')")).alias("record"))
    elements = elements.where(F.schema_of_variant("record").startswith("OBJECT"))
    rest = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).join(arrays.select("file"), "file", "left_anti")
    return elements.select("record").unionByName(objects(rest).select("record"))


def write_ndjson(records: DataFrame, path: str, keep: Column | None = None, transform: dict[str, Column] | None = None) -> dict[str, int]:
    """Write the rows that keep holds for, with columns replaced or added as told; counts of all, written and skipped rows come from the same pass."""
    keep = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    mark = "_keep"
    while mark in records.columns or mark in (transform or {}):
        mark = "_" + mark
    seen = Observation()
    marked = records.withColumn(mark, keep).observe(seen, F.count(F.lit(1)).alias("total"), F.count(F.when(keep, 1)).alias("written"))
    marked.where(F.col(mark)).drop(mark).withColumns(transform or {}).write.mode("overwrite").json(path)
    n = seen.get
    return {"total": n["total"], "written": n["written"], "skipped": n["total"] - n["written"]}


def split_lines(lines: DataFrame, schema: str, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines as records of the schema, and the lines that are none: broken ones, those that hold no object, and those with a field of another kind. Blank lines are neither."""
    wide = f"{schema}, _bad string"
    some = lines.where(F.trim(line) != "")
    parsed = some.withColumn("_record", F.from_json(line, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))
    bad = ~is_object | F.col("_record").isNull() | F.col("_record._bad").isNotNull()
    return parsed.where(~bad).select("_record.*").drop("_bad"), parsed.where(bad).select(line)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    e, m = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id") % 5
    line = F.when(m == 0, F.col("props")).when(m == 1, "  ").when(m == 2, '{"k": ').when(m == 3, "[1, 2]").otherwise(F.concat(F.lit(" "), "props"))
    return objects(e.select("event_id", line.alias("value"))).select("event_id", F.expr("try_variant_get(record, '$.k', 'bigint')").alias("k"))


QUERIES = {"s05_ndjson_objects": _lines}
ORACLE = {"s05_ndjson_objects": "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events WHERE event_id % 5 IN (0, 4)"}
