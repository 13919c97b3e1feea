"""Cutting lineage: tables written to a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only on one machine, where none is set, is one made; a cluster without one is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write and read back, so that a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def filesystem(spark: SparkSession, path: str):
    """The Hadoop path and the file system that it lies in, whatever the store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*dfs: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; other data frames are left alone."""
    for df in dfs:
        if getattr(df, "staged_at", None):
            at, fs = filesystem(df.sparkSession, df.staged_at)
            fs.delete(at, True)


class Pile:
    """A table that only grows: each round adds what is new, and nothing is written twice."""

    def __init__(self, spark: SparkSession, schema: str, name: str) -> None:
        self.spark, self.schema, self.at, self.rounds = spark, schema, new_folder(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write the rows, and return them as read back."""
        path = f"{self.at}/round={self.rounds}"
        self.rounds += 1
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        if not self.rounds:
            return self.spark.createDataFrame([], self.schema)
        out = self.spark.read.schema(self.schema).parquet(*[f"{self.at}/round={i}" for i in range(self.rounds)])
        out.staged_at = self.at
        return out
