"""What the operators share: reading tables, and a folder that all executors see."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches held to TEXTS rows, so that neither executor nor Python worker holds many long texts at once.

    Only sizes of batches depend on this setting; a smaller one stays.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXTS:
        conf.set(name, str(TEXTS))
    return docs


def worker_state(name: str) -> dict:
    """A dictionary that outlives tasks in a worker's process; functions that travel by value have no module to keep one in."""
    return sys.modules.setdefault("quarry_worker_state", types.ModuleType("quarry_worker_state")).__dict__.setdefault(name, {})


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only on one machine, where none is set, is one made; a cluster without one is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*dfs: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; other data frames are left alone."""
    for df in dfs:
        path = getattr(df, "staged_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """As staged, but in buckets by key: what groups or joins by that key later reads them where they are and moves only the other side.

    Spark knows buckets of catalog tables only; ``dropped`` takes the entry and the files away.
    """
    spark = df.sparkSession
    unique = f"quarry_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/quarry/{unique}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(min(buckets, 100_000), key).saveAsTable(unique)
    out = spark.table(unique)
    out.staged_at, out.catalog_name = path, unique
    return out


def dropped(df: DataFrame) -> None:
    """Take a bucketed table out of the catalog and delete its files."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.catalog_name}")
    discard(df)


def row_key(column: str, *fallback: Column) -> Column:
    """A 64-bit hash of an id; a null id is hashed by the fallback columns, so that nulls spread too."""
    return F.when(F.col(column).isNull(), F.xxhash64(*fallback)).otherwise(F.xxhash64(F.col(column)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
