"""A stored table with keys: inserts and updates by key, as versions that appear whole or not at all.

Rows lie in buckets by a hash of their key. A merge reads and writes only the
buckets that its rows fall into, under a new folder, and then commits one small
file that names the folder of every bucket. The commit's number is the version;
it is renamed into place, which fails if another writer was first, and the merge
starts again from that one's version. A commit keeps the caller's token: a merge
that is tried again under the same token changes nothing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..staging import discard, filesystem, staged

#: How a column of a row that is there already gets its value.
NEW, FILL = "new", "fill"


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: tuple[str, ...], buckets: int = 16) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _commits(self) -> list[int]:
        at, fs = filesystem(self.spark, f"{self.folder}/commits")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()) if fs.exists(at) else []

    def version(self) -> int:
        """The newest version; 0 before the first merge."""
        return max(self._commits(), default=0)

    def _commit(self, version: int) -> dict:
        """What a commit says: its token, and the folder of each bucket that has one."""
        if not version:
            return {"token": None, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/commits/{version}", wholetext=True).first()["value"])

    def tokens(self) -> dict[str, int]:
        """The versions by their tokens."""
        if not self.version():
            return {}
        rows = self.spark.read.text(f"{self.folder}/commits", wholetext=True).select(F.get_json_object("value", "$.token").alias("token"), F.element_at(F.split("_metadata.file_path", "/"), -1).cast("int").alias("version"))
        return {r["token"]: r["version"] for r in rows.collect()}

    def read(self, version: int | None = None) -> DataFrame:
        """The newest rows, or those of a version."""
        return self._rows(self._commit(self.version() if version is None else version)["folders"])

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/data/{f}/bucket={b}" for b, f in folders.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, token: str, update: dict[str, str] | None = None, insert: bool = True, latest: Column | None = None) -> dict[str, int]:
        """Bring rows in, and say how many were inserted and updated.

        ``update`` tells which columns a row that is there already takes over: NEW
        ones as they are, FILL ones unless null; none is changed that it does not
        name, and without it all are NEW. Rows without a partner are inserted, or
        passed over where ``insert`` is false. Of several rows of one key that with
        the greatest ``latest`` counts, then the greatest by all columns. Rows with a
        null in a key are left out. Columns that rows lack are null.
        """
        names = [f.name for f in self.schema]
        update = {c: NEW for c in names if c not in self.keys} if update is None else update
        kinds = {f.name: f.dataType for f in self.schema}
        rows = rows.withColumn("_latest", F.lit(0) if latest is None else latest)
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names], "_latest").dropna(subset=list(self.keys))
        whole = F.struct("_latest", *[c for c in names if c not in self.keys]).alias("_row")
        # A partial aggregate: however often a key comes, few of its rows travel.
        rows = rows.groupBy(*self.keys).agg(F.max(whole).alias("_row")).select(*self.keys, "_row.*").drop("_latest")
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        done = self.tokens()
        if token in done:
            return {"version": done[token], "inserted": 0, "updated": 0}
        rows = staged(rows.withColumn("_bucket", bucket), "merge")
        try:
            return self._merge(rows, token, update, insert)
        finally:
            discard(rows)

    def _merge(self, rows: DataFrame, token: str, update: dict[str, str], insert: bool) -> dict[str, int]:
        names = [f.name for f in self.schema]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        while True:
            base = self.version()
            done = self.tokens()
            if token in done:
                return {"version": done[token], "inserted": 0, "updated": 0}
            folders = self._commit(base)["folders"]
            touched = sorted(r["_bucket"] for r in rows.select("_bucket").distinct().collect())  # at most one for each bucket
            if not touched:
                return {"version": base, "inserted": 0, "updated": 0}
            old = self._rows({str(b): folders[str(b)] for b in touched if str(b) in folders})
            o, n = old.withColumn("_old", F.lit(True)).alias("o"), rows.withColumn("_new", F.lit(True)).alias("n")
            both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in self.keys], "full" if insert else "left")
            there, came = F.col("_old").isNotNull(), F.col("_new").isNotNull()

            def value(c: str, there: Column = there, came: Column = came) -> Column:
                mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}")
                if c in self.keys:
                    return F.coalesce(mine, theirs)
                kept = {NEW: theirs, FILL: F.coalesce(theirs, mine)}.get(update.get(c), mine)
                return F.when(~there, theirs).when(came, kept).otherwise(mine)

            seen = Observation()
            merged = both.select(*[value(c).alias(c) for c in names], there.alias("_there"), came.alias("_came"))
            merged = merged.observe(seen, F.count(F.when(~F.col("_there"), 1)).alias("inserted"), F.count(F.when(F.col("_there") & F.col("_came"), 1)).alias("updated"))
            folder = uuid.uuid4().hex
            merged.drop("_there", "_came").withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.folder}/data/{folder}")
            if self._publish(base + 1, {"token": token, "folders": folders | {str(b): folder for b in self._written(folder)}}):
                return {"version": base + 1, **seen.get}

    def _written(self, folder: str) -> list[int]:
        at, fs = filesystem(self.spark, f"{self.folder}/data/{folder}")
        return [int(x.getPath().getName().removeprefix("bucket=")) for x in fs.listStatus(at) if x.getPath().getName().startswith("bucket=")]

    def _publish(self, version: int, commit: dict) -> bool:
        """Put a commit in place under its number; False if that number is taken."""
        jvm = self.spark._jvm
        draft, fs = filesystem(self.spark, f"{self.folder}/drafts/{uuid.uuid4().hex}")
        place, _ = filesystem(self.spark, f"{self.folder}/commits/{version}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        fs.mkdirs(place.getParent())
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(context.makeQualified(draft), context.makeQualified(place), never)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.toString()):
                raise
            return False
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the last ``keep`` versions reads; commits stay, for their tokens."""
        used = {f for v in self._commits()[-keep:] for f in self._commit(v)["folders"].values()}
        at, fs = filesystem(self.spark, f"{self.folder}/data")
        gone = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName() not in used] if fs.exists(at) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)
