import os
import subprocess
import sys
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from quarry.sources import sinks

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_databases_are_reached_from_all_executors(tmp_path):
    """A database inside one process is not seen by the executors of a cluster."""
    root = Path(__file__).resolve().parents[1]
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from quarry.sources import sinks
conf = {{"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "600m", "spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.sql.warehouse.dir": "{tmp_path}/w"}}
spark = SparkSession.builder.master("local-cluster[2,1,900]").config(map=conf).getOrCreate()
for name in ("s19_jdbc", "s20_sql_documents"):
    print("rows", name, sinks.QUERIES[name](spark, {SF!r}).count(), flush=True)
""")
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(sys.modules["pyspark"].__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    rows = [x.split() for x in done.stdout.splitlines() if x.startswith("rows")]
    assert [x[1] for x in rows] == ["s19_jdbc", "s20_sql_documents"] and all(int(x[2]) > 0 for x in rows)


def test_rows_of_a_database(spark, tmp_path):
    """Nulls, wide numbers and texts come back; each task notes its part; an empty table gives no rows."""
    import sqlite3

    path = str(tmp_path / "x.db")
    connect = lambda: sqlite3.connect(path, timeout=60, isolation_level=None)
    rows = [(i if i % 5 else None, (1 << 60) + i, i / 7 if i % 3 else None, f"é'\"\n{i}" if i % 4 else None) for i in range(1000)]
    df, schema = spark.createDataFrame(rows, "a int, b long, c double, d string").repartition(6), "a int, b long, c double, d string"
    assert sinks.write_rows(df, connect, "t", "a INTEGER, b INTEGER, c REAL, d TEXT") == 1000
    back = sinks.read_rows(spark, connect, "t", "rowid", schema, rows=90)
    assert back.rdd.getNumPartitions() == 12 and sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    assert sinks.read_rows(spark, connect, "t", "b", "b long", "a IS NULL").count() == 200
    con = connect()
    assert [r[0] for r in con.execute("SELECT part FROM t_parts ORDER BY part")] == list(range(6))
    con.execute("CREATE TABLE u AS SELECT * FROM t WHERE FALSE")
    con.close()
    assert sinks.read_rows(spark, connect, "u", "rowid", schema).count() == 0


def test_jdbc_there_and_back(spark):
    """Within one process, in parts, with a null in the column that parts are told by."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true"
    rows = [(i if i else None, f"x{i}") for i in range(50)]
    sinks.write_jdbc(spark.createDataFrame(rows, "K long, V string"), url, "t", createTableColumnTypes="V VARCHAR(8)")
    back = sinks.read_jdbc(spark, url, "t", "K")
    assert back.rdd.getNumPartitions() == 8 and sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    found = sinks.sql_documents(spark, url, "SELECT COUNT(*) AS N FROM t").select("page_content").collect()
    assert [r["page_content"] for r in found] == ['{"n":50}']
