import fnmatch

import pytest
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.sources import ndjson
from quarry.streaming import telemetry


@pytest.mark.parametrize("glob", ["*_tb.sv", "a/*", "m?.v", "x[0-9].v", "x[!0-9].v", "a+b(c).v", "[x", "*", ""])
def test_globs(spark, glob):
    names = ["m_tb.sv", "a/b/c", "m1.v", "x3.v", "xy.v", "a+b(c).v", "[x", "", "m12.v", "aab(c)xv"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select(paths.excluded(F.col("p"), (), [glob]).alias("x")).collect()
    assert [r["x"] for r in got] == [fnmatch.fnmatchcase(n, glob) for n in names]


def test_records_and_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"k": 1},\n {"k": 2}, 5]')
    (tmp_path / "in" / "b.json").write_text('{"k": 3}\n\nbroken\n[9]\n{"k": 4}\n')
    got = ndjson.read_records(spark, str(tmp_path / "in")).select(F.expr("variant_get(record, '$.k', 'int')").alias("k"))
    assert sorted(r["k"] for r in got.collect()) == [1, 2, 3, 4]
    assert ndjson.write_ndjson(got, str(tmp_path / "out"), F.col("k") > 1) == {"total": 4, "written": 3, "skipped": 1}
    assert ndjson.read_ndjson(spark, str(tmp_path / "out")).count() == 3


def test_rollup_runs_again_without_counting_twice(spark, tmp_path):
    rows = "event_id long, ts timestamp, event_type string, value double"
    import datetime

    at = datetime.datetime(2024, 1, 1, 12)
    for part in (1, 2):
        spark.createDataFrame([(10 * part + i, at, "view", float(i)) for i in range(3)], rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        for _ in range(2):
            telemetry.rollup(telemetry.event_stream(spark, str(tmp_path / "events")), str(tmp_path / "roll"))
        got = telemetry.report(spark, str(tmp_path / "roll")).collect()
        assert [(r["n"], r["last_event"]) for r in got] == [(3 * part, 10 * part + 2)]


def test_what_a_scan_passes_over_is_never_opened(spark, tmp_path):
    """A file too large for any row lies in a pruned folder and under a suffix that is not asked for; names with blanks and signs come back as they are."""
    from quarry.sources import scan

    top = tmp_path / "a b"
    for name, text in (("rtl/m+1 %41.sv", "module m;\r\nendmodule"), ("z.v", b"\xff ok"), ("rtl/e.sv", "e"), ("rtl/skip_tb.sv", "x"), ("build/y.sv", "x"), ("n.md", "x")):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    for name in (".git/huge.sv", "huge.bin", "build/huge.v"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        with open(top / name, "wb") as f:
            f.truncate(3 << 30)
    got = scan.tree(spark, str(top), globs=("*_tb.sv",))
    assert sorted(map(tuple, got.collect())) == [("rtl/e.sv", "e", 1), ("rtl/m+1 %41.sv", "module m;\nendmodule", 20), ("z.v", " ok", 4)]
    assert sorted(r["path"] for r in scan.names(spark, str(top), (), ()).collect()) == sorted(["rtl/m+1 %41.sv", "z.v", "rtl/e.sv", "rtl/skip_tb.sv", "build/y.sv", "n.md", "huge.bin", "build/huge.v"])
    assert [r["path"] for r in scan.tree(spark, str(top), most=2).orderBy("path").collect()] == ["rtl/e.sv", "rtl/m+1 %41.sv"]
    assert scan.tree(spark, str(top), most=0).count() == 0
    assert [r["path"] for r in scan.tree(spark, str(top / "z.v")).collect()] == ["z.v"]
    cached = spark.createDataFrame([("z.v", 1), ("gone.v", 2), ("rtl", 3), ("rtl/e.sv", 4)], "path string, digest int")
    assert sorted(r["path"] for r in scan.regular(cached, spark, str(top)).collect()) == ["rtl/e.sv", "z.v"]
