from quarry.operators import integrity


def test_no_names_are_gathered_in_the_driver(spark):
    """Names come from texts, whose size no plan knows, so none are broadcast, however small the files look."""
    files = spark.createDataFrame([(1, "module m(inout a, inout b);\n reg [7:0] r [0:3];\n assign a = e ? d : 1'bz;\n assign q = r[4];\nendmodule"), (2, None), (3, "")], "file_id long, source string")
    found = integrity.findings(files)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "inout", "b", None), (1, "memory", "r", None), (1, "range", "r", "4 outside 0:3")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
