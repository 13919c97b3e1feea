"""Substring and glob joins against all pairs, with every sign that patterns use."""

import fnmatch

import numpy as np

from quarry.operators import matching, records


def test_joins_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    letters = list("ab/[].*+?(x")
    texts = ["".join(rng.choice(letters, rng.integers(0, 9))) for _ in range(150)] + ["", "rtl/[a].v", "a+b(c).v", "rtl/a.v"]
    parts = ["".join(rng.choice(letters, rng.integers(0, 4))) for _ in range(60)] + ["", "zzz"]
    globs = ["".join(rng.choice(list("ab/*?[]!.x+("), rng.integers(0, 6))) for _ in range(80)] + ["*", "", "rtl/[*.v", "rtl/[[]a].v", "*.v", "a+b(?).v", "[!r]*"]
    t = spark.createDataFrame([(x,) for x in texts] + [(None,)], "text string")
    got = matching.contained(t, spark.createDataFrame([(x,) for x in parts] + [(None,)], "needle string"))
    assert sorted(map(tuple, got.collect())) == sorted({(a, b) for a in texts for b in parts if b in a})
    plan = got._jdf.queryExecution().executedPlan().toString()
    got = matching.fitting(t, spark.createDataFrame([(x,) for x in globs] + [(None,)], "glob string"))
    assert sorted(map(tuple, got.collect())) == sorted({(a, g) for a in texts for g in globs if fnmatch.fnmatchcase(a, g)})
    assert "NestedLoop" not in plan + got._jdf.queryExecution().executedPlan().toString()


def test_rules_apply_by_ordinary_patterns(spark):
    issues = spark.createDataFrame([(1, "HDL_C10_x", "rtl/[a.v"), (2, "other", "rtl/a+(b).v"), (3, "thing", "x.v")], "issue_id long, issue_type string, path string")
    rules = spark.createDataFrame([("c10", "about thing", "rtl/[*.v"), ("r2", None, "rtl/a+(?).v"), ("r3", "no words", None)], "rule_id string, description string, pattern string")
    got = records.applicable(issues, rules)
    assert sorted(map(tuple, got.collect())) == [(1, "c10"), (2, "r2"), (3, "c10")]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
