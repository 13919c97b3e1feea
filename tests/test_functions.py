"""Parsers and scalar expressions against hand-made texts, another implementation, and their laws."""

import difflib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import arith, diffs, hdl_text, scalars
from quarry.operators import facts, graphs, records, rules
from quarry.sources import scan

SOURCE = """// module demo
`include "h.vh"
import p::*, q::x;
module fifo #(parameter W = 8, parameter N = "a // b") (
  input clk, input [7:0] a, b,
  output reg [W-1:0] q,
  bus.master m
);
  /* module ghost (x);
  */ wire w1, w2; // wire w3;
  ram #(.D(4)) u_ram (.a(a), .b(b));
  sub u1 (a, b);
  always @(posedge clk or negedge rst) begin
    if (a) q = 1;
    else case (b) 1: q <= 2; endcase
  end
endmodule
module tb;
endmodule
interface ifc (input c); logic v; modport m (input a, b, output d); endinterface
package p; typedef enum {A, B = 2} t; localparam Z = 1; endpackage
"""


def test_facts_of_ordinary_text():
    rows = list(hdl_text.facts(SOURCE))
    of = lambda k: [(r[1], r[3]) for r in rows if r[0] == k]
    assert of("module") == [("fifo", 4), ("tb", 18)] and of("interface") == [("ifc", 20)] and of("package") == [("p", 21)]
    assert of("instance") == [("u_ram", 11), ("u1", 12)] and of("include") == [("h.vh", 2)] and sorted(of("import")) == [("p", 3), ("q", 3)]
    assert [(r[1], r[4]) for r in rows if r[0] == "port"] == [("a", "input"), ("b", "input"), ("clk", "input"), ("q", "output"), ("m", "interface"), ("c", "input")]
    assert sorted(n for n, _ in of("signal")) == ["v", "w1", "w2"] and [r[5] for r in rows if r[0] == "enum"] == ["A,B"]
    block = next(r for r in rows if r[0] == "block")
    assert block[3] == 13 and block[5] == "clk,rst" and block[6] == 3
    assert block[10:] == (0, 1, 1, 1)
    assert [r[0] for r in hdl_text.facts(None)] == ["scope"] and [r[0] for r in hdl_text.facts("")] == ["scope"]
    assert next(r for r in hdl_text.facts("a\r\n/* x\r\n */ b") if r[0] == "scope")[6:10] == (1, 0, 2, 0)


@given(st.text(alphabet='/*"\n ab', max_size=60))
@settings(max_examples=200, deadline=None)
def test_blanked_comments_keep_lines(text):
    one, two = hdl_text.masked(text)
    assert len(one) == len(two) == len(text) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(one) if c == "\n"]
    assert hdl_text.masked(one)[0] == one


lines = st.lists(st.sampled_from(["a", "b", "cc", "", "-x", "+y", "@@"]), max_size=12)


@given(lines, lines)
@settings(max_examples=300, deadline=None)
def test_applying_a_difference_gives_the_other(a, b):
    a, b = a or ["a"], b or ["b"]
    for n in (0, 1, 3):
        d = "\n".join(difflib.unified_diff(a, b, "f", "f", lineterm="", n=n))
        assert diffs.apply("\n".join(a), diffs.hunks(d)) == "\n".join(b)


def test_dialects_of_patches():
    normal = "2c2\n< b\n---\n> x\n4a5\n> y"
    assert diffs.format_of(normal) == "normal" and diffs.apply("a\nb\nc\nd", diffs.hunks(normal)) == "a\nx\nc\nd\ny"
    context = "*** f\n--- f\n***************\n*** 1,3 ****\n  a\n! b\n  c\n--- 1,3 ----\n  a\n! x\n  c"
    assert diffs.apply("a\nb\nc", diffs.hunks(context)) == "a\nx\nc"
    combined = diffs.hunks("@@@ -1,2 -1,2 +1,3 @@@\n  a\n +b\n++c")
    assert combined[0].added == ["b", "c"] and diffs.format_of("nothing") == "unknown" and diffs.hunks(None) == []
    assert diffs.apply("a\nb", diffs.hunks("@@ -1,1 +1,1 @@\n-z\n+y")) is None
    assert [(p, k) for p, k, _ in diffs.files("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/y b/y\n--- a/y\n+++ b/y")] == [("x", "git"), ("y", "git")]
    assert diffs.balanced('a("(")') and not diffs.balanced("(]") and "".join(t for _, t in diffs.chunks("module a;\nendmodule\n" * 50, 100)) == "module a;\nendmodule\n" * 50
    assert diffs.brace_chunks("{\n}\n{\n\n}\n", 2) == [(1, 2), (3, 5), (6, 6)]


def test_constants():
    assert [arith.evaluate(x) for x in ("8", "4'b1010", "8'hFF + 1", "(1 + 2) * 3", "1 << 4 | 1", "2 ** 5", "-3", "~0", "7 / 2", "7 % 4")] == [8, 10, 256, 9, 17, 32, -3, -1, 3, 3]
    assert all(arith.evaluate(x) is None for x in (None, "", "W", "1 +", "(1", "1 / 0", "4'bx", "__import__('os')", "2 ** 99999999"))


def test_scalars(spark):
    x = spark.createDataFrame([("rtl/a.b.sv", " NaN ", "1net-x", "logic [7:0]", "123e4567-e89b-12d3-a456-426614174000", 85.0)], "path string, t string, n string, w string, u string, s double")
    r = x.select(scalars.module_key(F.col("path")), scalars.safe_text(F.col("t")), scalars.node_name(F.col("n")), scalars.bit_width(F.col("w")), scalars.is_uuid(F.col("u")), scalars.grade(F.col("s")), scalars.cost(F.lit(1000), F.lit(10), F.lit(3), F.lit(15)), scalars.without_ansi(F.lit("\x1b[31mred")), scalars.truncated(F.lit("abcdef"), 3)).first()
    assert tuple(r) == ("rtl.a.b", "", "n1net_x", 8, True, "B", 0.00315, "red", "abc...")
    a, b = (spark.createDataFrame([row], "b string, a string" if i else "a string, b string").select(scalars.record_id(["a", "b"])).first()[0] for i, row in enumerate((("1", "2"), ("2", "1"))))
    assert a == b


def test_scan_of_a_tree(spark, tmp_path):
    for name, text in {"rtl/a.v": b"module a;\r\nendmodule \xff", "rtl/b.txt": b"x", "build/c.v": b"module c; endmodule", "tb/D_TB.sv": b"module d; endmodule", "e.v": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    got = {r["path"]: r["source"] for r in scan.tree(spark, str(tmp_path), globs=("*_tb.sv",)).collect()}
    assert got == {"rtl/a.v": "module a;\nendmodule "}
    assert [r["path"] for r in scan.tree(spark, str(tmp_path), globs=(), most=1).collect()] == ["rtl/a.v"]
    assert [r["path"] for r in scan.tree(spark, str(tmp_path / "tb/D_TB.sv")).collect()] == ["D_TB.sv"]


def test_rules_of_hand_made_text(spark):
    text = "always @(posedge clk) begin q = a; end\nalways @* begin x <= 1; end\nassign a = b & c; assign b = a;\nassign o = e ? d : 1'bz;\ncase (s) 1: y = 2; endcase"
    files = spark.createDataFrame([(1, "a.v", "module m;\n" + text + "\nendmodule"), (2, "b.v", None), (3, "c.v", "")], "file_id long, path string, source string")
    assert {r["rule"] for r in rules.quality(files, facts.extract(files)).collect()} >= {"HDL001", "HDL002", "HDL008"}
    assert {r["rule"] for r in rules.violations(files, rules.SAFETY).collect()} >= {"HDL-DRC-001", "HDL-DRC-009"}
    assert {r["severity"] for r in rules.by_line(files, rules.LINT, True).collect()} >= {"critical", "medium"}


def test_walks_end_on_cycles_and_long_chains(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(12)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "z"), ("n005", "x")]
    e = spark.createDataFrame(chain, "parent string, child string")
    start = spark.createDataFrame([("n000",)], "name string")
    assert {r["name"]: r["depth"] for r in graphs.depths(e, start).collect()}["n012"] == 12
    assert graphs.reached(e, start).count() == 16
    assert sorted(">".join(r["cycle"]) for r in graphs.cycles(e).collect()) == ["x>y>z", "z"]
    assert sorted(r["name"] for r in graphs.on_cycles(graphs.components(e)).collect()) == ["x", "y", "z"]


def test_analyzers_are_registered(spark):
    files = spark.createDataFrame([(1, "a.v", "x")], "file_id long, path string, source string")
    records.analyzer("mine")(lambda f: f.select("file_id", F.lit("M1").alias("rule"), F.lit("low").alias("severity")))
    assert [tuple(r) for r in records.analyze(files, ["mine"]).collect()] == [("mine", 1, "M1", "low")]
    del records.ANALYZERS["mine"]
    assert records.analyze(files, []).count() == 0


def test_patches_of_several_files(spark):
    """Each dialect's parts, names with blanks, and pairs of names that belong to the header before them."""
    from quarry.operators import patches

    texts = [
        "=== //d/x y.v - x y.v\n@@ -1 +1 @@\n-a\n+b\n==== //d/no - no ====\n c\n=== q — r\n@@ -2 +2 @@",
        "==== //d/z.v#3 - z w.v ====\nbody\n=== not - here\n",
        "diff --git a/p q.v b/p q.v\nnew file mode 1\n--- /dev/null\n+++ b/p q.v\n@@ -0,0 +1 @@\n+x\n--- a/inner\n+++ b/inner\nend\ndiff --git a/e b/e\nindex 1\n",
        "--- a/one\n+++ b/one\n@@ -1 +1 @@\n--- gone\n+here\ndiff -ru a/two b/two\n--- a/two\n+++ b/second\n@@ -1 +1 @@\n",
        "no header\n@@ -1 +1 @@", "", None, "diff\n--- alone\nx",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "patch_id long, patch string")
    got = sorted((r["patch_id"], r["dialect"], r["server"], r["local"], r["body"]) for r in patches.entries(df).collect())
    assert got == [
        (0, "triple", "//d/x y.v", "x y.v", "@@ -1 +1 @@\n-a\n+b\n==== //d/no - no ====\n c"), (0, "triple", "q", "r", "@@ -2 +2 @@"),
        (1, "quad", "//d/z.v#3", "z w.v", "body\n=== not - here"),
        (2, "git", "p q.v", "p q.v", "@@ -0,0 +1 @@\n+x\n--- a/inner\n+++ b/inner\nend"),
        (3, "plain", "a/two", "second", "@@ -1 +1 @@"), (3, "unified", "one", "one", "@@ -1 +1 @@\n--- gone\n+here"),
    ]
