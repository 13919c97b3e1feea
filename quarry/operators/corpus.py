"""A design made from the rows of ``part``: sources with known facts, for queries and tests.

A part's number k tells what its file holds: 0 to 3 modulo 8 a module, 4 a
header, 5 a package, 6 an interface, 7 a testbench. ``FACTS`` says in SQL, by
arithmetic on the same rows, what an extractor has to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".v", ".sv", ".vh", ".svh")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def design(part: DataFrame) -> DataFrame:
    """(file_id, path, source)."""
    k = F.col("p_partkey")
    base = F.floor(k / 8) * 8
    when = lambda c, a, b: F.when(c, a if isinstance(a, Column) else F.lit(a)).otherwise(b if isinstance(b, Column) else F.lit(b))
    rtl = [
        when(k % 3 == 0, _text("// module m", k, ": description"), "// note"),
        when(k % 5 < 4, _text('`include "h', base + 4, '.vh"'), _text('`include "missing', k, '.vh"')),
        when(k % 13 == 0, _text("import lost", k, "::*;"), when(k % 2 == 0, _text("import p", base + 5, "::*;"), "import uvm_pkg::*;")),
        _text("module m", k, ' #(parameter W = 8, parameter NAME = "x") ('),
        F.lit("  input clk, input rst_n,"),
        F.lit("  input [7:0] a,"),
        F.lit("  output reg [W-1:0] q"),
        F.lit(");"),
        F.lit("  wire [3:0] w1;"),
        F.lit("  reg r1;"),
        F.lit("  /* block"),
        _text("     m", k, "_fake u (.x(y));"),
        F.lit("  */"),
        _text("  m", 2 * k, when(k % 7 == 0, " #(.W(\"z\"))", " #(.W(16))"), " u_left (.clk(clk), .a(a));"),
        _text("  m", when(k % 24 == 8, F.floor(k / 2), 2 * k + 1), " u_right (clk);"),
        when(k % 11 == 0, "  always @(posedge clk or negedge rst_n) begin", "  always @(posedge clk) begin"),
        when(k % 4 == 0, "\tif (rst_n) q <= a; // TODO tidy", "    if (rst_n && a) q <= a;"),
        F.lit("    else begin"),
        F.lit("      case (a)"),
        when(k % 9 == 0, "        8'd1: q = 1;", "        8'd1: q <= 1;"),
        when(k % 3 == 1, "        8'd2: q <= 2;", "        default: q <= 0;"),
        F.lit("      endcase"),
        F.lit("    end"),
        F.lit("  end"),
        F.lit("  assign w1 = a[3:0];"),
        when(k % 6 == 0, "  assign w1 = 4'b0;  ", ""),
        F.lit("  generate"),
        F.lit("    for (genvar i = 0; i < 4; i = i + 1) begin : g_loop"),
        _text("      sub", k % 7, " u_gen (.i(i));"),
        F.lit("    end"),
        F.lit("  endgenerate"),
        _text("  function integer f", k, "(input integer x);"),
        when(k % 10 == 0, _text("    // ", F.repeat(F.lit("x"), 130)), "    // short"),
        F.lit("  endfunction"),
        F.lit("endmodule"),
    ]
    header = [
        when(k % 16 == 4, "`ifndef GUARD", ""), when(k % 16 == 4, "`define GUARD", ""), _text("`define WIDTH", k, " 8"), _text("`define LONG", k, " (1 + \\\n  2)"),
        _text('`include "h', when(k % 24 == 12, k - 8, k + 8), '.vh"'), when(k % 16 == 4, "`endif", ""),
    ]
    package = [
        _text("package p", k, ";"), F.lit("  parameter DEPTH = 4;"), F.lit("  localparam MASK = 4'hF;"), F.lit("  typedef enum {IDLE, BUSY = 2} state_t;"),
        F.lit("  typedef struct packed { logic [3:0] lo; logic hi; } pair_t;"), F.lit("  typedef logic [7:0] byte_t;"), F.lit("  function int twice(input int x);"), F.lit("  endfunction"),
        when(k % 3 == 0, "  task idle;\n  endtask", ""), F.lit("endpackage"),
        F.when(k % 24 == 5, _text("module lone", k, "; endmodule")),
    ]
    interface = [_text("interface i", k, " #(parameter N = 2) (input clk);"), F.lit("  logic [N-1:0] data;"), F.lit("  logic valid;"), F.lit("  modport src (input clk, output data, valid);"), F.lit("  modport dst (input data, valid);"), F.lit("endinterface")]
    bench = [
        _text("module tb_m", base, ";"), F.lit("  reg clk;"), when(k % 5 == 2, "  wire bus;", _text("  i", base + 6, " bus (clk);")), _text("  m", base, " dut (.clk(clk));"),
        F.lit("  initial begin"), F.lit("    #5 clk = 0;"), F.lit("  end"), when(k % 16 == 7, "  assert property (clk);", ""), when(k % 24 == 7, "  covergroup cg; endgroup", ""), F.lit("endmodule"),
    ]
    kind = k % 8
    source = F.when(kind < 4, F.concat_ws("\n", *rtl)).when(kind == 4, F.concat_ws("\n", *header)).when(kind == 5, F.concat_ws("\n", *package)).when(kind == 6, F.concat_ws("\n", *interface)).otherwise(F.concat_ws("\n", *bench))
    path = F.when(kind < 4, _text("rtl/m", k, when(k % 2 == 0, ".sv", ".v"))).when(kind == 4, _text("inc/h", k, ".vh")).when(kind == 5, _text("pkg/p", k, ".sv")).when(kind == 6, _text("ifc/i", k, ".svh")).otherwise(_text("tb/m", base, "_tb.sv"))
    return part.select(k.alias("file_id"), path.alias("path"), source.alias("source"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The design's files, dealt by number: a text is some forty times as wide as the row that it is made from, so one small file of rows is many texts."""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return design(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").repartition(parts, "p_partkey"))


_R, _B = "part WHERE p_partkey % 8 < 4", "(p_partkey // 8 * 8)"
#: SQL for what the design holds, by the arithmetic above: relations that oracles build on.
FACTS = {
    "f_path": f"SELECT p_partkey AS file_id, CASE WHEN p_partkey % 8 < 4 THEN 'rtl/m' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.sv' ELSE '.v' END WHEN p_partkey % 8 = 4 THEN 'inc/h' || p_partkey || '.vh' WHEN p_partkey % 8 = 5 THEN 'pkg/p' || p_partkey || '.sv' WHEN p_partkey % 8 = 6 THEN 'ifc/i' || p_partkey || '.svh' ELSE 'tb/m' || {_B} || '_tb.sv' END AS path FROM part",
    "f_def": f"SELECT p_partkey AS file_id, 'module' AS kind, 'm' || p_partkey AS name, 4 AS line, 4 AS ports, 2 AS params, 35 AS last FROM {_R} UNION ALL SELECT p_partkey, 'package', 'p' || p_partkey, 1, 0, 0, CASE WHEN p_partkey % 3 = 0 THEN 11 ELSE 10 END FROM part WHERE p_partkey % 8 = 5 UNION ALL SELECT p_partkey, 'interface', 'i' || p_partkey, 1, 1, 1, 6 FROM part WHERE p_partkey % 8 = 6 UNION ALL SELECT p_partkey, 'module', 'tb_m' || {_B}, 1, 0, 0, 10 FROM part WHERE p_partkey % 8 = 7 UNION ALL SELECT p_partkey, 'module', 'lone' || p_partkey, 11, 0, 0, 11 FROM part WHERE p_partkey % 24 = 5",
    "f_inst": f"SELECT p_partkey AS file_id, 'm' || p_partkey AS parent, 'm' || (2 * p_partkey) AS child, 'u_left' AS instance, 14 AS line, 2 AS connections FROM {_R} UNION ALL SELECT p_partkey, 'm' || p_partkey, 'm' || (CASE WHEN p_partkey % 24 = 8 THEN p_partkey // 2 ELSE 2 * p_partkey + 1 END), 'u_right', 15, 1 FROM {_R} UNION ALL SELECT p_partkey, 'm' || p_partkey, 'sub' || (p_partkey % 7), 'u_gen', 29, 1 FROM {_R} UNION ALL SELECT p_partkey, 'tb_m' || {_B}, 'm' || {_B}, 'dut', 4, 1 FROM part WHERE p_partkey % 8 = 7 UNION ALL SELECT p_partkey, 'tb_m' || {_B}, 'i' || ({_B} + 6), 'bus', 3, 1 FROM part WHERE p_partkey % 8 = 7 AND p_partkey % 5 <> 2",
    "f_inc": f"SELECT p_partkey AS file_id, CASE WHEN p_partkey % 5 < 4 THEN 'h' || ({_B} + 4) || '.vh' ELSE 'missing' || p_partkey || '.vh' END AS target, 2 AS line FROM {_R} UNION ALL SELECT p_partkey, 'h' || (CASE WHEN p_partkey % 24 = 12 THEN p_partkey - 8 ELSE p_partkey + 8 END) || '.vh', 6 FROM part WHERE p_partkey % 8 = 4",
    "f_imp": f"SELECT p_partkey AS file_id, CASE WHEN p_partkey % 13 = 0 THEN 'lost' || p_partkey WHEN p_partkey % 2 = 0 THEN 'p' || ({_B} + 5) ELSE 'uvm_pkg' END AS package, 3 AS line FROM {_R}",
    "f_edge": "SELECT DISTINCT parent, child FROM f_inst",
    "f_mod": "SELECT name, min(file_id) AS file_id FROM f_def WHERE kind = 'module' GROUP BY name",
}
