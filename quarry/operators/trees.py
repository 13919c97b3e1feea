"""Syntax trees that tools write as XML, as rows: a node's entry, exit and depth, and metrics of modules.

A text becomes its tags in order. An opening tag adds one to the depth, a closing
one takes it away, so depth is a running sum; at one depth openings and closings
take turns, so a node's exit is the next tag there. How many nodes of a kind
enclose a node is a running sum as well, of that kind's tags alone: no walk, no
join of nodes with their ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Element names by role.
ALWAYS = ("always", "alwaysff", "alwayscomb")
DECISIONS = ("if", "case", "caseitem", "while", "for")
NESTING = ("begin", "if", "else", "for", "while", "case")
EXPRESSIONS = ("add", "sub", "mult", "div", "and", "or", "xor", "not", "eq", "ne", "lt", "le", "gt", "ge", "concat", "replicate")
OPERATORS = (*EXPRESSIONS, "mod", "pow", "nand", "nor", "xnor", "lshift", "rshift", "ternary", "reduce_and", "reduce_or", "reduce_xor")
PORTS = ("input", "output", "inout")

_SKIP = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>"
_TAG = r"""<(/?[A-Za-z_][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*/?)>"""


def tags(files: DataFrame, xml: str = "xml") -> DataFrame:
    """(file_id, at, tag, attributes, step): a text's tags in order; step is 1 for an opening, -1 for a closing one. An empty element is both."""
    found = files.select("file_id", F.posexplode(F.regexp_extract_all(F.regexp_replace(xml, _SKIP, ""), F.lit(_TAG), F.lit(1))).alias("i", "body"))
    name = F.regexp_extract("body", r"^/?([\w:.-]+)", 1)
    steps = F.when(F.col("body").startswith("/"), F.array(F.lit(-1))).when(F.col("body").endswith("/"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    each = found.select("file_id", "i", name.alias("tag"), F.regexp_extract("body", r"^[\w:.-]+\s*(.*?)\s*/?$", 1).alias("attributes"), F.posexplode(steps).alias("j", "step"))
    return each.select("file_id", (2 * F.col("i") + F.col("j")).alias("at"), "tag", "attributes", "step")


def _broken(files: DataFrame, xml: str) -> Column:
    """Angle brackets outside tags, or several roots: no tree. What opens and closes is held together by ``nodes``."""
    bare = F.regexp_replace(F.regexp_replace(xml, _SKIP, ""), _TAG, "")
    return bare.rlike("[<>]")


def nodes(files: DataFrame, xml: str = "xml") -> DataFrame:
    """(file_id, entry, exit, depth, tag, attributes, and one column for each count of ancestors) of well-formed texts.

    depth is 1 at the root. A text whose tags do not close in order has no rows,
    as a null or an empty one. ``n_netlists`` and ``n_modules`` count the second and
    third level's openings so far; ``in_always``, ``in_nesting``, ``in_expression`` and
    ``in_assign`` the nodes of these kinds that enclose this one.
    """
    ok = files.where(F.col(xml).isNotNull() & ~_broken(files, xml))
    by = Window.partitionBy("file_id").orderBy("at")
    t = tags(ok, xml)
    level = F.sum("step").over(by) + F.when(F.col("step") < 0, 1).otherwise(0)
    t = t.withColumn("depth", level.cast("int"))
    same = Window.partitionBy("file_id", "depth").orderBy("at")
    t = t.withColumns({"exit": F.lead("at").over(same), "closes": F.lead("tag").over(same), "next_step": F.lead("step").over(same)})
    opens = F.col("step") > 0
    wrong = (F.col("depth") < 1) | (opens & ((F.coalesce("closes", F.lit("")) != F.col("tag")) | (F.coalesce("next_step", F.lit(1)) != -1)))
    several = F.count(F.when(opens & (F.col("depth") == 1), 1)).over(Window.partitionBy("file_id")) > 1
    t = t.withColumn("bad", F.max(wrong.cast("int")).over(Window.partitionBy("file_id"))).withColumn("several", several).where("bad = 0 and not several")

    def enclosing(names: tuple[str, ...], tag: Column) -> Column:
        """Nodes of these names that are open at a tag, itself left out."""
        return (F.sum(F.when(tag.isin(*names), F.col("step")).otherwise(0)).over(by) - F.when(opens & tag.isin(*names), 1).otherwise(0)).cast("int")

    low = F.lower("tag")
    count = lambda cond: F.sum(F.when(opens & cond, 1).otherwise(0)).over(by)
    t = t.withColumns({
        "n_netlists": count((F.col("depth") == 2) & (F.col("tag") == "netlist")), "n_modules": count((F.col("depth") == 3) & (F.col("tag") == "module")),
        "in_always": enclosing(ALWAYS, F.col("tag")), "in_nesting": enclosing(NESTING, low), "in_expression": enclosing(EXPRESSIONS, low), "in_assign": enclosing(("assign",), F.col("tag")),
    })
    return t.where(opens).drop("step", "closes", "next_step", "bad", "several").withColumnRenamed("at", "entry")


def attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("attributes", rf"""(?:^|\s){name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def module_metrics(files: DataFrame, xml: str = "xml") -> DataFrame:
    """(file_id, module, long_name, counts and depths) of the modules in the first netlist of each tree.

    Complexity is one and the decisions inside procedural blocks, once for each
    block that encloses them; nesting counts structural nodes since the outermost
    block's beginning, expression depth operators since that of the outermost
    assignment; a node itself does not add to its own depth.
    """
    n = nodes(files, xml).where("n_netlists = 1 and n_modules > 0")
    inside = n.where((F.col("depth") > 3) | ((F.col("depth") == 3) & (F.col("tag") == "module")))
    # The module that a node lies in is the last one opened; what follows it on its own level is outside.
    by = Window.partitionBy("file_id", "n_modules").orderBy("entry")
    module_exit = F.first("exit").over(by)
    inside = inside.withColumn("module_exit", module_exit).where(F.col("entry") < F.col("module_exit"))
    outer = lambda kind, base: F.last(F.when(kind, F.col(base)), ignorenulls=True).over(by)
    in_block, in_assign = (F.col("in_always") > 0) | F.col("tag").isin(*ALWAYS), (F.col("in_assign") > 0) | (F.col("tag") == "assign")
    inside = inside.withColumns({
        "block_base": outer((F.col("in_always") == 0) & F.col("tag").isin(*ALWAYS), "in_nesting"),
        "assign_base": outer((F.col("in_assign") == 0) & (F.col("tag") == "assign"), "in_expression"),
    })
    head, rest = F.col("depth") == 3, F.col("depth") > 3
    number = lambda cond: F.count(F.when(cond, 1)).cast("int")
    tag = F.col("tag")
    return inside.groupBy("file_id", "n_modules").agg(
        F.max(F.when(head, F.coalesce(attribute("name"), F.lit("unknown")))).alias("module"), F.max(F.when(head, F.coalesce(attribute("origName"), attribute("name"), F.lit("unknown")))).alias("long_name"),
        (1 + F.sum(F.when(tag.isin(*DECISIONS), F.col("in_always")).otherwise(0))).cast("int").alias("cc"),
        F.coalesce(F.max(F.when(in_block, F.col("in_nesting") - F.col("block_base"))), F.lit(0)).alias("nesting"),
        F.coalesce(F.max(F.when(in_assign, F.col("in_expression") - F.col("assign_base"))), F.lit(0)).alias("expression_depth"),
        number(F.lower("tag").isin(*OPERATORS)).alias("operators"), number(rest).alias("tokens"),
        number(rest & (tag == "var")).alias("signals"), number(rest & (tag == "var") & attribute("dir").isin(*PORTS)).alias("ports"),
        number(rest & (tag == "always")).alias("always"), number(rest & (tag == "alwaysff")).alias("always_ff"), number(rest & (tag == "alwayscomb")).alias("always_comb"), number(rest & (tag == "instance")).alias("instances"),
    ).drop("n_modules")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, xml): XML files whole, by their path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("xml"))


def read_modules(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, orig_name) of the module elements of XML files, through Spark's reader: large files split by element."""
    rows = spark.read.format("xml").option("rowTag", "module").schema("_name string, _origName string").load(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_name").alias("name"), F.coalesce("_origName", "_name").alias("orig_name"))


_EVENT = r'kModuleHeader|kInstantiationType|kGateInstance|SymbolIdentifier\s*@\d+:\d+-\d+:\d+\s*"\w+"'


def printed(files: DataFrame, tree: str = "tree") -> DataFrame:
    """(file_id, kind, name, type, line) of modules and instances in printed parse trees.

    The first symbol after a module's header is its name, that after an
    instantiation's type names the type, and that after a gate instance names the
    instance, whose type is the last one before.
    """
    each = files.select("file_id", F.posexplode(F.regexp_extract_all(tree, F.lit(_EVENT), F.lit(0))).alias("at", "event"))
    by = Window.partitionBy("file_id").orderBy("at")
    name, line = F.regexp_extract("event", r'"(\w+)"$', 1), F.regexp_extract("event", r"@(\d+):", 1).try_cast("int")
    each = each.withColumns({"before": F.lag("event").over(by), "name": F.nullif(name, F.lit("")), "line": line})
    own_type = F.when((F.col("before") == "kInstantiationType") & F.col("name").isNotNull(), F.struct("name", "line"))
    each = each.withColumn("last_type", F.last(own_type, ignorenulls=True).over(by)).where("name is not null")
    kind = F.when(F.col("before") == "kModuleHeader", "module").when((F.col("before") == "kGateInstance") & F.col("last_type").isNotNull(), "instance")
    instance = F.col("kind") == "instance"
    found = each.withColumn("kind", kind).where("kind is not null")
    return found.select("file_id", "kind", "name", F.when(instance, F.col("last_type.name")).alias("type"), F.when(instance, F.col("last_type.line")).otherwise(F.col("line")).alias("line"))


def made_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, tree): printed trees made from the rows of part, with k % 3 instances of one type."""
    k = F.col("p_partkey")
    text = lambda *x: F.concat(*[v.cast("string") if isinstance(v, Column) else F.lit(v) for v in x])
    symbol = lambda line, name: text("      SymbolIdentifier @", line, ':3-9:12 "', name, '"\n')
    one = text(" kInstantiationType {\n", symbol(k + 5, text("t", k)), " kGateInstance {\n", symbol(k + 6, text("u", k)), symbol(k + 7, F.lit("port")))
    body = text("kModuleDeclaration {\n  kModuleHeader {\n", symbol(k, text("m", k)), symbol(k + 1, F.lit("clk")), F.repeat(one, (k % 3).cast("int")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("file_id"), F.when(k % 5 == 4, F.lit("")).otherwise(body).alias("tree"))


def made_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, xml): trees made from the rows of part; every one of 17 does not close in order."""
    k = F.col("p_partkey")
    n = lambda m: (k % m).cast("int")
    text = lambda *x: F.concat(*[v.cast("string") if isinstance(v, Column) else F.lit(v) for v in x])
    deep = text(F.repeat(F.lit("<begin><if>"), n(4)), '<assigndly><varref name="a"/></assigndly>', F.repeat(F.lit("</if></begin>"), n(4)))
    expression = text(F.repeat(F.lit("<add><Not>"), n(3)), '<const name="1"/>', F.repeat(F.lit("</Not></add>"), n(3)), "<shift/>")
    first = text(
        '<module name="m', k, '" origName="top', k, '">', F.repeat(F.lit('<var name="p" dir="input"/>'), n(5)), '<var name="w"/><!-- <if> -->', "<alwaysff>", deep, "</alwaysff>",
        F.repeat(F.lit("<always><case><caseitem/><caseitem/></case><always><while></while></always></always>"), n(2)), "<if><alwayscomb><begin/></alwayscomb></if>", "<assign>", expression, "</assign>", F.repeat(F.lit("<instance name='u'/>"), n(6)), "</module>",
    )
    second = F.when(k % 3 == 0, text('<module name="x', k, '"><assign><xor><eq><sel/></eq></xor></assign></module>')).otherwise("")
    end = F.when(k % 17 == 0, "</root></netlist>").otherwise("</netlist><netlist><module name='late'/></netlist></root>")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("file_id"), text('<?xml version="1.0"?>\n<root><files><module name="no"/></files><netlist>', first, second, end).alias("xml"))


QUERIES = {
    "g13_tree_metrics": lambda s, d: module_metrics(made_trees(s, d)),
    "s23_xml_modules": lambda s, d: nodes(made_trees(s, d)).where("tag = 'module'").select("file_id", attribute("name").alias("module"), "depth"),
    "s23_printed_trees": lambda s, d: printed(made_prints(s, d)),
}
_K = "part WHERE p_partkey % 17 <> 0"
ORACLE = {
    "g13_tree_metrics": f"""
        SELECT p_partkey AS file_id, 'm' || p_partkey AS module, 'top' || p_partkey AS long_name, 1 + p_partkey % 4 + CASE WHEN p_partkey % 2 = 1 THEN 3 + 2 ELSE 0 END AS cc,
          greatest(2 * (p_partkey % 4), p_partkey % 2) AS nesting, 2 * (p_partkey % 3) AS expression_depth, 2 * (p_partkey % 3) AS operators,
          p_partkey % 5 + 1 + 1 + 2 * (p_partkey % 4) + 2 + 6 * (p_partkey % 2) + 3 + 1 + 2 * (p_partkey % 3) + 2 + p_partkey % 6 AS tokens, p_partkey % 5 + 1 AS signals, p_partkey % 5 AS ports,
          2 * (p_partkey % 2) AS always, 1 AS always_ff, 1 AS always_comb, p_partkey % 6 AS instances FROM {_K}
        UNION ALL SELECT p_partkey, 'x' || p_partkey, 'x' || p_partkey, 1, 0, 2, 2, 4, 0, 0, 0, 0, 0, 0 FROM {_K} AND p_partkey % 3 = 0""",
    "s23_xml_modules": f"SELECT p_partkey AS file_id, u.n AS module, 3 AS depth FROM {_K.split(' WHERE')[0]}, (VALUES ('no'), ('late'), ('m' || p_partkey), (CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey END)) u(n) WHERE p_partkey % 17 <> 0 AND u.n IS NOT NULL",
    "s23_printed_trees": "SELECT p_partkey AS file_id, 'module' AS kind, 'm' || p_partkey AS name, NULL AS type, p_partkey::INT AS line FROM part WHERE p_partkey % 5 <> 4 UNION ALL SELECT p_partkey, 'instance', 'u' || p_partkey, 't' || p_partkey, (p_partkey + 5)::INT FROM part, range(2) r(i) WHERE p_partkey % 5 <> 4 AND r.i < p_partkey % 3",
}
