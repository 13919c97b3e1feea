"""Module and include graphs: degrees, reach, depth, cycles and closures over (parent, child) edges.

Walks go by frontiers: each round joins what is new with the edges and takes out
what has been seen, staged, so that rounds grow with the longest way and never
with the number of ways, and no state is on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..staging import Pile, discard, staged
from . import corpus, facts, rules

#: Edges that one task solves at once, when rounds have left no more.
FEW_EDGES = 200_000


def edges(f: DataFrame) -> DataFrame:
    """(parent, child): a module and the types it instantiates, once each."""
    return facts.instances(f).select("parent", "child").distinct()


def defined(f: DataFrame) -> DataFrame:
    """(name, file_id): module definitions; of several of one name the first file's stands."""
    return f.where("kind = 'module'").groupBy("name").agg(F.min("file_id").alias("file_id"))


def implicit(e: DataFrame, known: DataFrame) -> DataFrame:
    return e.select(F.col("child").alias("name")).distinct().join(known.select("name"), "name", "left_anti")


def degrees(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, fan_in, fan_out) of all nodes."""
    out = e.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = e.groupBy(F.col("child").alias("name")).agg(F.count(F.lit(1)).alias("fan_in"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return nodes.select("name").join(into, "name", "left").join(out, "name", "left").select("name", zero("fan_in"), zero("fan_out"))


def reached(e: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(name, steps): nodes that a walk from the start reaches, with the fewest steps; to a fixpoint unless most steps are given."""
    e = staged(e, "edges")
    seen = Pile(e.sparkSession, "name string, steps int", "seen")
    front, step = seen.add(start.select("name").distinct().withColumn("steps", F.lit(0))), 0
    while most is None or step < most:
        step += 1
        new = front.join(e, front["name"] == e["parent"]).select(F.col("child").alias("name")).distinct().join(seen.all().select("name"), "name", "left_anti")
        front = seen.add(new.withColumn("steps", F.lit(step)))
        if front.isEmpty():
            break
    return seen.all()


def trimmed(e: DataFrame) -> DataFrame:
    """The edges that are left after one round of taking away nodes without a way in or out."""
    return e.join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(e.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("parent", "child")


def chains(e: DataFrame) -> DataFrame | None:
    """(name, head, tail) of nodes with one way in and one way out: the nearest nodes before and after them that are not such.

    Pointers double their reach each round. A ring of such nodes has neither
    end: its least node is both. None if there are no such nodes.
    """
    ins = e.groupBy(F.col("child").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("before"))
    outs = e.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("m"), F.min("child").alias("after"))
    own = staged(ins.join(outs, "name").where("n = 1 and m = 1").select("name", "before", "after"), "chain-links")
    if own.isEmpty():
        return None

    def ends(pointer: str) -> DataFrame:
        """(name, least, end, open) by doubling: while the end is itself a link the walk goes on; least is the least link passed."""
        links = own.select(F.col("name").alias("end")).withColumn("open", F.lit(True))
        at = staged(own.select("name", F.col("name").alias("least"), F.col(pointer).alias("end")).join(links, "end", "left").select("name", "least", "end", F.coalesce("open", F.lit(False)).alias("open")), "chain-ends")
        size, reach = own.count(), 1
        while reach < size and not at.where("open").isEmpty():
            onward = at.select(F.col("name").alias("end"), F.col("least").alias("least2"), F.col("end").alias("end2"), F.col("open").alias("open2"))
            walked = at.where("open").join(onward, "end").select("name", F.least("least", "least2").alias("least"), F.col("end2").alias("end"), F.col("open2").alias("open"))
            more = staged(at.where("not open").unionByName(walked), "chain-ends")
            discard(at)
            at, reach = more, 2 * reach
        return at

    heads, tails = ends("before"), ends("after")
    # What is still open after as many steps as there are links walks in a ring.
    out = heads.select("name", F.when(F.col("open"), F.col("least")).otherwise(F.col("end")).alias("head")).join(tails.select("name", F.when(F.col("open"), F.col("least")).otherwise(F.col("end")).alias("tail")), "name")
    out = staged(out, "chains")
    discard(own, heads, tails)
    return out


def _with_loops(known: DataFrame, loops: DataFrame) -> DataFrame:
    single = loops.join(known.select("name"), "name", "left_anti")
    return staged(known.unionByName(single.select("name", F.col("name").alias("component"))), "components")


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of more than one node of the edges in one task, by one depth-first walk that notes how far back each node reaches."""
    ways: dict[str, list[str]] = {}
    for batch in batches:
        for a, b in zip(batch["parent"], batch["child"], strict=True):
            ways.setdefault(a, []).append(b)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    out: list[tuple[str, str]] = []
    done: set[str] = set()
    for start in ways:
        todo = [] if start in order else [(start, iter(ways[start]))]
        while todo:
            v, rest = todo[-1]
            if v not in order:
                order[v] = low[v] = len(order)
                held.append(v)
            for w in rest:
                if w not in order:
                    todo.append((w, iter(ways.get(w, ()))))
                    break
                if w not in done:
                    low[v] = min(low[v], order[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == order[v]:
                    members = [held.pop()]
                    while members[-1] != v:
                        members.append(held.pop())
                    done.update(members)
                    if len(members) > 1:
                        least = min(members)
                        out += [(x, least) for x in members]
    yield pd.DataFrame(out, columns=["name", "component"], dtype=object)


def components(e: DataFrame, small: int = FEW_EDGES) -> DataFrame:
    """(name, component) of all nodes on cycles: strongly connected components, named by their least node; staged.

    Chains are drawn together to one edge, nodes without a way in or out are
    taken away, and on what is left each node takes the greatest name that reaches it;
    those that the node of that name is reached from, within the color, are its
    component. Work goes by edges and rounds, never by pairs of nodes. Once no
    more than ``small`` edges are left, one task solves them at once.
    """
    spark = e.sparkSession
    loops = Pile(spark, "name string", "loops")
    found = Pile(spark, "name string, component string", "components")
    drawn: list[DataFrame] = []
    e = staged(e.distinct(), "component-edges")

    def replaced(new: DataFrame, old: DataFrame) -> DataFrame:
        """The new edges, without those from a node to itself, which are noted."""
        every = staged(new.distinct(), "component-edges")
        discard(old)
        if every.where("parent = child").isEmpty():
            return every
        loops.add(every.where("parent = child").select(F.col("parent").alias("name")))
        out = staged(every.where("parent <> child"), "component-edges")
        discard(every)
        return out

    e = replaced(e, e)
    while e.count() > small:
        n = -1
        while n > small or n < 0:  # chains and ends go until neither is left
            c = chains(e)
            if c is not None:
                drawn.append(c)
                rest = e.join(c.select(F.col("name").alias("parent")), "parent", "left_anti").join(c.select(F.col("name").alias("child")), "child", "left_anti")
                e = replaced(rest.select("parent", "child").unionByName(c.select(F.col("head").alias("parent"), F.col("tail").alias("child"))), e)
            before = e.count()
            e = replaced(trimmed(e), e)
            n = e.count()
            if n == before and c is None:
                break
        if n <= small:
            break
        color = _colors(e)
        roots = color.where("name = color")
        # Back from each root, within its color.
        back = e.join(color.select(F.col("name").alias("child"), F.col("color").alias("to")), "child").join(color.select(F.col("name").alias("parent"), F.col("color").alias("of")), "parent").where("to = of")
        back = staged(back.select("parent", "child", F.col("of").alias("color")), "component-back")
        mine = Pile(spark, "name string, color string", "component-members")
        front = mine.add(roots.select("name", "color"))
        while not front.isEmpty():
            new = front.select(F.col("name").alias("child"), "color").join(back, ["child", "color"]).select(F.col("parent").alias("name"), "color").distinct()
            front = mine.add(new.join(mine.all(), ["name", "color"], "left_anti"))
        members = mine.all()
        found.add(members.join(members.groupBy("color").agg(F.count(F.lit(1)).alias("size"), F.min("name").alias("component")).where("size > 1"), "color").select("name", "component"))
        done = members.select("name")
        e = replaced(e.join(done.select(F.col("name").alias("parent")), "parent", "left_anti").join(done.select(F.col("name").alias("child")), "child", "left_anti").select("parent", "child"), e)
        discard(color, back)
    if not e.isEmpty():
        found.add(e.coalesce(1).mapInPandas(_solved, "name string, component string"))
    # A node with a way to itself alone is a component, unless it was drawn into a chain that lies in one.
    looped = staged(loops.all().distinct(), "loops")
    known, later = found.all(), looped
    for c in drawn:
        later = later.join(c.select("name"), "name", "left_anti")
    known = _with_loops(known, later)
    for c in reversed(drawn):  # a chain belongs to the component that has both its ends
        ends = c.join(known.select(F.col("name").alias("head"), "component"), "head").join(known.select(F.col("name").alias("tail"), F.col("component").alias("other")), "tail")
        inside = staged(known.unionByName(ends.where("component = other").select("name", "component")), "components")
        known = _with_loops(inside, looped.join(c.select("name"), "name", "left_semi"))
        discard(inside, c)
    # Names by the least node, chains included.
    out = staged(known.join(known.groupBy("component").agg(F.min("name").alias("least")), "component").select("name", F.col("least").alias("component")), "components")
    discard(known, e)
    return out


def _colors(e: DataFrame) -> DataFrame:
    """(name, color): the greatest name among the nodes that reach a node, itself included. Only nodes whose color rose pass it on."""
    color = staged(e.select(F.col("parent").alias("name")).unionByName(e.select(F.col("child").alias("name"))).distinct().withColumn("color", F.col("name")), "colors")
    front = color
    while True:
        raised = front.join(e, front["name"] == e["parent"]).groupBy(F.col("child").alias("name")).agg(F.max("color").alias("new"))
        raised = staged(raised.join(color, "name").where("new > color").select("name", F.col("new").alias("color")), "colors-front")
        if raised.isEmpty():
            return color
        newer = staged(color.join(raised.select("name"), "name", "left_anti").unionByName(raised), "colors")
        discard(color, None if front is color else front)
        color, front = newer, raised


def on_cycles(comp: DataFrame) -> DataFrame:
    """(name): nodes that reach themselves."""
    return comp.select("name")


def within(e: DataFrame, comp: DataFrame) -> DataFrame:
    """The edges inside components."""
    both = e.join(comp.select(F.col("name").alias("parent"), F.col("component").alias("a")), "parent").join(comp.select(F.col("name").alias("child"), F.col("component").alias("b")), "child")
    return both.where("a = b").select("parent", "child").distinct()


def cycles(e: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """(cycle): every simple cycle as an array that begins with its least node; only ways inside a component are followed.

    Their number may grow beyond any bound with the size of a component; each round holds the open ways of one length.
    """
    e = staged(within(e, components(e) if comp is None else comp), "cycle-edges")
    found = Pile(e.sparkSession, "cycle array<string>", "cycles")
    paths = staged(e.where("parent <= child").select(F.array("parent").alias("path"), F.col("child").alias("at")), "paths")
    while not paths.isEmpty():
        found.add(paths.where("at = path[0]").select(F.col("path").alias("cycle")))
        grown = paths.where("at > path[0] and not array_contains(path, at)").select(F.concat("path", F.array("at")).alias("path"), "at")
        more = staged(grown.join(e, grown["at"] == e["parent"]).select("path", F.col("child").alias("at")).where("at >= path[0]"), "paths")
        discard(paths)
        paths = more
    return found.all()


def depths(e: DataFrame, roots: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """(name, depth): the longest way from a root, in edges; edges within a component are left out, so that every way ends.

    What the roots reach is peeled: a node's round is the first after that of the last of its parents, and each edge is met once.
    """
    comp = components(e) if comp is None else comp
    e = e.distinct()
    dag = staged(e.join(within(e, comp), ["parent", "child"], "left_anti"), "dag")
    met = reached(dag, roots).select("name")
    dag = staged(dag.join(met.select(F.col("name").alias("parent")), "parent", "left_semi"), "dag-reached")
    need = staged(dag.groupBy(F.col("child").alias("name")).agg(F.count(F.lit(1)).alias("need")), "dag-need")
    done = Pile(e.sparkSession, "name string, depth int", "depths")
    front, step = done.add(met.join(need, "name", "left_anti").withColumn("depth", F.lit(0))), 0
    while not front.isEmpty():
        step += 1
        child = dag.join(front.select(F.col("name").alias("parent")), "parent", "left_semi").select(F.col("child").alias("name")).distinct()
        ways = dag.join(child.select(F.col("name").alias("child")), "child", "left_semi").join(done.all().select(F.col("name").alias("parent")), "parent")
        ready = ways.groupBy(F.col("child").alias("name")).agg(F.count(F.lit(1)).alias("have")).join(need, "name").where("have = need")
        front = done.add(ready.select("name", F.lit(step).alias("depth")))
    return done.all()


def roots_of(e: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("name").join(e.select(F.col("child").alias("name")).distinct(), "name", "left_anti")


def includes(f: DataFrame, files: DataFrame, dirs: tuple[str, ...] = ("", "inc/", "rtl/")) -> DataFrame:
    """(file_id, line, target, path): include targets looked for in the folders in order; the first that exists counts, else null."""
    tried = facts.includes(f).select("file_id", "line", "target", F.posexplode(F.array(*[F.concat(F.lit(d), F.col("target")) for d in dirs])).alias("rank", "path"))
    there = files.select("path", F.lit(True).alias("there"))
    hits = tried.join(there, "path", "left").groupBy("file_id", "line", "target").agg(F.min(F.when(F.col("there"), F.struct("rank", "path"))).alias("best"))
    return hits.select("file_id", "line", "target", F.col("best.path").alias("path"))


def include_edges(f: DataFrame, files: DataFrame) -> DataFrame:
    """(parent, child) by path, of resolved includes."""
    return includes(f, files).where("path is not null").join(files.select("file_id", F.col("path").alias("parent")), "file_id").select("parent", F.col("path").alias("child")).distinct()


def include_closure(e: DataFrame, most: int | None = None) -> DataFrame:
    """(file, included, depth): what each file includes, directly or not, at its least depth, by rounds over pairs not seen yet; at most that deep, if given."""
    e = staged(e, "includes")
    seen = Pile(e.sparkSession, "file string, included string, depth int", "closure")
    front, step = seen.add(e.select(F.col("parent").alias("file"), F.col("child").alias("included"), F.lit(1).alias("depth"))), 1
    while (most is None or step < most) and not front.isEmpty():
        step += 1
        new = front.join(e, front["included"] == e["parent"]).select("file", F.col("child").alias("included")).distinct().join(seen.all().select("file", "included"), ["file", "included"], "left_anti")
        front = seen.add(new.withColumn("depth", F.lit(step)))
    return seen.all()


def bindings(f: DataFrame) -> DataFrame:
    """(file_id, module, instance, interface): instances and ports whose type is an interface that some file defines."""
    names = f.where("kind = 'interface'").select(F.col("name").alias("child")).distinct()
    return facts.instances(f).join(names, "child", "left_semi").select("file_id", F.col("parent").alias("module"), "instance", F.col("child").alias("interface"))


def collisions(f: DataFrame) -> DataFrame:
    """(qualified, file_id, previous): a name that the file before in order, another one, had given already."""
    s = facts.symbols(f).select("qualified", "file_id").distinct()
    before = F.lag("file_id").over(Window.partitionBy("qualified").orderBy("file_id"))
    return s.withColumn("previous", before).where("previous is not null and previous <> file_id")


def metrics(e: DataFrame, known: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """One row: counts and means of degrees, cycles, depth, and the graph's score."""
    nodes = staged(known.select("name").unionByName(implicit(e, known)), "nodes")
    d = degrees(e, nodes)
    s = d.agg(F.count(F.lit(1)).alias("modules"), F.sum("fan_out").alias("edges"), F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"), F.count(F.when(F.col("fan_in") > 20, 1)).alias("high_fan_in"), F.count(F.when(F.col("fan_out") > 15, 1)).alias("high_fan_out"), F.count(F.when(F.col("fan_out") == 0, 1)).alias("leaves"), F.count(F.when(F.col("fan_in") == 0, 1)).alias("roots"))
    comp = components(e) if comp is None else comp
    c = on_cycles(comp).agg(F.count(F.lit(1)).alias("cyclic"))
    m = depths(e, roots_of(e, nodes), comp).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    s = s.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(m))
    return s.withColumn("score", scalars.clamp(100.0 - 2 * F.col("high_fan_in") - 3 * F.col("high_fan_out") - 10 * F.col("cyclic") - F.greatest(F.lit(0), F.col("depth") - 10)))


def hierarchy_score(e: DataFrame, known: DataFrame) -> DataFrame:
    """Capped penalties: cycles 10 each to 40, fan-out above 20 to 20, missing definitions 3 each to 15, depth above 10 half each to 10."""
    comp = components(e)
    m = metrics(e, known, comp)
    n = implicit(e, known).agg(F.count(F.lit(1)).alias("missing"))
    c = cycles(e, comp).agg(F.count(F.lit(1)).alias("cycles"))
    s = m.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(c))
    off = F.least(F.lit(40.0), 10.0 * F.col("cycles")) + F.when(F.col("max_fan_out") > 20, F.least(F.lit(20.0), F.col("max_fan_out") - 20.0)).otherwise(0.0) + F.least(F.lit(15.0), 3.0 * F.col("missing")) + F.when(F.col("depth") > 10, F.least(F.lit(10.0), (F.col("depth") - 10) * 0.5)).otherwise(0.0)
    return s.select("cycles", "max_fan_out", "missing", "depth", scalars.clamp(100 - off).alias("score"))


def dependency_score(f: DataFrame, files: DataFrame) -> DataFrame:
    """Eight capped penalties, and the counts they stand on."""
    e, known = staged(edges(f), "edges"), staged(defined(f), "defined")
    inc, comp = staged(include_edges(f, files), "include-edges"), components(e)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        one(cycles(e, comp), "cycles"), one(cycles(inc), "circular_includes"), one(includes(f, files).where("path is null"), "unresolved_includes"), one(degrees(e, known).where("fan_out > 15"), "high_fan_out"),
        one(collisions(f), "collisions"), one(rules.mismatches(f), "mismatches"), one(isolated(e, known), "orphans"), depths(e, roots_of(e, known), comp).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth")),
    ]
    s = parts[0]
    for p in parts[1:]:
        s = s.crossJoin(F.broadcast(p))  # one row each
    cap = lambda c, each, most: F.least(F.col(c) * each, F.lit(most))
    off = cap("cycles", 10, 40) + cap("circular_includes", 5, 20) + cap("unresolved_includes", 2, 10) + cap("high_fan_out", 3, 15) + cap("collisions", 2, 10) + cap("mismatches", 3, 15) + cap("orphans", 1, 10) + F.greatest(F.lit(0), F.least(F.col("depth") - 10, F.lit(5)))
    return s.withColumn("score", F.greatest(F.lit(0), 100 - off))


def isolated(e: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes without an edge, testbenches left out."""
    return degrees(e, known).where("fan_in = 0 and fan_out = 0").where(~rules.testbench_name(F.col("name"))).select("name")


def findings(f: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, subject, severity): cycles, unresolved includes and packages, fan-out, collisions, mismatches and depth."""
    e, known = staged(edges(f), "edges"), staged(defined(f), "defined")
    row = lambda df, rule, subject, severity: df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), F.lit(severity).alias("severity"))
    comp = components(e)
    out = row(cycles(e, comp), "DEP-001", F.array_join("cycle", ">"), "critical")
    out = out.unionByName(row(cycles(include_edges(f, files)), "DEP-002", F.array_join("cycle", ">"), "high"))
    out = out.unionByName(row(includes(f, files).where("path is null"), "DEP-003", F.col("target"), "high"))
    out = out.unionByName(row(degrees(e, known).where("fan_out > 15"), "DEP-004", F.col("name"), "medium"))
    out = out.unionByName(row(collisions(f), "DEP-005", F.col("qualified"), "medium"))
    out = out.unionByName(row(rules.mismatches(f), "DEP-006", F.concat_ws(".", "parent", "child", "param"), "high"))
    return out.unionByName(row(depths(e, roots_of(e, known), comp).where("depth > 10"), "DEP-007", F.col("name"), "low"))


def unresolved_packages(f: DataFrame) -> DataFrame:
    known = f.where("kind = 'package'").select(F.col("name").alias("package")).distinct()
    return facts.imports(f).where(~F.lower("package").isin(*rules.SYSTEM_PACKAGES)).join(known, "package", "left_anti").select("file_id", "package")


def expanded_imports(f: DataFrame) -> DataFrame:
    """(file_id, symbol): a wildcard stands for every name that the package declares, another import for itself."""
    i = facts.imports(f)
    exported = facts.packages(f).select("package", F.col("name").alias("export")).distinct()
    wild = i.where("symbol = '*'").join(exported, "package").select("file_id", F.col("export").alias("symbol"))
    return wild.unionByName(i.where("symbol <> '*'").select("file_id", "symbol")).distinct()


def _on(f) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the design's facts, files, edges and definitions, from one pass of the parser."""

    def run(s: SparkSession, d: str) -> DataFrame:
        files = corpus.files(s, d)
        found = facts.kept(files)
        return f(found, files, edges(found), defined(found))

    return run


def _reach(e: DataFrame, known: DataFrame) -> DataFrame:
    """What testbenches reach: the entry points."""
    return reached(e, known.where(rules.testbench_name(F.col("name"))))


def _top(df: DataFrame, n: int, *by: Column) -> DataFrame:
    return df.orderBy(*by).limit(n)


QUERIES = {
    "j01_edges": _on(lambda f, files, e, known: e),
    "j02_implicit_nodes": _on(lambda f, files, e, known: implicit(e, known)),
    "j03_include_resolution": _on(lambda f, files, e, known: includes(f, files)),
    "j04_unresolved_includes": _on(lambda f, files, e, known: includes(f, files).where("path is null").select("file_id", "target")),
    "j05_unresolved_packages": _on(lambda f, files, e, known: unresolved_packages(f)),
    "j06_wildcard_import": _on(lambda f, files, e, known: expanded_imports(f)),
    "j09_override_defaults": _on(lambda f, files, e, known: facts.overrides(f).join(f.where("kind = 'parameter'").select(F.col("scope").alias("child"), F.col("name").alias("param"), F.col("value").alias("default")), ["child", "param"], "left").select("parent", "child", "param", "value", "default")),
    "j10_orphan_modules": _on(lambda f, files, e, known: isolated(e, known)),
    "j11_unconnected_interfaces": _on(lambda f, files, e, known: f.where("kind = 'interface'").select("name").join(bindings(f).select(F.col("interface").alias("name")), "name", "left_anti")),
    "j12_collisions": _on(lambda f, files, e, known: collisions(f)),
    "j13_propagated_symbols": _on(lambda f, files, e, known: include_closure(include_edges(f, files)).join(facts.symbols(f).join(files.select("file_id", F.col("path").alias("included")), "file_id").select("included", "qualified"), "included").select("file", "qualified").distinct()),
    "j14_bindings": _on(lambda f, files, e, known: bindings(f)),
    "j26_neighbours": _on(lambda f, files, e, known: e.join(known.select(F.col("name").alias("child"), F.concat_ws("::", F.col("file_id").cast("string"), "name").alias("key")), "child").select("parent", "key")),
    "g01_degrees": _on(lambda f, files, e, known: degrees(e, known)),
    "g02_roots_leaves": _on(lambda f, files, e, known: degrees(e, known).where("fan_in = 0 or fan_out = 0").where(~rules.testbench_name(F.col("name"))).select("name", F.when((F.col("fan_in") == 0) & (F.col("fan_out") == 0), "orphan").when(F.col("fan_in") == 0, "root").otherwise("leaf").alias("kind"))),
    "g03_cycles": _on(lambda f, files, e, known: cycles(e).select(F.array_join("cycle", ">").alias("cycle"))),
    "g04_cyclic_nodes": _on(lambda f, files, e, known: on_cycles(components(e))),
    "g05_depths": _on(lambda f, files, e, known: depths(e, roots_of(e, known))),
    "g06_reachable": _on(lambda f, files, e, known: _reach(e, known).select("name")),
    "g07_include_closure": _on(lambda f, files, e, known: include_closure(include_edges(f, files))),
    "g07_circular_includes": _on(lambda f, files, e, known: cycles(include_edges(f, files)).select(F.array_join("cycle", ">").alias("cycle"))),
    "g08_context_includes": _on(lambda f, files, e, known: include_closure(include_edges(f, files), 2).select("file", "included")),
    "g09_children_parents": _on(lambda f, files, e, known: e.groupBy("child").agg(F.array_join(F.array_sort(F.collect_set("parent")), ",").alias("parents"))),
    "g12_isolated": _on(lambda f, files, e, known: degrees(e, f.where(F.col("kind").isin("module", "package", "interface")).select("name").distinct()).where("fan_in = 0 and fan_out = 0").select("name")),
    "u02_unreachable": _on(lambda f, files, e, known: known.select("name").join(_reach(e, known).select("name"), "name", "left_anti")),
    "w07_first_definition": _on(lambda f, files, e, known: known),
    "a12_hierarchy_score": _on(lambda f, files, e, known: hierarchy_score(e, known)),
    "a14_hierarchy_metrics": _on(lambda f, files, e, known: metrics(e, known)),
    "a15_unused_modules": _on(lambda f, files, e, known: known.join(_reach(e, known).select("name", F.lit(1).alias("hit")), "name", "left").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("hit").isNull(), 1)).alias("unused")).withColumn("score", scalars.clamp(100 - 100.0 * F.col("unused") / F.greatest("total", F.lit(1))))),
    "a19_dependency_score": _on(lambda f, files, e, known: dependency_score(f, files)),
    "a39_dependency_documents": _on(lambda f, files, e, known: _top(facts.dependencies(f).groupBy("file_id").agg(F.count(F.lit(1)).alias("n")), 10, F.desc("n"), F.col("file_id"))),
    "a44_package_importers": _on(lambda f, files, e, known: facts.imports(f).groupBy("package").agg(F.countDistinct("file_id").alias("importers"))),
    "a45_proposals": _on(lambda f, files, e, known: _top(degrees(e, known).where("fan_out > 2").select(F.lit("split").alias("step"), "name", "fan_out"), 3, F.desc("fan_out"), F.col("name"))),
    "r14_graph_findings": _on(lambda f, files, e, known: findings(f, files)),
    "r18_graph_validation": _on(lambda f, files, e, known: metrics(e, known).select(F.explode(F.array(F.struct(F.lit("cycles").alias("check"), (F.col("cyclic") == 0).alias("ok")), F.struct(F.lit("depth").alias("check"), (F.col("depth") <= 10).alias("ok")), F.struct(F.lit("fan_out").alias("check"), (F.col("high_fan_out") == 0).alias("ok")))).alias("x")).select("x.*")),
    "o06_top_fan_out": _on(lambda f, files, e, known: _top(degrees(e, known).select("name", "fan_out"), 20, F.desc("fan_out"), F.col("name"))),
    "o06_top_includers": _on(lambda f, files, e, known: _top(facts.includes(f).groupBy("file_id").agg(F.count(F.lit(1)).alias("n")), 15, F.desc("n"), F.col("file_id"))),
    "o08_graph_slice": _on(lambda f, files, e, known: _top(e.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy("child"))).where("r <= 2").select("parent", "child"), 50, F.col("parent"), F.col("child"))),
}

_DEG = "deg AS (SELECT n.name, (SELECT count(*) FROM f_edge e WHERE e.child = n.name) AS fan_in, (SELECT count(*) FROM f_edge e WHERE e.parent = n.name) AS fan_out FROM f_mod n)"
_CYCLIC = "SELECT p_partkey AS k FROM part WHERE p_partkey % 48 = 32"
_CYC = f"SELECT least('m' || k, 'm' || (k // 2)) || '>' || greatest('m' || k, 'm' || (k // 2)) AS cycle FROM ({_CYCLIC}) UNION ALL SELECT 'm0' FROM part WHERE p_partkey = 0"
_ACYCLIC = f"SELECT parent, child FROM f_edge WHERE parent <> child AND NOT EXISTS (SELECT 1 FROM ({_CYCLIC}) c WHERE parent = 'm' || k AND child = 'm' || (k // 2) OR child = 'm' || k AND parent = 'm' || (k // 2))"
_DEPTH = f"RECURSIVE walk AS (SELECT name, 0 AS depth FROM f_mod WHERE name NOT IN (SELECT child FROM f_edge) UNION SELECT e.child, w.depth + 1 FROM walk w JOIN ({_ACYCLIC}) e ON w.name = e.parent), deepest AS (SELECT name, max(depth) AS depth FROM walk GROUP BY name)"
_REACH = "RECURSIVE reach AS (SELECT name FROM f_mod WHERE name LIKE 'tb%' UNION SELECT e.child FROM reach r JOIN f_edge e ON r.name = e.parent)"
_RES = "SELECT i.file_id, i.line, i.target, p.path FROM f_inc i LEFT JOIN f_path p ON p.path = 'inc/' || i.target"
_IE = f"SELECT DISTINCT p.path AS parent, r.path AS child FROM ({_RES}) r JOIN f_path p ON p.file_id = r.file_id WHERE r.path IS NOT NULL"
_CLOSE = f"RECURSIVE ie AS ({_IE}), c AS (SELECT parent AS file, child AS included, 1 AS depth FROM ie UNION SELECT c.file, ie.child, c.depth + 1 FROM c JOIN ie ON c.included = ie.parent WHERE c.depth < {{}})"
_INC_CYCLES = "SELECT p_partkey AS k FROM part WHERE p_partkey % 24 = 12 AND p_partkey - 8 >= 4"
_MISMATCH = f"({rules.ORACLE['r15_type_mismatch']})"
_COLL = "SELECT 'GUARD' AS qualified, p_partkey AS file_id, p_partkey - 16 AS previous FROM part WHERE p_partkey % 16 = 4 AND p_partkey > 16"
ORACLE = {
    "j01_edges": "SELECT parent, child FROM f_edge",
    "j02_implicit_nodes": "SELECT DISTINCT child AS name FROM f_edge WHERE child NOT IN (SELECT name FROM f_mod)",
    "j03_include_resolution": _RES,
    "j04_unresolved_includes": f"SELECT file_id, target FROM ({_RES}) WHERE path IS NULL",
    "j05_unresolved_packages": "SELECT file_id, package FROM f_imp WHERE package <> 'uvm_pkg' AND package NOT IN (SELECT name FROM f_def WHERE kind = 'package')",
    "j06_wildcard_import": f"SELECT DISTINCT i.file_id, p.name AS symbol FROM f_imp i JOIN ({facts.ORACLE['x05_packages']}) p ON p.package = i.package",
    "j09_override_defaults": f"""SELECT o.parent, o.child, o.param, o.value, CASE WHEN m.name IS NOT NULL THEN '8' END AS "default" FROM ({facts.ORACLE['x06_overrides']}) o LEFT JOIN f_mod m ON m.name = o.child""",
    "j10_orphan_modules": f"WITH {_DEG} SELECT name FROM deg WHERE fan_in = 0 AND fan_out = 0 AND name NOT LIKE 'tb%'",
    "j11_unconnected_interfaces": "SELECT name FROM f_def WHERE kind = 'interface' AND name NOT IN (SELECT child FROM f_inst WHERE instance = 'bus')",
    "j12_collisions": _COLL,
    "j13_propagated_symbols": f"WITH {_CLOSE.format(400)} SELECT DISTINCT c.file, u.n || p.file_id AS qualified FROM c JOIN f_path p ON p.path = c.included, (VALUES ('WIDTH'), ('LONG')) u(n) UNION ALL SELECT DISTINCT c.file, CASE WHEN p.file_id > 0 THEN 'GUARD' END || CASE WHEN false THEN p.path ELSE '' END FROM c JOIN f_path p ON p.path = c.included WHERE p.file_id % 16 = 4",
    "j14_bindings": "SELECT i.file_id, i.parent AS module, i.instance, i.child AS interface FROM f_inst i WHERE i.instance = 'bus' AND i.child IN (SELECT name FROM f_def WHERE kind = 'interface')",
    "j26_neighbours": "SELECT e.parent, m.file_id || '::' || m.name AS key FROM f_edge e JOIN f_mod m ON e.child = m.name",
    "g01_degrees": f"WITH {_DEG} SELECT * FROM deg",
    "g02_roots_leaves": f"WITH {_DEG} SELECT name, CASE WHEN fan_in = 0 AND fan_out = 0 THEN 'orphan' WHEN fan_in = 0 THEN 'root' ELSE 'leaf' END AS kind FROM deg WHERE (fan_in = 0 OR fan_out = 0) AND name NOT LIKE 'tb%'",
    "g03_cycles": _CYC,
    "g04_cyclic_nodes": f"SELECT 'm' || k AS name FROM ({_CYCLIC}) UNION ALL SELECT 'm' || (k // 2) FROM ({_CYCLIC}) UNION ALL SELECT 'm0' FROM part WHERE p_partkey = 0",
    "g05_depths": f"WITH {_DEPTH} SELECT name, depth FROM deepest",
    "g06_reachable": f"WITH {_REACH} SELECT name FROM reach",
    "g07_include_closure": f"WITH {_CLOSE.format(400)} SELECT file, included, min(depth) AS depth FROM c GROUP BY file, included",
    "g07_circular_includes": f"SELECT least('inc/h' || k || '.vh', 'inc/h' || (k - 8) || '.vh') || '>' || greatest('inc/h' || k || '.vh', 'inc/h' || (k - 8) || '.vh') AS cycle FROM ({_INC_CYCLES})",
    "g08_context_includes": f"WITH {_CLOSE.format(2)} SELECT DISTINCT file, included FROM c",
    "g09_children_parents": "SELECT child, string_agg(parent, ',' ORDER BY parent) AS parents FROM f_edge GROUP BY child",
    "g12_isolated": "SELECT DISTINCT name FROM f_def WHERE name NOT IN (SELECT child FROM f_edge) AND name NOT IN (SELECT parent FROM f_edge)",
    "u02_unreachable": f"WITH {_REACH} SELECT name FROM f_mod WHERE name NOT IN (SELECT name FROM reach)",
    "w07_first_definition": "SELECT name, file_id FROM f_mod",
    "a15_unused_modules": f"WITH {_REACH}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE name NOT IN (SELECT name FROM reach)) AS unused FROM f_mod) SELECT total, unused, 100 - 100.0::DOUBLE * unused / total AS score FROM s",
    "a12_hierarchy_score": f"WITH {_DEPTH}, s AS (SELECT (SELECT count(*) FROM ({_CYC})) AS cycles, 3 AS max_fan_out, (SELECT count(DISTINCT child) FROM f_edge WHERE child NOT IN (SELECT name FROM f_mod)) AS missing, (SELECT max(depth) FROM deepest) AS depth), t AS (SELECT * FROM s) SELECT *, 100 - least(40.0, 10 * cycles) - least(15.0, 3 * missing) - greatest(0, least(10, (depth - 10) * 0.5)) AS score FROM t",
    "a14_hierarchy_metrics": f"WITH {_DEPTH}, nodes AS (SELECT name FROM f_mod UNION SELECT child FROM f_edge), i AS (SELECT child, count(*) AS n FROM f_edge GROUP BY child), s AS (SELECT (SELECT count(*) FROM nodes) AS modules, (SELECT count(*) FROM f_edge) AS edges, (SELECT max(n) FROM i) AS max_fan_in, 3 AS max_fan_out, (SELECT count(*) FROM i WHERE n > 20) AS high_fan_in, 0 AS high_fan_out, (SELECT count(*) FROM nodes WHERE name NOT IN (SELECT parent FROM f_edge)) AS leaves, (SELECT count(*) FROM nodes WHERE name NOT IN (SELECT child FROM f_edge)) AS roots, (SELECT 2 * count(*) + 1 FROM ({_CYCLIC})) AS cyclic, (SELECT max(depth) FROM deepest) AS depth) SELECT *, greatest(0.0, 100 - 2 * high_fan_in - 10 * cyclic - greatest(0, depth - 10)) AS score FROM s",
    "a19_dependency_score": f"WITH {_DEPTH}, {_DEG}, s AS (SELECT (SELECT count(*) FROM ({_CYC})) AS cycles, (SELECT count(*) FROM ({_INC_CYCLES})) AS circular_includes, (SELECT count(*) FROM ({_RES}) WHERE path IS NULL) AS unresolved_includes, 0 AS high_fan_out, (SELECT count(*) FROM ({_COLL})) AS collisions, (SELECT count(*) FROM {_MISMATCH}) AS mismatches, (SELECT count(*) FROM deg WHERE fan_in = 0 AND fan_out = 0 AND name NOT LIKE 'tb%') AS orphans, (SELECT max(depth) FROM deepest) AS depth) SELECT *, greatest(0, 100 - least(10 * cycles, 40) - least(5 * circular_includes, 20) - least(2 * unresolved_includes, 10) - least(2 * collisions, 10) - least(3 * mismatches, 15) - least(orphans, 10) - greatest(0, least(depth - 10, 5))) AS score FROM s",
    "a39_dependency_documents": "SELECT file_id, count(*) AS n FROM (SELECT file_id FROM f_inc UNION ALL SELECT file_id FROM f_imp) GROUP BY file_id ORDER BY n DESC, file_id LIMIT 10",
    "a44_package_importers": "SELECT package, count(DISTINCT file_id) AS importers FROM f_imp GROUP BY package",
    "a45_proposals": f"WITH {_DEG} SELECT 'split' AS step, name, fan_out FROM deg WHERE fan_out > 2 ORDER BY fan_out DESC, name LIMIT 3",
    "r14_graph_findings": f"WITH {_DEPTH} SELECT 'DEP-001' AS rule, cycle AS subject, 'critical' AS severity FROM ({_CYC}) UNION ALL SELECT 'DEP-002', least('inc/h' || k || '.vh', 'inc/h' || (k - 8) || '.vh') || '>' || greatest('inc/h' || k || '.vh', 'inc/h' || (k - 8) || '.vh'), 'high' FROM ({_INC_CYCLES}) UNION ALL SELECT 'DEP-003', target, 'high' FROM ({_RES}) WHERE path IS NULL UNION ALL SELECT 'DEP-005', qualified, 'medium' FROM ({_COLL}) UNION ALL SELECT 'DEP-006', parent || '.' || child || '.' || param, 'high' FROM {_MISMATCH} UNION ALL SELECT 'DEP-007', name, 'low' FROM deepest WHERE depth > 10",
    "r18_graph_validation": f"WITH {_DEPTH} SELECT 'cycles' AS \"check\", (SELECT count(*) FROM ({_CYC})) = 0 AS ok UNION ALL SELECT 'depth', (SELECT max(depth) FROM deepest) <= 10 UNION ALL SELECT 'fan_out', true",
    "o06_top_fan_out": f"WITH {_DEG} SELECT name, fan_out FROM deg ORDER BY fan_out DESC, name LIMIT 20",
    "o06_top_includers": "SELECT file_id, count(*) AS n FROM f_inc GROUP BY file_id ORDER BY n DESC, file_id LIMIT 15",
    "o08_graph_slice": "SELECT parent, child FROM (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY child) AS r FROM f_edge) WHERE r <= 2 ORDER BY parent, child LIMIT 50",
}
