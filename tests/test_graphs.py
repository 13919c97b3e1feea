"""Components, depths and cycles against plain walks, on random graphs, long rings and chains."""

import numpy as np
import pytest

from quarry.functions import hdl_text
from quarry.operators import facts, graphs

EDGES = "parent string, child string"


def plain_components(edges):
    """Nodes on cycles with the least node of their component, by reach in both directions."""
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)

    def reach(start, ways):
        seen, todo = set(), [start]
        while todo:
            for y in ways.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    found = {}
    for v in {x for e in edges for x in e}:
        if v not in found:
            own = reach(v, out) & reach(v, into)
            if v in own:
                found |= dict.fromkeys(own, min(own))
    return found


@pytest.mark.parametrize(("seed", "n", "m", "small"), [(9, 40, 70, 0), (3, 60, 90, 8), (5, 500, 700, 10**6)])
def test_components_equal_plain_ones(spark, seed, n, m, small):
    """By rounds down to the last edge, by rounds to a few edges, and in one task."""
    edges = sorted({(f"n{a:03}", f"n{b:03}") for a, b in np.random.default_rng(seed).integers(0, n, (m, 2))})
    got = {r["name"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, EDGES), small).collect()}
    assert got == plain_components(edges)


def test_one_component_of_thousands(spark):
    """A ring of 5,000, one with shortcuts, a long way into it and out of it: rounds grow with the logarithm of chains."""
    ring = [(f"r{i:04}", f"r{(i + 1) % 5000:04}") for i in range(5000)]
    more = [(f"a{i:04}", f"a{i + 1:04}") for i in range(800)] + [("a0800", "r0000"), ("r2500", "z0000")] + [(f"z{i:04}", f"z{i + 1:04}") for i in range(800)]
    two = [(f"s{i}", f"s{(i + 1) % 40}") for i in range(40)] + [("s0", "s20"), ("s30", "s5"), ("self", "self"), ("s7", "r0000")]
    for small in (20, graphs.FEW_EDGES):
        got = {r["name"]: r["component"] for r in graphs.components(spark.createDataFrame(ring + more + two, EDGES), small).collect()}
        assert got == {a: "r0000" for a, _ in ring} | {f"s{i}": "s0" for i in range(40)} | {"self": "self"}


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert graphs.components(none).count() == graphs.cycles(none).count() == graphs.depths(none, spark.createDataFrame([], "name string")).count() == 0


def test_depths_equal_the_longest_ways(spark):
    rng = np.random.default_rng(9)
    edges = sorted({(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, 40, (70, 2))})
    comp = plain_components(edges)
    dag = [(a, b) for a, b in edges if a not in comp or comp.get(a) != comp.get(b)]
    roots = sorted({a for a, _ in edges} - {b for _, b in edges})
    best = dict.fromkeys(roots, 0)
    for _ in range(len(edges)):
        for a, b in dag:
            if a in best:
                best[b] = max(best.get(b, 0), best[a] + 1)
    got = graphs.depths(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(r,) for r in roots], "name string"))
    assert {r["name"]: r["depth"] for r in got.collect()} == best


def test_cycles_equal_a_plain_search(spark):
    rng = np.random.default_rng(4)
    edges = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 8, (18, 2))})
    want = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0]:
                    want.add(tuple(path))
                elif b > path[0] and b not in path:
                    walk([*path, b])

    for v in {x for e in edges for x in e}:
        walk([v])
    assert sorted(tuple(r["cycle"]) for r in graphs.cycles(spark.createDataFrame(edges, EDGES)).collect()) == sorted(want)


def test_blocks_on_one_line_stay_apart(spark):
    text = "module m; always @(posedge a) begin x = 1; end always @(posedge b) begin if (c) y <= 2; end always @(posedge b) z <= 1; endmodule"
    files = spark.createDataFrame([(1, "a.v", text)], "file_id long, path string, source string")
    rows = facts.blocks(facts.extract(files)).collect()
    assert sorted((r["clocks"], r["cc"], r["nesting"], r["blocking"]) for r in rows) == [("a", 1, 1, 1), ("b", 1, 0, 0), ("b", 2, 1, 0)]
    assert facts.module_info(facts.extract(files)).first()["blocks"] == 3
    assert sum(r[0] == "block" for r in hdl_text.facts(text)) == 3
