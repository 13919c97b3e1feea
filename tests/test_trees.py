"""Trees as rows against a plain walk of the standard library's parser."""

import xml.etree.ElementTree as ET

import numpy as np
import pytest

from quarry.operators import trees


def plain(text):
    """Metrics of the modules of the first netlist, by recursion."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []
    netlist, out = root.find("netlist"), []
    for m in [] if netlist is None else netlist.findall("module"):
        def deepest(e, names, depth=0):
            return max([depth, *(deepest(c, names, depth + (e.tag.lower() in names)) for c in e)])

        blocks = [e for name in trees.ALWAYS for e in m.iter(name)]
        cc = 1 + sum(1 for b in blocks for e in b.iter() if e is not b and e.tag in trees.DECISIONS)
        n = lambda tag: len(m.findall(f".//{tag}"))
        out.append((m.get("name") or "unknown", cc, max([deepest(b, trees.NESTING) for b in blocks], default=0), max([deepest(e, trees.EXPRESSIONS) for e in m.iter("assign")], default=0),
                    sum(e.tag.lower() in trees.OPERATORS for e in m.iter()), len(m.findall(".//*")), n("var"), sum(v.get("dir") in trees.PORTS for v in m.iter("var")), n("always"), n("instance")))
    return sorted(out)


def made(rng, depth=0):
    tag = str(rng.choice(["if", "begin", "case", "caseitem", "always", "alwaysff", "assign", "add", "Not", "var", "instance", "x", "sel"]))
    attributes = ' dir="input"' if tag == "var" and rng.random() < 0.5 else " a='1>2'" if rng.random() < 0.1 else ""
    inner = "".join(made(rng, depth + 1) for _ in range(rng.integers(0, 4))) if depth < 6 else ""
    return f"<{tag}{attributes}/>" if not inner and rng.random() < 0.5 else f"<{tag}{attributes}>{'text' if rng.random() < 0.2 else ''}{inner}</{tag}>"


def test_metrics_equal_a_plain_walk(spark):
    rng = np.random.default_rng(8)
    texts = [f'<r><typetable/><netlist><module name="a{i}">{"".join(made(rng) for _ in range(5))}</module><module>{made(rng)}</module></netlist><netlist><module name="z"/></netlist><tail><p><if/></p></tail></r>' for i in range(40)]
    texts += ["<r><netlist><module name='q'></netlist></module></r>", "<r><netlist/>", "<r/><r/>", "", "no tree", "<r><other><module name='n'/></other></r>", "<!-- <r> --><r><netlist><module name='c'><![CDATA[<if>]]></module></netlist></r>", "<r><netlist><module name='c'/></netlist> < </r>", "</r>"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "file_id long, xml string")
    got = {}
    for r in trees.module_metrics(df).collect():
        got.setdefault(r["file_id"], []).append((r["module"], r["cc"], r["nesting"], r["expression_depth"], r["operators"], r["tokens"], r["signals"], r["ports"], r["always"], r["instances"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: plain(t) for i, t in enumerate(texts) if plain(t)}
    assert len(got) > 40


def test_nodes_are_nested_ranges(spark):
    df = spark.createDataFrame([(1, "<a><b x='1'><c/></b><b/></a>")], "file_id long, xml string")
    rows = {(r["entry"]): r for r in trees.nodes(df).collect()}
    ranges = [(r["tag"], r["entry"], r["exit"], r["depth"]) for _, r in sorted(rows.items())]
    assert [(t, d) for t, _, _, d in ranges] == [("a", 1), ("b", 2), ("c", 3), ("b", 2)]
    a, b, c, b2 = [(x, y) for _, x, y, _ in ranges]
    assert a[0] < b[0] < c[0] < c[1] < b[1] < b2[0] < b2[1] < a[1]


def test_files_through_the_reader(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"t{i}.xml").write_text(f'<r><netlist><module name="m{i}" origName="o{i}"><var name="p" dir="input"/></module><module name="n{i}"/></netlist></r>')
    assert sorted((r["name"], r["orig_name"]) for r in trees.read_modules(spark, str(tmp_path)).collect()) == sorted([(f"m{i}", f"o{i}") for i in range(3)] + [(f"n{i}", f"n{i}") for i in range(3)])
    assert trees.module_metrics(trees.read_trees(spark, str(tmp_path))).where("ports = 1").count() == 3


@pytest.mark.parametrize("text", ["", "kModuleHeader", 'SymbolIdentifier @1:2-3:4 "a"', "kGateInstance\nSymbolIdentifier @1:2-3:4 \"a\""])
def test_prints_without_a_module(spark, text):
    assert trees.printed(spark.createDataFrame([(1, text)], "file_id long, tree string")).count() == 0
