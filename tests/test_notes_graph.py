"""A small vault of notes: parsing, resolution, stubs, ids, and queries over the graph."""

import pytest

from quillgraph.plans.compile import run
from quillgraph.plans.lexer import CypherError
from quillgraph.sources import notes as N

VAULT = {
    "plants/Oak.md": "---\ntype: Plant\nheight: 30\nzones: [5, 6]\n---\n# Neighbours\nshades:: [[Fern]] {hours: 6, note: \"from noon, on\"}\nshades:: [[Moss]] {hours: 4}\nshades:: [[Moss]] {hours: 2}\n# Guests\n-harms:: [[Fern]] {id: 'oak-fern', how: tannin}\nhosts:: [[Jay]]\n",
    "plants/Fern.md": "---\ntype: Plant\ntypes: [Groundcover]\nheight: 1\n---\nshades:: [[Moss]] {hours: 9}\n> - growsIn:: [[places/Dell]] {since: spring}\n+covers:: [[Dell]]\n",
    "plants/Moss.md": "---\ntype: Plant\nheight: 0.1\n---\nshades:: [[Beetle]]\ngrowsIn:: [[Dell]]\n",
    "plants/Ivy.md": "---\ntype: Plant\n---\nshades:: [[Wall]]\n",
    "animals/Jay.md": "---\ntype: Animal\n---\nplants:: [[Oak]]\n",
    "places/Dell.md": "---\ntype: Place\n---\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    return N.notes_graph(spark, spark.createDataFrame(list(VAULT.items()), "path string, text string"))


def rows(graph, query, **params):
    return [tuple(r) for r in run(graph, query, params).df.collect()]


@pytest.mark.parametrize(
    "query, want",
    [
        ("MATCH (a)-[r:shades]->(b) RETURN count(r) AS n, count(DISTINCT b) AS d", [(6, 4)]),
        ("MATCH (n) WHERE NOT n.stub RETURN count(*) AS n", [(6,)]),
        ("MATCH (n) WHERE n.stub RETURN id(n) AS id ORDER BY id", [("Beetle",), ("Wall",)]),
        ("MATCH (n:Plant:Groundcover) RETURN n.title AS t", [("Fern",)]),
        ("MATCH (a:Plant {title:'Oak'})-[r:shades]->(b) WHERE b.title = 'Moss' RETURN r.hours AS h ORDER BY h", [(2.0,), (4.0,)]),
        ("MATCH ()-[r {id:'oak-fern'}]->(e) RETURN r.sign AS s, r.how AS h, e.title AS t", [(-1, "tannin", "Fern")]),
        ("MATCH (a)-[r:shades]->(b) RETURN id(r) AS id ORDER BY id LIMIT 2", [("plants/Fern.md#shades#plants/Moss.md#0",), ("plants/Ivy.md#shades#Wall#0",)]),
        ("MATCH (a {title:'Oak'})-[r]->() WHERE r.heading = 'Guests' RETURN count(*) AS n", [(2,)]),
        ("MATCH (n:Plant) RETURN n.title AS t ORDER BY n.height DESC", [("Ivy",), ("Oak",), ("Fern",), ("Moss",)]),
        ("MATCH (a {title:'Oak'})-[:shades*1..2]->(b) RETURN count(*) AS n", [(6,)]),
        ("MATCH (a {title:'Jay'})-[r]->(b) RETURN startNode(r).title AS s, endNode(r).height AS h", [("Jay", 30.0)]),
    ],
)
def test_queries(graph, query, want):
    assert rows(graph, query) == want


def test_edges_count(graph):
    assert graph.edges(None, {}).count() == 12


@pytest.mark.parametrize("text, kind", [("CREATE (n)", "readonly"), ("MATCH (n) SET n.x = 1 RETURN n", "readonly"), ("UNWIND [1] AS x RETURN x", "unsupported"), ("MATCH (n RETURN n", "syntax"), ("MATCH (n) RETURN m", "syntax"), ("MATCH (n) RETURN foo(n)", "unsupported"), ("MATCH (n) RETURN $p AS p", "runtime"), ("MATCH (n) WHERE count(n) > 1 RETURN n", "syntax")])
def test_errors(graph, text, kind):
    with pytest.raises(CypherError) as e:
        run(graph, text)
    assert e.value.kind == kind and e.value.line


def test_props_and_links():
    assert N.parse_props('{since: 2020, label: "met at conf", tags: [a, \'b c\', 3], on: true, url: a:b,}') == {"since": 2020.0, "label": "met at conf", "tags": ["a", "b c", 3.0], "on": True, "url": "a:b"}
    edges, problems = N.parse_note("a/n.md", "x:: [[A]], [[B|bee]] {k: 1}\n```\ny:: [[C]]\n```\n- z:: [t](../m%20n.md#h)\nw:: [[D]] {k 1}\nsee [[E]] `[[F]]`\n", link_edges=True)
    assert [(e[0], e[2], e[5]) for e in edges] == [("x", "A", {"k": 1.0}), ("x", "B", {"k": 1.0}), ("z", "m n.md", {}), ("w", "D", {}), ("links_to", "E", {})]
    assert len(problems) == 1
    assert N.parse_note("n.md", "") == ([], [])


def test_resolution(spark):
    paths = spark.createDataFrame([("a/X.md",), ("b/X.md",), ("long/er/Y.md",), ("Z.md",), ("Z.adoc",)], "path string")
    links = spark.createDataFrame([("b/n.md", "X"), ("c/n.md", "x"), ("c/n.md", "er/Y"), ("c/n.md", "Z"), ("c/n.md", "Z.md"), ("c/n.md", "none")], "path string, target string")
    assert {(r["path"], r["target"]): r["to"] for r in N.resolve_links(links, paths).collect()} == {("b/n.md", "X"): "b/X.md", ("c/n.md", "x"): "a/X.md", ("c/n.md", "er/Y"): "long/er/Y.md", ("c/n.md", "Z"): None, ("c/n.md", "Z.md"): "Z.md", ("c/n.md", "none"): None}


def test_resolution_makes_no_pairs(spark):
    """Links to a name that many folders have: a candidate for each link, not for each pair."""
    n = 300
    paths = spark.range(n).selectExpr("concat('f', id, '/index.md') as path")
    links = spark.range(n).selectExpr("concat('g', id, '/a.md') as path", "'index' as target").unionByName(spark.range(n).selectExpr("concat('f', id, '/a.md') as path", "'index' as target"))
    found = N.resolve_links(links, paths)
    got = {r["path"]: r["to"] for r in found.collect()}
    assert got["g7/a.md"] == "f0/index.md" and got["f7/a.md"] == "f7/index.md" and len(got) == 2 * n
    plan = found._jdf.queryExecution().executedPlan()
    most = max(int(m["v"]) for m in metrics_of(plan))
    assert most <= 5 * n, most


def metrics_of(plan):
    """Rows that each node of an executed plan gave out."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        m = p.metrics().get("numOutputRows")
        if m.isDefined():
            out.append({"name": p.nodeName(), "v": m.get().value()})
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_hostile_frontmatter(spark):
    texts = ["---\nk:\n  - \n  -\n- \n- x\n---\n", "---\n- \n---\n", "---\n: x\na\n---", "---\n---\n", "---", "", None, "---\nid: 3\nsign: x\npath: q\ntitle: [1]\nheading: 2\n---\na:: [[b]] {heading: 3, line: x, path: y}\n"]
    vault = spark.createDataFrame([(f"n{i}.md", t) for i, t in enumerate(texts)], "path string, text string")
    g = N.notes_graph(spark, vault)
    got = rows(g, "MATCH (n) WHERE NOT n.stub RETURN n.path AS p, n.k AS k ORDER BY p")
    assert len(got) == len(texts) and got[0] == ("n0.md", [None, None, None, "x"])
    assert rows(g, "MATCH (n)-[r]->() RETURN n.title AS t, r.line AS l, keys(r) AS k") == [("n7", 7, ["path"])]
    g.close()


def test_links_of_a_path():
    for dest, want in {
        "../x y.md#A%20b": ("x y.md", "A b"), "<sub/t>": ("a/sub/t.md", None), "/root.adoc": ("root.adoc", None), "../../../up": ("up.md", None), "mailto:x@y": None, "//host/x.md": None, "x.png": None, "#top": None, "dir/": None, "http://[": None,
        "./b.MD": ("a/b.MD", None), "v1.2/n": ("a/v1.2/n.md", None), ".hid": ("a/.hid.md", None),
    }.items():
        assert N.markdown_target(dest, "a/n.md") == want, dest
