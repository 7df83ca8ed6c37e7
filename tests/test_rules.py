"""Rules declared in notes: reading, merging, and findings over a graph."""

import pytest

from quillgraph.operators import rules as R
from quillgraph.sources.notes import notes_graph

SCHEMA = {
    "Types/Person.md": "---\nschema:\n  uri: foaf:Person\n  properties:\n    name: {required: true}\n    mood: {kind: text, values: [calm, 3, true]}\n    nick:\n      kind: list\n      uri: ex:nick\n  edges:\n    knows:\n      target: [Person, Robot]\n      required: true\n    owns: {many: false}\n---\n",
    "Types/All.md": '---\nschemas:\n  Robot:\n    properties: [model, {name: x, required: true}]\n    edges: [likes]\n  Person:\n    properties: {lost: {required: true}}\nedgeTypes:\n  likes:\n    from: Robot\n    to: [Thing]\n    properties:\n      why: {required: true, values: ["fun", "work"]}\nprefixes:\n  ex: https://e.x/\n  foaf: https://own/\n---\n',
    "Types/Zed.md": "---\nedgeTypes:\n  likes: {to: [Person]}\nprefixes:\n  ex: https://other/\n  foaf: https://own/\n---\n",
    "Types/bad.md": "---\nschemas: 3\nedgeTypes:\n  odd:\n    to: 4\n    uri: no:thing\n    properties:\n      p: {kind: shape}\n---\n",
    "Types/Empty.md": None,
    "Types/new.md": "---\ntgs: 2.1\n---\n",
    "Types/sub/No.md": "---\nschema:\n  properties: {a: text}\n---\n",
}
NOTES = {
    "ann.md": "---\ntype: Person\nname: Ann\nmood: 3\n---\nknows:: [[bob]]\nowns:: [[t]]\nowns:: [[u]]\n",
    "bob.md": "---\ntype: Person\nname: ''\nmood: [calm, wild]\n---\nhates:: [[ann]]\nknows:: [[t]]\nlikes:: [[t]] {why: fun}\n",
    "rob.md": "---\ntypes: [Robot, Person]\nx: 1\nname: R\n---\nlikes:: [[t]]\nlikes:: [[ann]] {why: play}\nknows:: [[lost]]\n",
    "t.md": "---\ntype: Thing\n---\n",
}


@pytest.fixture(scope="module")
def merged(spark):
    notes = spark.createDataFrame([*SCHEMA.items(), *NOTES.items()], "path string, text string")
    return R.merge(R.declarations(notes))


def test_declarations(merged):
    rows = {(r["kind"], r["owner"], r["name"]): r for r in merged.table.collect()}
    assert ("property", "Person", "lost") not in rows or rows["property", "Person", "lost"]["path"] == "Types/All.md"
    assert {n for k, _, n in rows if k == "type"} == {"Person", "Robot", "Empty"}
    # All.md comes before Person.md, so its Person wins.
    assert rows["type", None, "Person"]["path"] == "Types/All.md" and rows["property", "Person", "lost"]["required"]
    assert rows["edge", "Robot", "likes"]["targets"] is None and rows["edge_type", None, "likes"]["targets"] == ["Thing"]
    assert rows["edge_property", "likes", "why"]["values"] == ["fun", "work"]
    assert rows["type", None, "Robot"]["iri"] == "urn:tgs:Robot"


def test_findings_of_declarations(merged):
    got = {(r["code"], r["node"], r["detail"]) for r in merged.findings.collect()}
    assert got == {
        ("duplicate-declaration", "Types/Person.md", "type Person Types/All.md"),
        ("duplicate-declaration", "Types/Zed.md", "edge_type likes Types/All.md"),
        ("duplicate-declaration", "Types/Zed.md", "prefix ex Types/All.md"),
        ("invalid-declaration", "Types/bad.md", "schemas is no mapping"),
        ("invalid-declaration", "Types/bad.md", "to of odd is no name or list of names"),
        ("unknown-prefix", "Types/bad.md", "odd no:thing"),
        ("unknown-kind", "Types/bad.md", "odd.p"),
        ("unsupported-version", "Types/new.md", "2.1"),
    }


def test_identifiers(spark):
    note = "---\nschema:\n  uri: ex:A\nschemas:\n  B: {uri: 'https://b/#1'}\n  C: {uri: 'urn:c'}\n  D: {uri: plain}\n  E f: {}\nprefixes: {ex: 'https://e/', urn: 'https://own-urn/'}\n---\n"
    m = R.merge(R.declarations(spark.createDataFrame([("Types/A.md", note)], "path string, text string")))
    assert {r["name"]: r["iri"] for r in m.of("type").collect()} == {"A": "https://e/A", "B": "https://b/#1", "C": "https://own-urn/c", "D": "urn:tgs:D", "E f": "urn:tgs:E%20f"}
    assert [r["code"] for r in m.findings.collect()] == ["invalid-declaration"]


def test_findings_over_notes(spark):
    kept = {k: v for k, v in SCHEMA.items() if k != "Types/All.md"} | {"Types/zz.md": SCHEMA["Types/All.md"]}
    g = notes_graph(spark, spark.createDataFrame(list(NOTES.items()), "path string, text string"))
    rules = R.merge(R.declarations(spark.createDataFrame([*kept.items()], "path string, text string")))
    got = {tuple(r) for r in R.check_notes(g, rules).collect()}
    assert got == {
        ("error", "too-many-edges", "ann.md", "owns"),
        ("error", "missing-property", "bob.md", "name"),
        ("error", "unexpected-list", "bob.md", "mood"),
        ("error", "value-not-allowed", "bob.md", "wild"),
        ("error", "edge-not-allowed", "bob.md", "hates"),
        ("error", "edge-not-allowed", "bob.md", "likes"),
        ("warning", "wrong-target-type", "bob.md", "t.md"),
        ("warning", "wrong-target-type", "rob.md", "t.md"),  # Zed.md comes first: likes leads to persons
    }
    g.close()


def test_rules_of_edge_types(spark):
    g = notes_graph(spark, spark.createDataFrame(list(NOTES.items()), "path string, text string"))
    only = {"Types/All.md": SCHEMA["Types/All.md"]}
    rules = R.merge(R.declarations(spark.createDataFrame([*only.items()], "path string, text string")))
    got = {tuple(r) for r in R.check_notes(g, rules).collect()}
    assert got == {
        ("error", "missing-property", "ann.md", "lost"),
        ("error", "missing-property", "bob.md", "lost"),
        ("error", "missing-property", "rob.md", "lost"),
        ("error", "edge-not-allowed", "rob.md", "knows"),
        ("warning", "wrong-source-type", "bob.md", "t.md"),
        ("warning", "wrong-target-type", "rob.md", "ann.md"),
        ("error", "missing-edge-property", "rob.md", "why"),
        ("error", "edge-value-not-allowed", "rob.md", "play"),
    }
    none = R.merge(R.declarations(spark.createDataFrame([], "path string, text string")))
    assert R.check_notes(g, none).count() == 0 and none.findings.count() == 0
    g.close()
