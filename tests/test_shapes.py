import pytest

from quillgraph.operators import shapes as S

SCHEMA = S.Schema(
    {
        "Person": S.NodeType("Person", [S.Property("age", "number", required=True), S.Property("tags", "list", many=True), S.Property("mood", values=["good", 'so "so"'], default="good"), S.Property("home page", "link")], [S.Edge("knows", targets=["Person"]), S.Edge("likes", required=True, many=False, targets=["Person", "Film"]), S.Edge("sees")]),
        "Film": S.NodeType("Film"),
    },
    {"knows": S.EdgeType("knows", ["Person"], ["Person", "Film"], [S.Property("since", "date")])},
)


def test_round_trip():
    text = S.to_turtle(SCHEMA)
    back = S.from_turtle(text)
    assert back == SCHEMA and S.to_turtle(back) == text


def test_foreign_shapes():
    got = S.from_turtle('@prefix sh: <http://www.w3.org/ns/shacl#> .\n@prefix ex: <http://x.org/v#> .\nex:S a sh:NodeShape ; sh:targetClass ex:Car ;\n sh:property [ sh:path ex:wheels ; sh:datatype <http://www.w3.org/2001/XMLSchema#integer> ; sh:minCount 1 ; sh:pattern "x" ] .\nex:Q a ex:Other .')
    assert got.types["Car"].properties == [S.Property("wheels", "number", required=True, many=True)]
    assert len(got.dropped) == 2
    with pytest.raises(ValueError):
        S.parse_turtle("ex:a ex:b ~")


def test_rules_and_labels():
    props, edges = SCHEMA.rules()
    assert [(p.name, p.required, p.many) for p in props] == [("age", True, False), ("tags", False, True), ("mood", False, False), ("home page", False, False)]
    assert [(e.type, e.least, e.most) for e in edges] == [("knows", 0, None), ("likes", 1, 1), ("sees", 0, None)]
    assert [p.name for p in SCHEMA.labels(["Film", "Person", "None"]).properties] == ["age", "tags", "mood", "home page"]
