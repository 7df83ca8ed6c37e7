import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.operators import embeds, wire
from quillgraph.plans.compile import run
from quillgraph.sources.notes import notes_graph


def test_branching_ids():
    assert ids.sibling("1a", {"1b"}) == "1c" and ids.sibling("1z", set()) == "1aa" and ids.sibling("3", {"4"}) == "5"
    assert ids.child("1", set()) == "1a" and ids.child("1a", {"1a1"}) == "1a2" and ids.root({"2a", "10", "x"}) == "11"
    with pytest.raises(ValueError):
        ids.segments("a1")


def test_orders_and_uuids(spark):
    df = spark.createDataFrame([(x,) for x in ("10", "2", "1b", "1a1", "1a", "1", "1aa")], "id string")
    assert [r["id"] for r in df.orderBy(ids.branching_key(F.col("id"))).collect()] == ["1", "1a", "1a1", "1b", "1aa", "2", "10"]
    r = spark.sql("select timestamp'2026-01-12 15:30:20' as t").select(ids.uuid7(F.col("t"), F.lit("f" * 32)).alias("u"), ids.timestamp_id(F.col("t")).alias("i")).first()
    assert r["u"][14] == "7" and r["u"][19] == "b" and len(r["u"]) == 36 and r["i"] == "202601121530"


def test_embeds_and_wire(spark):
    notes = spark.createDataFrame([("a.md", "---\ntype: P\n---\nknows:: [[b]] {id: e1}\nlikes:: [[b]]\n-likes:: [[b]]\n{{edge: e1}} {{edge: [[a]] -likes-> b . x}} `{{edge: no}}`\n{{edge: a --likes-> b}}\n{{edge: a -hates-> b}} {{edge: bad id}}\n"), ("b.md", "")], "path string, text string")
    g = notes_graph(spark, notes)
    found = embeds.embeds(notes)
    assert found.count() == 5 and found.filter("error is not null").count() == 1
    edges = g.edges(None, {"line": g.edge_props()["line"]})
    got = sorted((r["line"], r["edge"] or "", r["matches"]) for r in embeds.resolve_embeds(found, edges, notes.select("path")).collect())
    assert got == [(6, "a.md#likes#b.md#0", 2), (6, "e1", 1), (7, "a.md#likes#b.md#1", 1), (8, "", 0)]
    r = run(g, "MATCH (a:P)-[r:knows]->(b) RETURN a, r, 1 AS n, null AS z")
    row = json.loads(wire.rows(r).first()["row"])
    assert [row[0]["_type"], row[0]["id"], row[1]["_type"], row[1]["id"], row[2], row[3]] == ["node", "a.md", "relationship", "e1", 1, None]
    back = wire.read(wire.rows(r)).orderBy("place").collect()
    assert [(x["kind"], x["id"]) for x in back] == [("node", "a.md"), ("relationship", "e1"), ("scalar", None), ("scalar", None)]
    assert [c["kind"] for c in wire.columns(r)] == ["node", "relationship", "scalar", "scalar"]
