"""Edges stored by their ends: the same rows, and no exchange of edges in a hop."""

import uuid

import pytest
from pyspark.sql import functions as F

from quillgraph.plans.compile import run
from quillgraph.sources.adjacency import drop_edges, open_edges, store_edges
from quillgraph.sources.graph import EdgeTable, NodeTable, PropertyGraph
from quillgraph.sources.star import star_graph

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    return star_graph(spark, DIR)


@pytest.fixture(scope="module")
def kept(spark, plain):
    name = f"t_{uuid.uuid4().hex}"
    yield store_edges(plain, ["PLACED", "CONTAINS", "SUPPLIED_BY"], name, 8), name
    drop_edges(plain, name)


QUERIES = [
    "MATCH (c:Customer)-[:PLACED]->(o)-[r:CONTAINS]->(p) RETURN c.c_custkey AS c, count(p) AS n, sum(r.l_quantity) AS q",
    "MATCH (s:Supplier)<-[:SUPPLIED_BY]-(o)<-[:PLACED]-(c) RETURN s.s_suppkey AS s, count(DISTINCT c) AS n",
    "MATCH (p)<-[:CONTAINS]-(o) RETURN p.p_partkey AS p, count(o) AS n",
    "MATCH (c:Customer {c_custkey: 7})-[:PLACED|CONTAINS*1..2]->(x) RETURN count(x) AS n",
    "MATCH (o)-[r:CONTAINS]-(p:Part) RETURN count(DISTINCT id(r)) AS n",
]


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows(plain, kept, query):
    assert sorted(map(tuple, run(kept[0], query).df.collect())) == sorted(map(tuple, run(plain, query).df.collect()))


def exchanged(plan, column):
    """Whether some exchange stands over the scan of this column's table."""
    lines, found = plan.split("\n"), False
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            for x in lines[i + 1 :]:
                if len(x) - len(x.lstrip(" :+-*()0123456789")) <= depth:
                    break
                found |= "FileScan" in x and column in x
                if "Join" in x:
                    break
    return found


def test_edges_are_not_shuffled(spark, plain, kept):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        query = "MATCH (c:Customer)-[:PLACED]->(o) WITH o MATCH (o)-[r:CONTAINS]->(p) RETURN sum(r.l_quantity) AS q"
        before, after = (run(g, query).df for g in (plain, kept[0]))
        assert before.first() == after.first()
        assert exchanged(before._jdf.queryExecution().executedPlan().toString(), "l_orderkey")
        plan = after._jdf.queryExecution().executedPlan().toString()
        assert not exchanged(plan, "l_orderkey") and "Bucketed: true" in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_opened_again(plain, kept):
    again = open_edges(plain, kept[1])
    assert again.by_end and not again.edge_tables["IN_REGION"][0].near
    assert run(again, QUERIES[1]).df.count() == run(plain, QUERIES[1]).df.count()


def test_edges_with_ids_only(spark):
    """Without keys the ids are the buckets' columns; an empty table and nulls at an end too."""
    name = f"t_{uuid.uuid4().hex}"
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", None, 3), ("b", "c", 4), ("b", "c", 4)], "s string, t string, w int")
    g = PropertyGraph(spark, {"N": NodeTable(nodes, F.col("k"))}, {"L": [EdgeTable(links, F.col("s"), F.col("t"), ("N",), ("N",), ("w",), single=False)], "E": [EdgeTable(links.limit(0), F.col("s"), F.col("t"), ("N",), ("N",))]})
    kept = store_edges(g, None, name, 3)
    for query in ("MATCH (a)-[r:L]->(b) RETURN id(a) AS a, id(b) AS b, sum(r.w) AS w, count(DISTINCT r) AS n", "MATCH (a {k: 'a'})-[:L*1..3]->(b) RETURN id(b) AS b, count(*) AS n", "MATCH (a)-[r:E]->(b) RETURN count(r) AS n"):
        assert sorted(map(str, run(kept, query).df.collect())) == sorted(map(str, run(g, query).df.collect()))
    drop_edges(kept, name)
