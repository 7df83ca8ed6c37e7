"""Shapes of plans, and patterns of variable length that start from either side."""

import pytest
from pyspark.sql import functions as F

from quillgraph.plans import compile as C
from quillgraph.plans.compile import run
from quillgraph.plans.star_queries import QUERIES
from quillgraph.sources.graph import EdgeTable, NodeTable, PropertyGraph
from quillgraph.sources.star import star_graph

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    return star_graph(spark, DIR)


def value(graph, query):
    return run(graph, query).df.first()[0]


def test_trails_from_either_side(graph, spark):
    nations = spark.read.parquet(f"{DIR}/nation.parquet").filter("n_regionkey = 1")
    customers, suppliers = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("customer", "supplier"))
    inside = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).count() + suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"]).count()
    want = inside + nations.count()
    for query in (
        "MATCH (r:Region {r_regionkey: 1})<-[:IN_REGION|IN_NATION*1..2]-(x) RETURN count(*) AS n",
        "MATCH (x)-[:IN_REGION|IN_NATION*1..2]->(r:Region {r_regionkey: 1}) RETURN count(*) AS n",
        "MATCH (x)-[:IN_REGION|IN_NATION*1..2]->(r:Region) WHERE r.r_regionkey = 1 RETURN count(*) AS n",
        "MATCH (r:Region {r_regionkey: 1}) MATCH (r)<-[:IN_REGION|IN_NATION*1..2]-(x) RETURN count(*) AS n",
        "MATCH (r:Region {r_regionkey: 1}) WITH r MATCH (x)-[:IN_REGION|IN_NATION*1..2]->(r) RETURN count(x) AS n",
        "MATCH (r:Region) WHERE r.r_regionkey = 1 OPTIONAL MATCH (r)<-[:IN_REGION|IN_NATION*1..2]-(x) RETURN count(x) AS n",
    ):
        assert value(graph, query) == want, query


def test_order_of_trails_does_not_depend_on_the_side(graph):
    for a, b in (("(c:Customer {c_custkey: 5})", "(x)"), ("(c)", "(x:Region {r_regionkey: 0})")):
        df = run(graph, f"MATCH p = {a}-[r:IN_NATION|IN_REGION*2]->{b} RETURN length(p) AS k, r AS r, id(c) AS c, id(x) AS x").df
        rows = df.collect()
        assert rows
        for row in rows:
            assert row["k"] == 2 and row["r"][0]["source"] == row["c"] and row["r"][1]["target"] == row["x"] and row["r"][0]["target"] == row["r"][1]["source"]


def plan_of(graph, query):
    return run(graph, query).df._jdf.queryExecution().optimizedPlan().toString()


def joins(plan):
    return [line for line in plan.split("\n") if "Join" in line]


def below(plan, upper, lower):
    """Whether some line with ``lower`` stands in the subtree of the first with ``upper``."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if upper in line)
    depth = lines[at].index(upper)
    for line in lines[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            return False
        if lower in line:
            return True
    return False


def test_a_known_start_is_filtered_before_the_hops(graph):
    plan = plan_of(graph, "MATCH (c:Customer {c_custkey: 1})-[:IN_NATION|IN_REGION*1..3]->(x) RETURN id(x) AS id")
    filters = [line for line in plan.split("\n") if "Filter" in line and "c_custkey" in line and "= 1)" in line]
    assert len(filters) == 1 and below(plan, "UnionLoop", filters[0].strip(" :+-"))


@pytest.mark.parametrize("query", ["MATCH (a:Region)-[r:IN_REGION|IN_NATION*1..3]-(x) RETURN count(*) AS n", "MATCH (x)-[r:IN_REGION|IN_NATION*1..3]-(a:Region) RETURN count(*) AS n"])
def test_trails_start_from_the_nodes_of_a_label(graph, spark, query):
    """One level starts from the label's own table, on whichever side it stands: the other tables are read once, as edges."""
    nation, customer, supplier = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("nation", "customer", "supplier"))
    inside = customer.select("c_nationkey").unionAll(supplier.select("s_nationkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).count()
    # a region's nations, then their people; nothing is left for a third edge
    assert value(graph, query) == nation.count() + inside
    lines = plan_of(graph, query).split("\n")
    first = next(i for i, x in enumerate(lines) if "UnionLoop" in x)
    start = next(x for x in lines[first:] if "Relation" in x)
    assert "r_regionkey" in start and not any("Aggregate" in x for x in lines[first:]), lines


@pytest.mark.parametrize("hops, want", [("*1..2", 1), ("*1..6", 1), ("*", 1), ("*0..4", 1), ("*3", 3), ("*1", 1), ("*0..1", 1)])
def test_a_level_is_one_join(graph, hops, want):
    """Levels are those of one loop, or a chain where only one length counts."""
    plan = plan_of(graph, f"MATCH (n:Nation {{n_nationkey: 1}})-[:IN_REGION{hops}]-(x) RETURN size(labels(n)) AS k")
    assert len(joins(plan)) == want, plan


def test_rows_so_far_are_joined_to_the_first_hop(graph):
    plan = plan_of(graph, "MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10 MATCH (c)-[:PLACED]->(o)-[:CONTAINS]->(p) RETURN count(*) AS n")
    assert len(joins(plan)) == 2
    inner = joins(plan)[1]
    assert below(plan, inner.strip(" :+-"), "GlobalLimit") and not below(plan, inner.strip(" :+-"), "l_partkey"), plan


def test_keys_go_along(graph):
    """Where a node's label is known, later hops are joined on its key: no ids are made."""
    for query in (
        "MATCH (c:Customer)-[:PLACED]->(o) WITH o ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 10 MATCH (o)-[:CONTAINS]->(p) RETURN count(*) AS n",
        "MATCH (n:Nation)-[:IN_REGION]->(r) WITH r, count(n) AS k MATCH (r)<-[:IN_REGION]-(m) RETURN sum(k) AS k",
    ):
        assert "concat(" not in plan_of(graph, query)


@pytest.mark.parametrize(
    "query",
    [
        "MATCH (c:Customer) WITH c ORDER BY c.c_custkey LIMIT 7 MATCH (o)<-[:PLACED]-(c) RETURN count(o) AS n",
        "MATCH (c:Customer) WITH c ORDER BY c.c_custkey LIMIT 7 MATCH (x)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN count(o) AS n",
        "MATCH (c:Customer) WITH c ORDER BY c.c_custkey LIMIT 7 MATCH (x)<-[:IN_NATION]-(c), (c)-[:PLACED]->(o) RETURN count(o) AS n",
        "MATCH (c:Customer) WITH c ORDER BY c.c_custkey LIMIT 7 MATCH (n:Nation), (c)-[:IN_NATION]->(n), (c)-[:PLACED]->(o) RETURN count(o) AS n",
        "MATCH (c:Customer) WITH c ORDER BY c.c_custkey LIMIT 7 MATCH (c)-[:IN_NATION]->(n)<-[:IN_NATION]-(c2), (c)-[:PLACED]->(o) WHERE c2.c_custkey = 6 OR c2.c_custkey <> 6 RETURN count(DISTINCT id(o)) AS n",
        "MATCH (c:Customer) WITH c ORDER BY c.c_custkey LIMIT 7 MATCH p = (o)<-[r:PLACED]-(c) WHERE type(r) = 'PLACED' AND length(p) = 1 RETURN count(p) AS n",
    ],
)
def test_growth_from_few_rows(graph, spark, query):
    orders = spark.read.parquet(f"{DIR}/orders.parquet").filter("o_custkey <= 6").count()
    assert value(graph, query) == orders


def test_bound_nodes_keep_their_conditions(graph, spark):
    customers = spark.read.parquet(f"{DIR}/customer.parquet")
    want = customers.filter("c_custkey < 20 and c_mktsegment = 'BUILDING'").count()
    query = "MATCH (c:Customer) WHERE c.c_custkey < 20 WITH c ORDER BY c.c_custkey LIMIT 100 MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[:IN_NATION]->(n) RETURN count(*) AS n"
    assert value(graph, query) == want
    assert value(graph, query.replace("MATCH (c:Customer {", "MATCH (c:Supplier {")) == 0


def test_paths_end_where_there_is_none_longer(graph):
    short = run(graph, "MATCH (c:Customer)-[:IN_NATION|IN_REGION*]->(x) RETURN count(*) AS n")
    assert short.notices == []
    cut = run(graph, "MATCH (c:Customer)-[:IN_NATION|IN_REGION*]->(x) RETURN count(*) AS n", max_depth=1)
    assert len(cut.notices) == 1 and "1 edges" in cut.notices[0]
    assert cut.df.first()["n"] * 2 == short.df.first()["n"]


def test_counting_edges_needs_no_ordinals(graph):
    plan = run(graph, QUERIES["parallel_edges"][0]).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_distinct_takes_the_first_row_of_the_order(graph):
    rows = run(graph, "MATCH (c:Customer)-[:PLACED]->(o) RETURN DISTINCT c.c_mktsegment AS s ORDER BY o.o_totalprice DESC").df.collect()
    best = run(graph, "MATCH (c:Customer)-[:PLACED]->(o) RETURN c.c_mktsegment AS s, max(o.o_totalprice) AS p ORDER BY p DESC").df.collect()
    assert [r["s"] for r in rows] == [r["s"] for r in best]


def few_links(spark):
    """Nodes of two labels and edges of two types, parallel ones among them."""
    nodes = spark.createDataFrame([(k, k % 3) for k in range(12)], "k long, m long")
    links = spark.createDataFrame([(a, b, w) for a in range(12) for b in range(4) for w in range((a * 7 + b * 5) % 4)], "s long, t long, w long")
    tables = {"N": NodeTable(nodes.filter("k < 8"), F.concat(F.lit("N:"), "k")), "M": NodeTable(nodes.filter("k >= 8"), F.concat(F.lit("N:"), "k"))}
    ends = (F.concat(F.lit("N:"), "s"), F.concat(F.lit("N:"), "t"), ("N", "M"), ("N",), ("w",))
    return PropertyGraph(spark, tables, {"L": [EdgeTable(links.filter("w < 2"), *ends, single=False)], "E": [EdgeTable(links.filter("w >= 2"), *ends, single=False)]})


def without_counting(monkeypatch, make):
    with monkeypatch.context() as m:
        m.setattr(C.Compiler, "only_counted", lambda self, clauses: None)
        return sorted(map(str, make().df.collect()))


@pytest.mark.parametrize("query", [
    "MATCH (a:N)-[:L]->(n) MATCH (b)-[:L]->(n) RETURN count(*) AS k",
    "MATCH (a:N)-[:L]->(n) MATCH (b:M)-[:E]->(n) MATCH (n)-[:L]->(c) RETURN n.m AS m, count(*) AS k",
    "MATCH (a:N)-[r:L]->(n) MATCH (b {m: n.m})-[:E]->(n) RETURN a.m AS m, count(*) + 1 AS k ORDER BY count(*), m",
    "MATCH (a:N {k: 99})-[:L]->(n) MATCH (b)-[:L]->(n) RETURN count(*) AS k",
    "MATCH (a:N) MATCH (b:M) WHERE b.m > 0 RETURN count(*) AS k",
    "MATCH (a)-[r:L]->(n) MATCH (b)-[:L]->(n) WHERE r.w > 0 RETURN count(*) AS k",
])
def test_alike_rows_are_counted_before_the_next_match(spark, monkeypatch, query):
    g = few_links(spark)
    assert sorted(map(str, C.run(g, query).df.collect())) == without_counting(monkeypatch, lambda: C.run(g, query))


def test_a_second_match_meets_alike_rows_once(spark):
    df = C.run(few_links(spark), "MATCH (a:N)-[:L]->(n) MATCH (b)-[:L]->(n) RETURN count(*) AS k").df
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") >= 2


@pytest.mark.parametrize("query", [
    "MATCH (a:N)-[:L]->(n)<-[:L]-(b:N) RETURN id(n) AS n, count(*) AS k",
    "MATCH (a:N)-[:L]->(n)<-[:L]-(b) RETURN count(*) AS k",
    "MATCH (a:N)-[:L]->(n)<-[:E]-(b:M) RETURN n.m AS m, count(*) AS k",
    "MATCH (a)<-[:L|E]-(n)-[:L]->(b) WHERE n.m > 0 RETURN n.k AS n, count(*) AS k",
    "MATCH (a {m: 1})-[:L]->(n)-[:L {w: 0}]->(b) RETURN n.k AS n, n.m AS m, count(*) AS k",
    "MATCH (a)-->(n)<--(b:M) MATCH (n)-[:L]->(c) RETURN n.m AS n, count(*) AS k",
    "MATCH (a:M)-[:L]->(n)<-[:L]-(a) RETURN id(n) AS n, count(*) AS k",
])
def test_pairs_that_meet_in_a_node_are_counted(spark, monkeypatch, query):
    g = few_links(spark)
    assert sorted(map(str, C.run(g, query).df.collect())) == without_counting(monkeypatch, lambda: C.run(g, query))


def test_pairs_that_meet_in_a_node_are_not_made(spark):
    df = C.run(few_links(spark), "MATCH (a)-[:L]->(n)<-[:L]-(b) RETURN id(n) AS n, count(*) AS k").df
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_cycle_ends_with_the_edge_that_makes_no_rows(graph, spark):
    """o-p-s-o is joined by its orders, and closed by the one OF that a part and a supplier have."""
    paths = lambda q: C.parse(q).parts[0][0].paths
    c = C.Compiler(graph)
    turned = c.turned(paths(QUERIES["cycle"][0])[0], {})
    assert [r.types for r in turned.rels] == [["SUPPLIED_BY"], ["CONTAINS"], ["OF"]] and turned.nodes[0].var == turned.nodes[-1].var == "s" and turned.nodes[1].labels == ["Order"]
    for kept in ("MATCH (o)-[:CONTAINS]->(p)-[:OF]->(s)<-[:SUPPLIED_BY]-(x) RETURN count(*) AS n", "MATCH (s)<-[:SUPPLIED_BY]-(o)-[:CONTAINS]->(p)-[:OF]->(s) RETURN count(*) AS n"):
        path = paths(kept)[0]
        assert c.turned(path, {}) == path
    lines = [(r["l_orderkey"], r["l_partkey"], r["l_suppkey"]) for r in spark.read.parquet(f"{DIR}/lineitem.parquet").collect()]
    of, by_order = {(p, s) for _, p, s in lines}, {}
    for o, p, s in lines:
        by_order.setdefault(o, []).append((p, s))
    want = sum((p, s) in of for each in by_order.values() for p, _ in each for _, s in each)
    for query in (QUERIES["cycle"][0], "MATCH (o:Order)-[:CONTAINS]->()-[:OF]->()<-[:SUPPLIED_BY]-(o) RETURN count(*) AS n", "MATCH (p)-[:OF]->(s)<-[:SUPPLIED_BY]-(o)-[r:CONTAINS]->(p) RETURN count(r) AS n"):
        assert value(graph, query) == want


def test_a_chain_of_different_tables_works_out_no_edge_ids(graph, spark):
    df = run(graph, QUERIES["rel_elements"][0]).df
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    assert {r["f"]: r["n"] for r in df.collect()} == {r["l_returnflag"]: r["count"] for r in lines}
