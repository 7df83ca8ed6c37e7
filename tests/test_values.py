"""Values of several types, and elements of paths and lists."""

import pytest
from pyspark.sql import functions as F

from quillgraph.plans.compile import run
from quillgraph.plans.lexer import CypherError
from quillgraph.sources.notes import notes_graph
from quillgraph.sources.star import star_graph

DIR = "/root/testdata/sf0.001"
NOTES = [
    ("a.md", "---\ntype: Thing\nage: 31\nmark: true\ntags: [1, x, true]\n---\nknows:: [[b]] {since: 2020}\n"),
    ("b.md", "---\ntype: Thing\nage: old\nmark: 5\ntags: [z]\n---\nknows:: [[c]] {since: spring}\n"),
    ("c.md", "---\ntype: Thing\nage: [1, 2]\nmark: five\n---\nknows:: [[a]]\n"),
    ("d.md", "---\ntype: Thing\nage: true\nmark: 4.5\n---\n"),
    ("e.md", "---\ntype: Thing\n---\n"),
    ("f.md", "---\ntype: Thing\nage: 7\ntags:\n  - \n  - q\n---\n"),
]


@pytest.fixture(scope="module")
def notes(spark):
    g = notes_graph(spark, spark.createDataFrame(NOTES, "path string, text string"))
    yield g
    g.close()


@pytest.fixture(scope="module")
def star(spark):
    return star_graph(spark, DIR)


def rows(graph, query):
    return [tuple(r) for r in run(graph, query).df.collect()]


def test_nothing_is_lost(notes):
    found = run(notes, "MATCH (n:Thing) RETURN n.path AS p, n.age AS v ORDER BY p")
    assert [tuple(r) for r in found.df.collect()] == [("a.md", "31"), ("b.md", '"old"'), ("c.md", "[1,2]"), ("d.md", "true"), ("e.md", None), ("f.md", "7")]
    assert found.json == {"v"}


def test_total_order(notes):
    up = [r[0] for r in rows(notes, "MATCH (n) RETURN n.path AS p ORDER BY n.age, p")]
    assert up == ["c.md", "b.md", "d.md", "f.md", "a.md", "e.md"]  # list, text, truth, numbers, null
    assert [r[0] for r in rows(notes, "MATCH (n) RETURN n.path AS p ORDER BY n.age DESC, p")] == up[::-1]
    assert rows(notes, "MATCH (n) RETURN min(n.age) AS a, max(n.age) AS b, count(DISTINCT n.age) AS k, count(n.age) AS c") == [("[1,2]", "31", 5, 5)]
    assert rows(notes, "MATCH (n) WHERE n.mark > 1 RETURN n.path AS p ORDER BY p") == [("b.md",), ("d.md",)]


def test_equality_of_several_types(notes):
    assert rows(notes, "MATCH (n {age: 31}) RETURN n.path AS p") == [("a.md",)]
    assert rows(notes, "MATCH (n {age: 'old'}) RETURN n.path AS p") == [("b.md",)]
    assert rows(notes, "MATCH (n) WHERE n.age = true OR n.age IN [7, 'x'] RETURN n.path AS p ORDER BY p") == [("d.md",), ("f.md",)]
    assert rows(notes, "MATCH (n) WHERE n.age <> 31 RETURN count(*) AS k") == [(4,)]
    assert rows(notes, "MATCH (n) WHERE n.age STARTS WITH 'ol' RETURN n.path AS p") == [("b.md",)]
    assert rows(notes, "MATCH (n) WHERE n.path = 'a.md' RETURN n.age + 1 AS k, toString(n.age) AS s, n.age + '!' AS t") == [(32.0, "31", "31!")]
    assert rows(notes, "MATCH (n) WHERE n.age = n.age RETURN count(*) AS k") == [(5,)]


def test_a_number_is_needed(notes):
    with pytest.raises(Exception, match="needs numbers"):
        rows(notes, "MATCH (n) RETURN sum(n.age) AS s")


def test_lists_of_several_types(notes, star):
    assert rows(notes, "MATCH (n) WHERE n.tags IS NOT NULL RETURN n.path AS p, n.tags AS t, n.tags[0] AS f, size(n.tags) AS k ORDER BY p") == [
        ("a.md", ["1", '"x"', "true"], "1", 3),
        ("b.md", ['"z"'], '"z"', 1),
        ("f.md", [None, '"q"'], None, 2),
    ]
    assert rows(star, "MATCH (r:Region {r_regionkey: 1}) RETURN [1, 'a', true, null][1] AS a, [1, 'a'] + true AS b, coalesce(null, r.r_regionkey, 'x') AS c, 'a' IN [1, 'a'] AS d") == [('"a"', ["1", '"a"', "true"], "1", True)]
    assert rows(star, "MATCH (r:Region) RETURN collect(DISTINCT [1, r.r_name][0]) AS c") == [(["1"],)]


def test_elements_of_paths_and_lists(star, spark):
    nations = {r["n_nationkey"]: r for r in spark.read.parquet(f"{DIR}/nation.parquet").collect()}
    regions = {r["r_regionkey"]: r["r_name"] for r in spark.read.parquet(f"{DIR}/region.parquet").collect()}
    got = rows(star, "MATCH p = (n:Nation)-[:IN_REGION]->(r) RETURN n.n_nationkey AS k, nodes(p)[0].n_name AS a, last(nodes(p)).r_name AS b, nodes(p)[7].n_name AS c, head(relationships(p)).type AS t")
    assert sorted(got) == sorted((k, n["n_name"], regions[n["n_regionkey"]], None, "IN_REGION") for k, n in nations.items())
    got = rows(star, "MATCH (o:Order)-[r:CONTAINS*1..1]->(p) RETURN r[0].l_returnflag AS f, count(*) AS n, sum(r[0].l_quantity) AS q")
    want = spark.read.parquet(f"{DIR}/lineitem.parquet").groupBy("l_returnflag").agg(F.count("*"), F.sum("l_quantity")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got = rows(star, "MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.n_nationkey AS k, collect(n)[0].n_name AS a, head(collect(n)).n_regionkey AS b")
    assert all(nations[k]["n_name"] == a and nations[k]["n_regionkey"] == b for k, a, b in got) and got
    got = rows(star, "MATCH p = (n:Nation)-[:IN_REGION]->(r) WHERE nodes(p)[1].r_name = 'ASIA' OR nodes(p)[1].r_regionkey = 0 RETURN count(*) AS n")
    assert got == [(sum(regions[n["n_regionkey"]] == "ASIA" or n["n_regionkey"] == 0 for n in nations.values()),)]
    got = rows(star, "MATCH p = (n:Nation)-[:IN_REGION]->(r) WITH nodes(p)[1] AS x, n WHERE x.r_regionkey = 2 RETURN x.r_name AS a, x:Region AS b, labels(x) AS l, id(x) AS i, count(n) AS k")
    assert got == [(regions[2], True, ["Region"], "Region:2", sum(n["n_regionkey"] == 2 for n in nations.values()))]
    got = rows(star, "MATCH p = (c:Customer {c_custkey: 3})-[:PLACED]->(o)-[:CONTAINS]->(x) RETURN head(relationships(p)).o_totalprice AS a, relationships(p)[1].l_quantity AS b, o.o_totalprice AS t")
    assert got and all(a == t and b for a, b, t in got)


def test_errors_are_the_language_s(star):
    for query in ("MATCH p = (n:Nation)-[:IN_REGION]->(r) RETURN keys(nodes(p)[0]) AS k", "MATCH (n:Nation) RETURN [n, 1] AS l", "MATCH (n:Nation) RETURN n.n_name[0] AS l"):
        with pytest.raises(CypherError):
            run(star, query)


def test_recorded_keys(notes):
    assert rows(notes, "MATCH (n) WHERE n.path = 'a.md' RETURN keys(n) AS k, n.type AS t") == [(["type", "age", "mark", "tags", "path", "title"], "Thing")]
    assert sorted(map(str, rows(notes, "MATCH ()-[r:knows]->() RETURN keys(r) AS k, r.since AS s"))) == sorted(map(str, [(["since"], "2020"), (["since"], '"spring"'), ([], None)]))


def test_collect_keeps_the_order_of_rows(star, spark):
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = rows(star, "MATCH (n:Nation)-[:IN_REGION]->(r) WITH n, r ORDER BY n.n_nationkey DESC WITH n.n_nationkey AS k, r RETURN r.r_regionkey AS r, collect(k) AS l ORDER BY r")
        assert all(k == sorted(k, reverse=True) for _, k in got) and sum(len(k) for _, k in got) == 25
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = rows(star, "MATCH (n:Nation)-[:IN_REGION]->(r) WITH n, r ORDER BY r.r_name, n.n_nationkey DESC MATCH (s:Supplier)-[:IN_NATION]->(n) WITH collect(DISTINCT n.n_nationkey) AS l RETURN l AS l")
    keys = spark.read.parquet(f"{DIR}/nation.parquet").join(spark.read.parquet(f"{DIR}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    with_supplier = keys.join(spark.read.parquet(f"{DIR}/supplier.parquet"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    assert got == [([r["n_nationkey"] for r in with_supplier.orderBy("r_name", F.desc("n_nationkey")).collect()],)]
    assert rows(star, "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier {s_suppkey: 3}) WITH s.s_name AS s, n ORDER BY s, n.n_nationkey RETURN size(collect(s)) AS k, collect(n.n_nationkey)[1] AS f") == [(1, 0 if spark.read.parquet(f"{DIR}/supplier.parquet").filter("s_suppkey = 3").first()["s_nationkey"] else 1)]
