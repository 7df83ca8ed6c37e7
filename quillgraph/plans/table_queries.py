"""Queries of the search, view, validation and sync operators over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search, validate, views
from ..operators.postings import Postings
from ..sources.adjacency import store_edges
from ..sources.star import star_graph
from ..sources.store import scratch_folder
from ..streaming import sync
from .compile import run

TERMS = "stupid things over nation"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25(_read(spark, sf_dir, "documents"), "doc_id", TERMS, {"body": "text"})
    return hits.select("id", F.round("score", 6).alias("score"))


def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored postings."""
    index = Postings(spark, scratch_folder(spark, "postings"), ("body",))
    index.add(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")))
    return index.search(TERMS).select("id", F.round("score", 6).alias("score"))


def stored_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops over edges that are stored by their ends."""
    kept = store_edges(star_graph(spark, sf_dir), ["PLACED", "CONTAINS"], folder=scratch_folder(spark, "edges"))
    return run(kept, "MATCH (c:Customer)-[:PLACED]->(o) WITH c.c_mktsegment AS s, o MATCH (o)-[r:CONTAINS]->(p) RETURN s AS s, count(*) AS n, round(sum(r.l_quantity)) AS q").df


_STEM = "CASE WHEN length(w) > 5 AND ends_with(w, 'ing') THEN left(w, length(w) - 3) WHEN length(w) > 4 AND (ends_with(w, 'ed') OR ends_with(w, 'es')) THEN left(w, length(w) - 2) WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"
_BM25 = f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
    tok AS (SELECT doc_id, {_STEM} AS t FROM words WHERE length(w) > 1 AND w NOT IN ('the','a','an','and','or','of','to','in','on','for','is','are','it','as','by','with','be','at','this','that')),
    len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1),
    avgl AS (SELECT sum(n) / (SELECT count(*) FROM documents) AS a FROM len),
    tf AS (SELECT doc_id, t, count(*) AS tf FROM tok WHERE t IN ('stupid', 'thing', 'over', 'nation') GROUP BY 1, 2),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1)
    SELECT tf.doc_id AS id, round(sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len.n / (SELECT a FROM avgl)))), 6) AS score
    FROM tf JOIN df ON tf.t = df.t JOIN len ON len.doc_id = tf.doc_id GROUP BY 1 ORDER BY score DESC, id LIMIT 10"""


def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").first()["embedding"]
    return search.vector_rank(vectors, "vec_id", "embedding", query, 20).select("id", F.round("score", 5).alias("score"))


_COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"
_VEC = f"SELECT e.vec_id AS id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def vec_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").first()["embedding"]
    return search.node_scores(vectors, "label", "embedding", query).select("label", F.round("score", 5).alias("score"))


def vec_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").first()["embedding"]
    return search.node_scores(vectors, "label", "embedding", query, "pooled").select("label", F.round("score", 4).alias("score"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of documents: by length and by id."""
    docs = _read(spark, sf_dir, "documents")
    a = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    b = docs.select(F.col("doc_id").alias("id"), (-F.col("doc_id")).cast("double").alias("score"))
    return search.fuse([a, b], 20, depth=50).select("id", F.round("score", 8).alias("score"), "sources")


def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.keyed_neighbourhood(star_graph(spark, sf_dir), "Region", spark.createDataFrame([(1,)], "key long"), 2)


def neighbourhood_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from ids alone."""
    edges = star_graph(spark, sf_dir).edges(None, {}, with_id=False)
    return views.neighbourhood(edges, spark.createDataFrame([("Region:1",)], "id string"), 2)


def degree_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = star_graph(spark, sf_dir).edges(None, {}, with_id=False)
    _, inner = views.densest(edges, 300)
    return inner.select("source", "type", "target")


def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = star_graph(spark, sf_dir).edges(["IN_NATION"], {}, with_id=False)
    return views.backlinks(edges, "Nation:3").select("type", "sign", "n", F.size("sources").alias("k"))


def retrieve_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations around the two best regions, with their names as chunks."""
    g = star_graph(spark, sf_dir)
    nodes = g.nodes(["Nation"], {"n_name": g.node_props(["Nation"])["n_name"]}).select("id", F.col("n_name").alias("name")).unionByName(g.nodes(["Region"], {"r_name": g.node_props(["Region"])["r_name"]}).select("id", F.col("r_name").alias("name")))
    scored = nodes.select("id", F.length("name").cast("double").alias("score"))
    chunks = nodes.select("id", F.lit(0).alias("ordinal"), F.col("name").alias("text"), F.length("name").cast("double").alias("score"))
    return views.retrieve(g.edges(["IN_REGION"], {}, with_id=False), scored.filter(F.startswith("id", F.lit("Region"))).unionByName(scored.filter(F.startswith("id", F.lit("Nation")))), chunks, seeds=3, neighbours=3, cap=8, budget=60).select("id", "text", "distance")


def validate_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    kinds = g.node_props(["Customer"])
    nodes = g.nodes(["Customer"], {"c_mktsegment": kinds["c_mktsegment"]})
    return validate.property_findings(nodes, [validate.PropertyRule("Customer", "c_phone", required=True), validate.PropertyRule("Customer", "c_mktsegment", values=("BUILDING", "MACHINERY"))])


def validate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    nodes = g.nodes(["Customer"], {}).unionByName(g.nodes(["Nation"], {})).unionByName(g.nodes(["Order"], {}))
    edges = g.edges(["IN_NATION", "PLACED"], {}, with_id=False)
    return validate.edge_findings(nodes, edges, [validate.EdgeRule("Customer", "PLACED", least=1, most=20, targets=("Order",)), validate.EdgeRule("Customer", "LIKES")])


def diff_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    moved = F.when(F.col("o_orderstatus") == "P", -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))  # under another key
    before = orders
    after = orders.withColumns({"o_orderkey": moved, "o_totalprice": F.col("o_totalprice") + (F.col("o_orderstatus") == "O").cast("int")})
    return sync.differences(before, after, "o_orderkey")


def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.tumbling_counts(_read(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over events that a stream has landed, delivered twice."""
    schema, folder = _read(spark, sf_dir, "events").schema, scratch_folder(spark, "events")
    twice = sync.file_stream(spark, sf_dir, "events.parquet", schema)
    sync.land(twice.unionByName(twice), folder, "event_id")
    return sync.tumbling_counts(spark.read.parquet(f"{folder}/rows")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def nearest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest_name(_read(spark, sf_dir, "nation"), "n_name", "NATION_7x")


_DAILY = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
_NEAR = "SELECT 'Region:1' AS id, 0 AS distance UNION ALL SELECT 'Nation:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'Customer:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'Supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1"

ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "bm25_top": (bm25_top, _BM25),
    "bm25_stored": (bm25_stored, _BM25),
    "stored_hops": (stored_hops, "SELECT c_mktsegment AS s, count(*) AS n, CAST(floor(sum(l_quantity) + 0.5) AS BIGINT) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"),
    "vec_topk": (vec_topk, f"SELECT id, round(score, 5) AS score FROM (SELECT * FROM ({_VEC}) WHERE score > 0 ORDER BY score DESC, id LIMIT 20)"),
    "vec_best": (vec_best, f"SELECT label, round(max(score), 5) AS score FROM ({_VEC.replace('e.vec_id AS id', 'e.label')}) GROUP BY label"),
    "vec_pooled": (vec_pooled, """WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS x FROM embeddings),
        p AS (SELECT label, d, sum(x) AS x FROM u GROUP BY 1, 2), q AS (SELECT generate_subscripts(embedding, 1) AS d, unnest(CAST(embedding AS DOUBLE[])) AS y FROM embeddings WHERE vec_id = 0)
        SELECT label, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 4) AS score FROM p JOIN q ON p.d = q.d GROUP BY label"""),
    "rrf_fuse": (rrf_fuse, """WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS r FROM documents)
        SELECT id, round(sum(1.0 / (60 + r)), 8) AS score, count(*) AS sources FROM (SELECT * FROM a WHERE r <= 50 UNION ALL SELECT * FROM b WHERE r <= 50) GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 20"""),
    "neighbourhood": (neighbourhood, _NEAR),
    "neighbourhood_by_id": (neighbourhood_by_id, _NEAR),
    "degree_subgraph": (degree_subgraph, """WITH e AS (SELECT 'Nation:' || n_nationkey AS source, 'IN_REGION' AS type, 'Region:' || n_regionkey AS target FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'IN_NATION', 'Nation:' || c_nationkey FROM customer UNION ALL SELECT 'Supplier:' || s_suppkey, 'IN_NATION', 'Nation:' || s_nationkey FROM supplier
        UNION ALL SELECT 'Customer:' || o_custkey, 'PLACED', 'Order:' || o_orderkey FROM orders UNION ALL SELECT 'Order:' || l_orderkey, 'CONTAINS', 'Part:' || l_partkey FROM lineitem UNION ALL SELECT 'Order:' || l_orderkey, 'SUPPLIED_BY', 'Supplier:' || l_suppkey FROM lineitem
        UNION ALL SELECT DISTINCT 'Part:' || l_partkey, 'OF', 'Supplier:' || l_suppkey FROM lineitem UNION ALL SELECT 'User:' || user_id, 'DID', 'Event:' || event_id FROM events),
        d AS (SELECT id FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id ORDER BY count(*) DESC, id LIMIT 300) SELECT * FROM e WHERE source IN (SELECT id FROM d) AND target IN (SELECT id FROM d)"""),
    "backlinks": (backlinks, "SELECT 'IN_NATION' AS type, 1 AS sign, count(*) AS n, count(*) AS k FROM (SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)"),
    "retrieve_bfs": (retrieve_bfs, """WITH s AS (SELECT id, name, length(name) AS score FROM (SELECT 'Nation:' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'Region:' || r_regionkey, r_name FROM region)),
        e AS (SELECT 'Nation:' || n_nationkey AS a, 'Region:' || n_regionkey AS b FROM nation), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        seeds AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 3),
        near AS (SELECT s.id, row_number() OVER (PARTITION BY two.a ORDER BY s.score DESC, s.id) AS k FROM two JOIN seeds ON two.a = seeds.id JOIN s ON s.id = two.b),
        seen AS (SELECT id, 0 AS distance FROM seeds UNION ALL SELECT DISTINCT id, 1 FROM near WHERE k <= 3 AND id NOT IN (SELECT id FROM seeds)),
        best AS (SELECT s.id, s.name AS text, s.score, distance FROM seen JOIN s ON seen.id = s.id ORDER BY distance, s.score DESC, s.id LIMIT 8)
        SELECT id, text, distance FROM (SELECT *, sum(length(text)) OVER (ORDER BY distance, score DESC, id) AS upto FROM best) WHERE upto <= 60"""),
    "validate_properties": (validate_properties, "SELECT 'missing-property' AS code, 'Customer:' || c_custkey AS node, 'c_phone' AS detail FROM customer UNION ALL SELECT 'value-not-allowed', 'Customer:' || c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "validate_edges": (validate_edges, """WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
        SELECT 'edge-not-allowed' AS code, 'Customer:' || c_custkey AS node, 'IN_NATION' AS detail FROM customer UNION ALL SELECT 'missing-edge', 'Customer:' || c_custkey, 'PLACED' FROM n WHERE n < 1 UNION ALL SELECT 'too-many-edges', 'Customer:' || c_custkey, 'PLACED' FROM n WHERE n > 20"""),
    "diff_sync": (diff_sync, "SELECT o_orderkey, 'update' AS change FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'delete' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey <> 0 UNION ALL SELECT -o_orderkey, 'insert' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey <> 0"),
    "stream_window": (stream_window, _DAILY),
    "stream_landed": (stream_landed, _DAILY),
    "nearest_name": (nearest_name, "SELECT n_name AS name, levenshtein(n_name, 'NATION_7x') AS distance FROM nation ORDER BY 2, 1 LIMIT 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in ALL.items() if s}
