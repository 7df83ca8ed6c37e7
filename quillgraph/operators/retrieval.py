"""Search over sections, nodes and edges: search documents, embeddings with a cache, hybrid ranking, citations, and fuzzy location of names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, stem, words
from ..plans.compile import Result, run
from ..sources.graph import PropertyGraph
from .search import bm25, cosine, fuse, unit, vector_rank

# Characters of a context value, ids that a query is given, and the share of a name that may differ.
VALUE_CHARS, MOST_HITS, LEAST_LIKE = 80, 100, 0.4


def search_documents(sections: DataFrame, bodies: DataFrame) -> DataFrame:
    """id, title (heading and the path to it), summary (lead) and body of sections. bodies: id, body."""
    tail = F.regexp_replace(F.col("id"), r"^[^#]*#", "")
    return sections.select("id", F.concat_ws(" ", "heading", F.translate(tail, "#/", "  ")).alias("title"), F.col("lead").alias("summary")).join(bodies.select("id", "body"), "id", "left")


def chunk_context(title: Column, labels: Column, props: dict[str, Column]) -> Column:
    """``Title (Label, Label)`` and a ``name: value`` line for each property that is set, values cut to VALUE_CHARS."""
    head = F.concat(title, F.when(F.size(labels) > 0, F.concat(F.lit(" ("), F.array_join(labels, ", "), F.lit(")"))).otherwise(F.lit("")))
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), F.left(v.cast("string"), F.lit(VALUE_CHARS)))) for k, v in sorted(props.items())]
    return F.concat_ws("\n", head, *lines)


def embed_hashed(texts: DataFrame, dims: int = 64) -> DataFrame:
    """hash, vector: a deterministic embedding that needs no model. Each token adds to the dimension its hash names, with the hash's sign."""
    token = texts.select("hash", F.explode(words(F.coalesce("text", F.lit("")))).alias("w")).filter((F.length("w") > 1) & ~F.col("w").isin(*STOP_WORDS)).select("hash", F.xxhash64(stem(F.col("w"))).alias("h"))
    by_dim = token.groupBy("hash", F.pmod("h", F.lit(dims)).cast("int").alias("d")).agg(F.sum(F.when(F.pmod(F.shiftright("h", 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("x"))
    made = by_dim.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"))  # at most dims entries
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("m")[i.cast("int")], F.lit(0.0)))
    return texts.select("hash").distinct().join(made, "hash", "left").select("hash", unit(F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dims)).otherwise(dense)).alias("vector"))


def vectors_for(texts: DataFrame, cache: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] = embed_hashed) -> tuple[DataFrame, DataFrame]:
    """texts (id, text) with their vectors, and the cache (hash, vector) with what was missing. Each different text is embedded once."""
    hashed = texts.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    wanted = hashed.select("hash", "text").dropDuplicates(["hash"])
    if cache is not None:
        wanted = wanted.join(cache, "hash", "left_anti")
    new = embed(wanted)
    full = new if cache is None else cache.unionByName(new)
    return hashed.join(full, "hash").select("id", "text", "vector"), full


def search_nodes(nodes: DataFrame, chunks: DataFrame, query: list[float], label: str | None = None, limit: int = 10) -> DataFrame:
    """id, score, labels, title and the best chunk as citation. nodes: id, labels, title; chunks: id, heading, text, vector."""
    own = nodes if label is None else nodes.filter(F.array_contains("labels", label))
    scored = chunks.join(own.select("id", "labels", "title"), "id").withColumn("score", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])))
    best = scored.groupBy("id").agg(F.max("score").alias("score"), F.max_by(F.struct("heading", "text"), F.struct("score", "text")).alias("citation"), F.any_value("labels").alias("labels"), F.any_value("title").alias("title"))
    return best.filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def search_edges(sentences: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """id, score and text of the edges whose sentences are nearest. sentences: id, text, vector."""
    hits = vector_rank(sentences, "id", "vector", query, limit)
    return hits.join(sentences.select("id", "text"), "id").orderBy(F.desc("score"), "id")


def then(graph: PropertyGraph, hits: DataFrame, query: str, params: dict | None = None) -> Result:
    """Runs a graph query with the ids of hits (id, score), at most MOST_HITS, as ``$hits``."""
    ids = [r["id"] for r in hits.orderBy(F.desc("score"), "id").select("id").limit(MOST_HITS).collect()]
    return run(graph, query, {**(params or {}), "hits": ids})


def hybrid(docs: DataFrame, query: str, fields: dict[str, str], vectors: DataFrame | None = None, vector: list[float] | None = None, limit: int = 10, each: int = 50) -> tuple[DataFrame, list[str]]:
    """id and score by words and vectors fused, and notices: without vectors the ranking is by words alone."""
    lexical = bm25(docs, "id", query, fields, each)
    if vectors is None or vector is None:
        return lexical.orderBy(F.desc("score"), "id").limit(limit), ["no vectors: ranked by words alone"]
    return fuse([lexical, vector_rank(vectors, "id", "vector", vector, each)], limit, depth=each).select("id", "score"), []


def locate(sections: DataFrame, wanted: str, limit: int = 10) -> DataFrame:
    """id, tier and distance of the sections that a name may mean, from the first tier that has any: 0 the id, 1 the file's stem and the path in it,
    2 a heading, 3 the parts of the name in order within the id's, 4 a heading or id of which at most LEAST_LIKE of the longer differs."""
    name = F.lit(wanted.strip().lower())
    whole = F.lower("id")
    stem_id = F.regexp_replace(F.regexp_replace(whole, r"^[^#]*/", ""), r"\.md(?=#|$)", "")
    parts, asked = F.split(whole, "[#/]"), F.split(name, "[#/]")
    met = F.aggregate(parts, F.lit(0), lambda i, p: F.when((i < F.size(asked)) & (F.get(asked, i) == p), i + 1).otherwise(i))
    far = F.least(*(F.levenshtein(c, name) / F.greatest(F.length(c), F.length(name)) for c in (F.lower("heading"), whole)))
    tier = F.when(whole == name, 0).when(stem_id == name, 1).when(F.lower("heading") == name, 2).when(met == F.size(asked), 3).when(far <= LEAST_LIKE, 4)
    fits = sections.select("id", tier.alias("tier"), F.when(tier == 4, F.round(far, 6)).otherwise(0.0).alias("distance")).filter("tier is not null")
    first = fits.agg(F.min("tier").alias("first"))
    return fits.join(F.broadcast(first), F.col("tier") == F.col("first")).select("id", "tier", "distance").orderBy("distance", "id").limit(limit)


def list_edges(edges: DataFrame, types: list[str] | None = None, source: str | None = None, target: str | None = None, sign: int | None = None) -> DataFrame:
    """Edges by filters, in order of source, type, target and id."""
    tests = [F.col("type").isin(*types)] * bool(types) + [F.col(c) == v for c, v in (("source", source), ("target", target), ("sign", sign)) if v is not None]
    return reduce(DataFrame.filter, tests, edges).orderBy("source", "type", "target", "id")
