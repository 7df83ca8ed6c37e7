"""Views of a graph: neighbourhoods, the densest part, unions of elements, retrieval around seeds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph import PropertyGraph


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage, if the session has a checkpoint folder: a round then reads what the last one wrote."""
    spark = df.sparkSession
    return df.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df


def _next_to(edges: DataFrame, front: DataFrame) -> DataFrame:
    """a (of front) and b: the ends of edges that touch the front. The edges are joined as they are; only what they reach is de-duplicated."""
    ids = front.select(F.col("id").alias("a"))
    out = edges.join(ids, F.col("source") == F.col("a")).select("a", F.col("target").alias("b"))
    into = edges.join(ids, F.col("target") == F.col("a")).select("a", F.col("source").alias("b"))
    return out.unionByName(into).filter("a <> b")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """id and distance of all nodes within depth edges of the seeds (id), in either direction."""
    seen = seeds.select("id", F.lit(0).alias("distance")).distinct()
    front = seen
    for d in range(1, depth + 1):
        reached = _next_to(edges, front).select(F.col("b").alias("id")).distinct()
        front = _cut(reached.join(seen, "id", "left_anti").select("id", F.lit(d).alias("distance")))
        seen = seen.unionByName(front)
    return seen


def keyed_neighbourhood(graph: PropertyGraph, label: str, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """id and distance of all nodes within depth edges of the seeds (key) of a label, in either direction.

    For graphs whose nodes have keys and whose edge tables lead from one label to one: a round reads only the tables that touch a label of the
    front, joins on keys, and looks for what is known label by label. Ids are made once, at the end.
    """
    tables = [t for ts in graph.edge_tables.values() for t in ts]
    if any(not t.keys or len(t.from_labels) != 1 or len(t.to_labels) != 1 for t in tables):
        raise ValueError("nodes without keys, or edge tables of several labels: use neighbourhood")
    front = {label: seeds.select(F.col("key").cast("long").alias("key"), F.lit(0).alias("distance")).distinct()}
    seen = dict(front)
    for d in range(1, depth + 1):
        reached: dict[str, list[DataFrame]] = {}
        for t in tables:
            ends = list(zip((t.from_labels[0], t.to_labels[0]), t.keys, strict=True))
            for (here, a), (there, b) in (ends, ends[::-1]):
                if here in front:
                    near = t.df.select(F.col(a).cast("long").alias("at"), F.col(b).cast("long").alias("to"))
                    reached.setdefault(there, []).append(near.join(front[here].select(F.col("key").alias("at")), "at").select(F.col("to").alias("key")))
        front = {}
        for there, parts in reached.items():
            new = reduce(DataFrame.unionByName, parts).distinct()
            new = new.join(seen[there].select("key"), "key", "left_anti") if there in seen else new
            front[there] = _cut(new.filter("key is not null").select("key", F.lit(d).alias("distance")))
        for there, new in front.items():
            seen[there] = seen[there].unionByName(new) if there in seen else new
    found = [graph.nodes([x], {}, {x}, False, True).join(rows, F.col("_key") == F.col("key")).select("id", "distance") for x, rows in seen.items()]
    return reduce(DataFrame.unionByName, found)


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree; an edge from a node to itself counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def densest(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of the highest degrees (ties by id), at most limit, and the edges between them."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(limit)
    ids = top.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return top, inner


def merge_elements(*frames: DataFrame) -> DataFrame:
    """The union by id; the first frame that has an id gives its row."""
    numbered = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    rest = [c for c in one.columns if c not in ("id", "_frame")]
    return one.groupBy("id").agg(*[F.min_by(F.struct(*rest), F.col("_frame")).alias("row")]).select("id", "row.*") if rest else one.select("id").distinct()


def backlinks(edges: DataFrame, node_id: str) -> DataFrame:
    """Edges into a node, by type and sign."""
    return edges.filter(F.col("target") == node_id).groupBy("type", "sign").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))


@dataclass
class Retrieval:
    """chunks: id, ordinal, text, score, distance and role (hit, neighbor), in order. edges: id, type, source, target and role (hit, connecting).
    truncated: one row that says whether neighbours, chunks or text were left out."""

    chunks: DataFrame
    edges: DataFrame
    truncated: DataFrame


def retrieve_with_edges(edges: DataFrame, scored: DataFrame, edge_hits: DataFrame, chunks: DataFrame, seeds: int = 5, depth: int = 1, neighbours: int = 8, per_node: int = 2, cap: int = 20, budget: int = 16_000) -> Retrieval:
    """As ``retrieve``, with hits among edges: both ends of the best ``seeds`` of edge_hits (id, score) are hits too.

    edges: id, type, source, target. Of a node's neighbours not yet seen the best ``neighbours`` are reached; each brings the edge that led to it,
    of several the first by the node it comes from and its id. A neighbour without a score counts as -1.
    """
    best_edges = edge_hits.orderBy(F.desc("score"), "id").limit(seeds).select("id")
    hit_edges = edges.join(best_edges, "id", "left_semi").select("id", "type", "source", "target", F.lit("hit").alias("role"))
    ends = hit_edges.select(F.explode(F.array("source", "target")).alias("id"))
    seen = _cut(scored.orderBy(F.desc("score"), "id").limit(seeds).select("id").unionByName(ends).distinct().select("id", F.lit(0).alias("distance")))
    front, led, more = seen, [], []
    order = Window.partitionBy("a").orderBy(F.desc("s"), "id")
    for d in range(1, depth + 1):
        at = front.select(F.col("id").alias("a"))
        pairs = [edges.join(at, F.col(here) == F.col("a")).select("a", F.col(there).alias("id"), F.struct(F.col("a").alias("from"), F.col("id").alias("edge"), "type", "source", "target").alias("e")) for here, there in (("source", "target"), ("target", "source"))]
        around = pairs[0].unionByName(pairs[1]).groupBy("a", "id").agg(F.min("e").alias("e")).join(seen, "id", "left_anti").join(scored.select("id", "score"), "id", "left").withColumn("s", F.coalesce("score", F.lit(-1.0)))
        ranked = _cut(around.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= neighbours + 1).select("id", "e", "k"))
        more.append(ranked.filter(F.col("k") > neighbours).select(F.lit(True).alias("t")))
        reached = ranked.filter(F.col("k") <= neighbours).groupBy("id").agg(F.min("e").alias("e"))
        led.append(reached.select(F.col("e.edge").alias("id"), "e.type", "e.source", "e.target", F.lit("connecting").alias("role")))
        front = reached.select("id", F.lit(d).alias("distance"))
        seen = seen.unionByName(front)
    whole = reduce(DataFrame.unionByName, [hit_edges, *(x.join(hit_edges, "id", "left_anti") for x in led)])
    own = Window.partitionBy("id").orderBy(F.desc("score"), "ordinal")
    best = chunks.join(seen, "id").withColumn("k", F.row_number().over(own)).filter(F.col("k") <= per_node).withColumn("b", F.max("score").over(Window.partitionBy("id")))
    places = ["distance", F.desc("b"), "id", F.desc("score"), "ordinal"]
    top = best.orderBy(*places).limit(cap + 1)
    run = Window.orderBy(*places)  # over cap + 1 rows
    counted = top.withColumns({"place": F.row_number().over(run), "upto": F.sum(F.length("text")).over(run.rowsBetween(Window.unboundedPreceding, 0))})
    fits = (F.col("place") <= cap) & (F.col("upto") <= budget)
    role = F.when(F.col("distance") == 0, "hit").otherwise("neighbor")
    kept = counted.filter(fits).orderBy("place").select("id", "ordinal", "text", "score", "distance", role.alias("role"))
    cut = reduce(DataFrame.unionByName, [*more, counted.filter(~fits).select(F.lit(True).alias("t"))]).agg((F.count(F.lit(1)) > 0).alias("truncated"))
    return Retrieval(kept, whole, cut)


def retrieve(edges: DataFrame, scored: DataFrame, chunks: DataFrame, seeds: int = 5, depth: int = 1, neighbours: int = 5, per_node: int = 2, cap: int = 20, budget: int = 16_000) -> DataFrame:
    """Chunks around the best nodes, for a language model to read.

    scored: id, score of nodes. chunks: id, ordinal, text, score. From the seeds, each node reached brings its best-scored neighbours, at most
    ``neighbours``, for ``depth`` rounds; each node gives its best chunks, at most ``per_node``; chunks are taken by distance and score, at
    most ``cap``, until one goes beyond ``budget`` characters. Every step is a top-k within a node, so the rows stay bounded.
    """
    seen = scored.orderBy(F.desc("score"), "id").limit(seeds).select("id", F.lit(0).alias("distance"))
    front = seen
    by_score = Window.partitionBy("a").orderBy(F.desc_nulls_last("score"), "id")
    for d in range(1, depth + 1):
        next_ = _next_to(edges, front).distinct().select("a", F.col("b").alias("id")).join(scored, "id", "left")
        front = next_.withColumn("k", F.row_number().over(by_score)).filter(F.col("k") <= neighbours).select("id").distinct().join(seen, "id", "left_anti").select("id", F.lit(d).alias("distance"))
        front = _cut(front)
        seen = seen.unionByName(front)
    own = Window.partitionBy("id").orderBy(F.desc("score"), "ordinal")
    picked = chunks.join(seen, "id").withColumn("k", F.row_number().over(own)).filter(F.col("k") <= per_node)
    top = picked.orderBy("distance", F.desc("score"), "id", "ordinal").limit(cap)
    run = Window.orderBy("distance", F.desc("score"), "id", "ordinal").rowsBetween(Window.unboundedPreceding, 0)  # over at most cap rows
    return top.withColumn("upto", F.sum(F.length("text")).over(run)).filter(F.col("upto") <= budget).select("id", "ordinal", "text", "score", "distance")
