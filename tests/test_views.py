"""Neighbourhoods by keys and retrieval with edge hits, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import views
from quillgraph.sources.star import star_graph


@pytest.mark.parametrize("label, key, depth", [("Nation", 3, 3), ("Part", 7, 2), ("Event", 5, 2), ("Customer", 999_999, 2)])
def test_neighbourhood_by_keys(spark, label, key, depth):
    g = star_graph(spark, "/root/testdata/sf0.001")
    seeds = spark.createDataFrame([(key,)], "key long")
    got = {tuple(r) for r in views.keyed_neighbourhood(g, label, seeds, depth).collect()}
    want = {tuple(r) for r in views.neighbourhood(g.edges(None, {}, with_id=False), spark.createDataFrame([(f"{label}:{key}",)], "id string"), depth).collect()}
    assert got == (want if key < 999 else set())


def plain(edges, scored, edge_hits, chunks, seeds, depth, neighbours, per_node, cap, budget):
    by_id, score = {e[0]: e for e in edges}, dict(scored)
    top = sorted(scored, key=lambda x: (-x[1], x[0]))[:seeds]
    hits = [by_id[i] for i, _ in sorted(edge_hits, key=lambda x: (-x[1], x[0]))[:seeds] if i in by_id]
    seen = {i: 0 for i, _ in top} | {n: 0 for e in hits for n in e[2:4]}
    out, cut, front = {e[0]: (*e, "hit") for e in hits}, False, list(seen)
    for d in range(1, depth + 1):
        reached: dict = {}
        for a in front:
            around: dict = {}
            for e in edges:
                for here, there in ((e[2], e[3]), (e[3], e[2])):
                    if here == a and there not in seen:
                        around[there] = min(around.get(there, e), e)
            ranked = sorted(around, key=lambda i: (-score.get(i, -1.0), i))
            cut |= len(ranked) > neighbours
            for i in ranked[:neighbours]:
                reached[i] = min(reached.get(i, (a, around[i])), (a, around[i]))
        for i, (_, e) in reached.items():
            seen[i] = d
            out.setdefault(e[0], (*e, "connecting"))
        front = list(reached)
    own = {i: sorted((c for c in chunks if c[0] == i), key=lambda c: (-c[3], c[1]))[:per_node] for i in seen}
    order = sorted((i for i in seen if own[i]), key=lambda i: (seen[i], -own[i][0][3], i))
    kept, size = [], 0
    for c in [c for i in order for c in own[i]]:
        if len(kept) == cap or size + len(c[2]) > budget:
            cut = True
            break
        kept.append((*c, seen[c[0]], "hit" if seen[c[0]] == 0 else "neighbor"))
        size += len(c[2])
    return kept, set(out.values()), cut


@pytest.mark.parametrize("seed", range(4))
def test_retrieval_with_edge_hits(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(14)]
    edges = [(f"e{i:02d}", rng.choice("xy"), rng.choice(nodes), rng.choice(nodes)) for i in range(20)]
    scored = [(n, rng.randrange(100) / 100) for n in nodes if rng.random() < 0.8]
    edge_hits = [(e[0], rng.randrange(50) / 50) for e in edges if rng.random() < 0.5] + [("gone", 0.99)]
    chunks = [(n, k, "t" * rng.randrange(1, 30), rng.randrange(100) / 100) for n in nodes for k in range(rng.randrange(4))]
    limits = [(2, 1, 8, 2, 20, 16_000), (2, 2, 2, 1, 5, 70), (1, 2, 1, 2, 20, 200), (3, 0, 2, 2, 3, 1000)][seed]
    frames = [spark.createDataFrame(edges, "id string, type string, source string, target string"), spark.createDataFrame(scored, "id string, score double"), spark.createDataFrame(edge_hits, "id string, score double"), spark.createDataFrame(chunks, "id string, ordinal int, text string, score double")]
    got = views.retrieve_with_edges(*frames, *limits)
    kept, led, cut = plain(edges, scored, [h for h in edge_hits], chunks, *limits)
    assert [tuple(r) for r in got.chunks.collect()] == kept
    assert {tuple(r) for r in got.edges.collect()} == led
    assert got.truncated.first()["truncated"] == cut
    assert got.chunks.filter(F.col("role") == "hit").count() == sum(c[-1] == "hit" for c in kept)
