"""Connected components of an edge table by alternating large and small stars.

Edges are pairs of long node ids. Each round points the neighbours of a node at the smallest id near it; neighbours are never
gathered in one row, so a node may have any number of them. A round is written to the shared folder, which cuts lineage. Ends when
a round changes nothing; the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionByName(rest).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that has an edge, except the smallest of each component, with that smallest node. Loops and repeats are ignored."""
    now = common.stash(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        last, now = now, common.stash(_small(_large(now)), "edges")
        common.discard(last)
        before, state = state, _state(now)
        if state == before:
            break
    return now
