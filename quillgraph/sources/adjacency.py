"""Edges stored by their ends.

An edge table is written twice, in buckets by its source and by its target, sorted in each. A hop from rows that are dealt out by the same end is
then a merge of buckets: the edges, the large side, are neither shuffled nor sorted, however often they are walked. The rows of an end stay
in one bucket, so its number is that of the shuffle's partitions or more; AQE splits none of them, so an end that holds most edges is better
left to a graph that isn't stored.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import EdgeTable, PropertyGraph

SIDES = ("source", "target")


def _bucketed(df: DataFrame, by: str, name: str, buckets: int, folder: str | None) -> DataFrame:
    """df as a table in buckets; dealt out the same way before, so that each bucket is one file."""
    writer = df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(by).mode("overwrite")
    (writer.option("path", f"{folder}/{name}") if folder else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def stored(t: EdgeTable, name: str, buckets: int, folder: str | None = None) -> EdgeTable:
    """t with its rows stored by both ends: by their keys where it has them, else by ids, which are then columns."""
    if t.keys:
        df = t.df.withColumns({k: F.col(k).cast("long") for k in set(t.keys)})
        return replace(t, df=df, near={side: _bucketed(df, key, f"{name}_by_{side}", buckets, folder) for side, key in zip(SIDES, t.keys, strict=True)})
    df = t.df.withColumns({"_source": t.source, "_target": t.target})
    near = {side: _bucketed(df, f"_{side}", f"{name}_by_{side}", buckets, folder) for side in SIDES}
    return replace(t, df=df, source=F.col("_source"), target=F.col("_target"), near=near)


def store_edges(graph: PropertyGraph, types: list[str] | None = None, name: str | None = None, buckets: int | None = None, folder: str | None = None) -> PropertyGraph:
    """The graph with the edges of these types (None: all) in tables ``name_type_n_by_end`` of the session's catalog, which ``drop_edges`` drops.
    folder: where their files go, if not in the catalog's own folder."""
    spark = graph.spark
    name, buckets = name or f"edges_{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = {kind: [stored(t, f"{name}_{kind.lower()}_{i}", buckets, folder) if not types or kind in types else t for i, t in enumerate(ts)] for kind, ts in graph.edge_tables.items()}
    return replace(graph, edge_tables=tables)


def open_edges(graph: PropertyGraph, name: str) -> PropertyGraph:
    """The graph with the edges that ``store_edges`` wrote under this name; types that it didn't write are as they were."""
    spark = graph.spark

    def opened(t: EdgeTable, table: str) -> EdgeTable:
        if not all(spark.catalog.tableExists(f"{table}_by_{side}") for side in SIDES):
            return t
        near = {side: spark.table(f"{table}_by_{side}") for side in SIDES}
        return replace(t, df=near["source"], near=near) if t.keys else replace(t, df=near["source"], source=F.col("_source"), target=F.col("_target"), near=near)

    return replace(graph, edge_tables={kind: [opened(t, f"{name}_{kind.lower()}_{i}") for i, t in enumerate(ts)] for kind, ts in graph.edge_tables.items()})


def drop_edges(graph: PropertyGraph, name: str) -> None:
    for kind, ts in graph.edge_tables.items():
        for i in range(len(ts)):
            for side in SIDES:
                graph.spark.sql(f"DROP TABLE IF EXISTS {name}_{kind.lower()}_{i}_by_{side}")
