"""Property graphs over DataFrames: a label or an edge type is a table with an id rule."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Columns of nodes and edges themselves; properties with these names are hidden by them.
RESERVED = {"id", "labels", "stub", "type", "sign", "source", "target"}


@dataclass
class NodeTable:
    """Nodes of one label. ``id``: string expression over df; the other columns are properties. more_labels: further labels of all its nodes."""

    df: DataFrame
    id: Column
    more_labels: tuple[str, ...] = ()
    label_column: str | None = None  # a column that holds one further label
    key: str | None = None  # a whole-number column that tells the nodes of this label apart as the id does

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema}


@dataclass
class EdgeTable:
    """Edges of one type. from_labels and to_labels: what the ends can be. single: no two edges share both ends, so the ordinal is 0."""

    df: DataFrame
    source: Column
    target: Column
    from_labels: tuple[str, ...]
    to_labels: tuple[str, ...]
    props: tuple[str, ...] = ()
    sign: Column | None = None
    single: bool = True
    complete: bool = True  # every end is a node: no stubs
    keys: tuple[str, str] | None = None  # the columns that hold the key of the source and of the target
    near: dict[str, DataFrame] = field(default_factory=dict)  # the same rows, stored by source or by target


@dataclass
class PropertyGraph:
    spark: SparkSession
    node_tables: dict[str, NodeTable] = field(default_factory=dict)
    edge_tables: dict[str, list[EdgeTable]] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()  # columns of edges that aren't among their properties
    kept: list[DataFrame] = field(default_factory=list)  # persisted for as long as the graph is used

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()

    @property
    def by_end(self) -> bool:
        """Whether some edges are stored by their ends."""
        return any(t.near for ts in self.edge_tables.values() for t in ts)

    def single(self, types: list[str]) -> bool:
        """Whether two nodes have one edge of these types at most."""
        tables = [t for x in types for t in self.edge_tables.get(x, ())]
        return len(tables) == 1 and tables[0].single

    def chain(self, types: list[str] | None, labels: set[str], sides: tuple[str, str], length: int) -> list[list[EdgeTable]] | None:
        """The tables that each step of a chain of edges from a node of these labels can come from, as far as keys tell labels apart."""
        tables = [t for name, ts in self.edge_tables.items() for t in ts if not types or name in types]
        out: list[list[EdgeTable]] = []
        for _ in range(length):
            out.append([t for t in tables if labels & set(t.from_labels if sides[0] == "source" else t.to_labels)])
            labels = {x for t in out[-1] for x in (t.to_labels if sides[1] == "target" else t.from_labels)}
        return out if all(t.keys for t in tables) and all(out) else None

    def native(self, types: list[str] | None, side: str, among: list[EdgeTable] | None = None) -> str | None:
        """The one label that this end of these edges has, if its nodes are told apart by a key: joins then need no ids."""
        labels = set()
        for name, tables in self.edge_tables.items():
            for t in tables if not types or name in types else ():
                if among is not None and not any(t is x for x in among):
                    continue
                labels |= set(t.from_labels if side == "source" else t.to_labels) if t.keys else {None, ""}
        label = labels.pop() if len(labels) == 1 else None
        return label if label in self.node_tables and self.node_tables[label].key else None

    def node_props(self, labels: list[str] | None = None) -> dict[str, T.DataType]:
        out: dict[str, T.DataType] = {}
        for label, t in self.node_tables.items():
            if not labels or label in labels or set(labels) & set(t.more_labels) or t.label_column:
                for k, v in t.props.items():
                    if k not in RESERVED - {"type", "sign", "source", "target"}:
                        out.setdefault(k, v)
        return out

    def edge_props(self, types: list[str] | None = None) -> dict[str, T.DataType]:
        out: dict[str, T.DataType] = {}
        for name, tables in self.edge_tables.items():
            if not types or name in types:
                for t in tables:
                    for p in t.props:
                        if p not in RESERVED:
                            out.setdefault(p, t.df.schema[p].dataType)
        return out

    def nodes(self, labels: list[str] | None, props: dict[str, T.DataType], among: set[str] | None = None, stubs: bool = True, key: bool = False) -> DataFrame:
        """id, labels, stub and the given properties of the nodes that have all labels. among: the only tables to look in. key: their key too."""
        parts = []
        for label, t in self.node_tables.items():
            own = (label, *t.more_labels)
            if among is not None and label not in among:
                continue
            missing = [x for x in labels or () if x not in own]
            if missing and not (t.label_column and len(missing) == 1):
                continue
            df = t.df.filter(F.col(t.label_column) == missing[0]) if missing else t.df
            names = F.array(*[F.lit(x) for x in own], *([F.col(t.label_column)] if t.label_column else []))
            has = t.props
            parts.append(df.select(t.id.alias("id"), names.alias("labels"), F.lit(False).alias("stub"), *((F.col(p) if p in has else F.lit(None)).cast(k).alias(p) for p, k in props.items()), *([F.col(t.key).cast("long").alias("_key")] if key else [])))
        if stubs and not labels and among is None and any(not t.complete for ts in self.edge_tables.values() for t in ts):
            nothing = F.array().cast("array<string>")
            parts.append(self.stubs().select("id", nothing.alias("labels"), F.lit(True).alias("stub"), *(F.lit(None).cast(k).alias(p) for p, k in props.items())))
        if not parts:
            schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("stub", T.BooleanType()), *(T.StructField(p, k) for p, k in props.items())])
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, parts)

    def stubs(self) -> DataFrame:
        """Ends of edges that no table has as a node, once each."""
        ends = [t.df.select(e.alias("id")) for ts in self.edge_tables.values() for t in ts if not t.complete for e in (t.source, t.target)]
        known = reduce(DataFrame.unionByName, [t.df.select(t.id.alias("id")) for t in self.node_tables.values()])
        return reduce(DataFrame.unionByName, ends).filter("id is not null").distinct().join(known, "id", "left_anti")

    def edges(self, types: list[str] | None, props: dict[str, T.DataType], with_id: bool = True, keys: tuple[str, ...] = (), near: str | None = None, among: list[EdgeTable] | None = None) -> DataFrame:
        """id, type, sign, source, target and the given properties of the edges of these types (None: all). keys: ends of which the key is given too.
        near: the end that they are looked up by, for edges that are stored by their ends. among: the only tables to look in.

        The id is source#type#target#ordinal; it is only worked out where it is asked for."""
        parts = []
        for name, tables in self.edge_tables.items():
            if types and name not in types:
                continue
            for t in tables:
                if among is not None and not any(t is x for x in among):
                    continue
                sign = F.lit(1) if t.sign is None else t.sign
                out = t.near.get(near, t.df).select(t.source.alias("source"), t.target.alias("target"), sign.cast("int").alias("sign"), *(F.col(p) for p in t.props), *(F.col(t.keys[side == "target"]).cast("long").alias(f"{side}_key") for side in keys))
                ordinal = F.lit("0")
                if with_id and not t.single:
                    out = out.withColumn("_n", F.row_number().over(Window.partitionBy("source", "target").orderBy(*t.props)) - 1)
                    ordinal = F.col("_n").cast("string")
                has = set(t.props)
                id_ = F.concat("source", F.lit(f"#{name}#"), "target", F.lit("#"), ordinal) if with_id else F.lit(None).cast("string")
                parts.append(out.select(id_.alias("id"), F.lit(name).alias("type"), "sign", "source", "target", *((F.col(p) if p in has else F.lit(None)).cast(k).alias(p) for p, k in props.items()), *(f"{side}_key" for side in keys)))
        if not parts:
            schema = T.StructType([T.StructField(c, T.IntegerType() if c == "sign" else T.StringType()) for c in ("id", "type", "sign", "source", "target")] + [T.StructField(p, k) for p, k in props.items()])
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, parts)

    def ends(self, types: list[str] | None, side: str) -> tuple[set[str], bool]:
        """Labels that an end of these edges can have, and whether every end is a node."""
        labels: set[str] = set()
        complete = True
        for name, tables in self.edge_tables.items():
            if not types or name in types:
                for t in tables:
                    labels |= set(t.from_labels if side == "source" else t.to_labels)
                    complete &= t.complete
        return labels, complete
