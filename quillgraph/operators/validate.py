"""Schema rules over nodes and edges: findings as rows. Rules are small driver-side declarations, each check is one join or filter."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class PropertyRule:
    label: str
    name: str
    required: bool = False
    many: bool = False
    values: tuple = ()


@dataclass
class EdgeRule:
    label: str
    type: str
    least: int = 0
    most: int | None = None
    targets: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    properties: tuple[PropertyRule, ...] = ()  # label is ignored


SEVERITIES = {"wrong-target-type": "warning", "wrong-source-type": "warning"}
FINDING = ["code", "node", "detail"]


def _finding(df: DataFrame, code: str, node: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), node.alias("node"), detail.cast("string").alias("detail"))


def property_findings(nodes: DataFrame, rules: list[PropertyRule]) -> DataFrame | None:
    """nodes: id, labels and property columns."""
    kinds = {f.name: f.dataType.typeName() for f in nodes.schema}
    out = []
    for r in rules:
        own = nodes.filter(F.array_contains("labels", r.label))
        if r.required:
            out.append(_finding(own.filter(F.col(r.name).isNull()) if r.name in kinds else own, "missing-property", F.col("id"), F.lit(r.name)))
        if r.name in kinds and not r.many and kinds[r.name] == "array":
            out.append(_finding(own.filter(F.col(r.name).isNotNull()), "unexpected-list", F.col("id"), F.lit(r.name)))
        if r.name in kinds and r.values:
            out.append(_finding(own.filter(F.col(r.name).isNotNull() & ~F.col(r.name).isin(*r.values)), "value-not-allowed", F.col("id"), F.col(r.name)))
    return reduce(DataFrame.unionByName, out) if out else None


def edge_findings(nodes: DataFrame, edges: DataFrame, rules: list[EdgeRule]) -> DataFrame:
    """nodes: id, labels, stub. edges: type, source, target. Types without a rule for a label aren't allowed from it."""
    labelled = nodes.select("id", "labels", "stub")
    sources = edges.join(labelled.select(F.col("id").alias("source"), F.col("labels").alias("from_labels")), "source")
    out = []
    for label in sorted({r.label for r in rules}):
        allowed = [r.type for r in rules if r.label == label]
        own = sources.filter(F.array_contains("from_labels", label))
        out.append(_finding(own.filter(~F.col("type").isin(*allowed)), "edge-not-allowed", F.col("source"), F.col("type")))
    for r in rules:
        own = nodes.filter(F.array_contains("labels", r.label)).select("id")
        if r.least or r.most is not None:
            n = edges.filter(F.col("type") == r.type).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
            counted = own.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
            if r.least:
                out.append(_finding(counted.filter(F.col("n") < r.least), "missing-edge", F.col("id"), F.lit(r.type)))
            if r.most is not None:
                out.append(_finding(counted.filter(F.col("n") > r.most), "too-many-edges", F.col("id"), F.lit(r.type)))
        if r.targets:
            ends = labelled.filter("not stub and size(labels) > 0").select(F.col("id").alias("target"), F.col("labels").alias("to_labels"))
            wrong = sources.filter((F.col("type") == r.type) & F.array_contains("from_labels", r.label)).join(ends, "target").filter(~F.arrays_overlap("to_labels", F.array(*[F.lit(t) for t in r.targets])))
            out.append(_finding(wrong, "wrong-target-type", F.col("source"), F.col("target")))
        if r.sources:  # edges of the type from elsewhere; what has no label isn't judged
            wrong = sources.filter((F.col("type") == r.type) & (F.size("from_labels") > 0) & ~F.arrays_overlap("from_labels", F.array(*[F.lit(t) for t in r.sources])))
            out.append(_finding(wrong, "wrong-source-type", F.col("source"), F.col("target")))
        for p in r.properties:
            own_edges = sources.filter((F.col("type") == r.type) & F.array_contains("from_labels", r.label))
            known = p.name in edges.columns
            if p.required:
                out.append(_finding(own_edges.filter(F.col(p.name).isNull()) if known else own_edges, "missing-edge-property", F.col("source"), F.lit(p.name)))
            if p.values and known:
                out.append(_finding(own_edges.filter(F.col(p.name).isNotNull() & ~F.col(p.name).isin(*p.values)), "edge-value-not-allowed", F.col("source"), F.col(p.name)))
    return reduce(DataFrame.unionByName, out)


def validate(nodes: DataFrame, edges: DataFrame, property_rules: list[PropertyRule], edge_rules: list[EdgeRule]) -> DataFrame:
    """All findings with their severity, errors first, then by node, code and detail."""
    parts = [f for f in (property_findings(nodes, property_rules), edge_findings(nodes, edges, edge_rules) if edge_rules else None) if f is not None]
    found = reduce(DataFrame.unionByName, parts).distinct()
    severity = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])[F.col("code")], F.lit("error"))
    return found.withColumn("severity", severity).orderBy("severity", "node", "code", "detail")
