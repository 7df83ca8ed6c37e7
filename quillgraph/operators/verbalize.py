"""Edges as sentences, for embedding and for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import spoken


def sentences(nodes: DataFrame, edges: DataFrame, props: list[str] = ()) -> DataFrame:
    """id and text such as ``Alice (Person) knows Bob (Person) - since 2020``. nodes: id, title, labels. edges: id, type, sign, source, target and props."""
    named = nodes.select("id", F.when(F.size("labels") > 0, F.concat("title", F.lit(" ("), F.concat_ws(", ", "labels"), F.lit(")"))).otherwise(F.col("title")).alias("name"))
    a, b = named.select(F.col("id").alias("source"), F.col("name").alias("a")), named.select(F.col("id").alias("target"), F.col("name").alias("b"))
    verb = F.concat(spoken(F.col("type")), F.when(F.col("sign") < 0, " (negative)").otherwise(""))
    shown = [F.when(F.col(p).isNotNull() & (F.col(p).cast("string") != ""), F.concat(F.lit("" if p == "label" else f"{p} "), F.col(p).cast("string"))) for p in props if p != "id"]
    tail = F.concat_ws(", ", *shown) if shown else F.lit("")
    out = edges.join(a, "source", "left").join(b, "target", "left")
    text = F.concat_ws(" ", F.coalesce("a", "source"), verb, F.coalesce("b", "target"))
    return out.select("id", F.concat(text, F.when(tail != "", F.concat(F.lit(" - "), tail)).otherwise("")).alias("text"))
