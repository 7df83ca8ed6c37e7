"""Embedded edges in texts: ``{{edge: Source -type-> Target . property}}`` or ``{{edge: id}}``, resolved against a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import marks
from ..sources.notes import resolve_links
from ..sources.sections import by_text

SCHEMA = "path string, line int, id string, source string, type string, sign int, target string, prop string, error string"


def _property(body: str) -> tuple[str, str | None]:
    """Splits `` . name`` off the end."""
    head, dot, tail = body.rpartition(".")
    name = tail.strip()
    if dot and head[-1:].isspace() and name and marks.name_end(name, 0) == len(name):
        return head.strip(), name
    return body, None


def _arrow(body: str) -> tuple[str, int | None, str, str] | None:
    """(source, sign, type, target) of ``source -type-> target``; the type may have a sign before it."""
    at = body.find("->")
    while at >= 0:
        space = max(body.rfind(" ", 0, at), body.rfind("\t", 0, at))
        arrow = body[space + 1 : at]  # - and the type
        sign = arrow[1:2] if arrow[1:2] in ("+", "-") else ""
        kind = arrow[1 + len(sign) :]
        if space > 0 and arrow.startswith("-") and kind and marks.name_end(kind, 0) == len(kind) and body[at + 2 : at + 3].isspace():
            return body[:space].strip(), {"-": -1, "+": 1}.get(sign), kind, body[at + 2 :].strip()
        at = body.find("->", at + 1)
    return None


def _unlinked(name: str) -> str:
    return name[2:-2].strip() if name.startswith("[[") and name.endswith("]]") else name


def parse_embed(inner: str) -> tuple:
    """(id, source, type, sign, target, prop, error)"""
    body, prop = _property(inner.strip())

    def bad(why: str) -> tuple:
        return (None, None, None, None, None, prop, why)

    if not body:
        return bad("the embed names no edge")
    if "->" not in body:
        return bad("white space in an edge id") if len(body.split()) > 1 else (body, None, None, None, None, prop, None)
    found = _arrow(body)
    if not found:
        return bad("not of the form: source -type-> target")
    source, sign, kind, target = _unlinked(found[0]), found[1], found[2], _unlinked(found[3])
    return (None, source, kind, sign, target, prop, None) if source and target else bad("an end of the edge is empty")


def find_embeds(path: str, text: str) -> list[tuple]:
    out = []
    for n, line in marks.outside_fences(x.removesuffix("\r") for x in text.split("\n")):
        for part in marks.blank_code(line).split("{{")[1:]:
            inner, closed, _ = part.partition("}}")
            word, colon, rest = inner.partition(":")
            if closed and colon and word.strip() == "edge" and not {"{", "}"} & set(inner):
                out.append((path, n, *parse_embed(rest)))
    return out


def embeds(notes: DataFrame) -> DataFrame:
    return by_text(notes, SCHEMA, find_embeds)


def resolve_embeds(found: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """path, line, edge (null: unresolved), matches. edges: id, type, sign, source, target, line. Of several, the first by line is meant."""
    good = found.filter("error is null").withColumn("_n", F.monotonically_increasing_id())
    keyed = good.select("path", "line", "_n", F.struct("id", "source", "type", "sign", "target").alias("w"))
    e = edges.select(F.col("id").alias("e_id"), F.col("type").alias("e_type"), F.col("sign").alias("e_sign"), F.col("source").alias("e_source"), F.col("target").alias("e_target"), F.col("line").alias("e_line"))
    by_id = keyed.filter("w.id is not null").join(e, F.col("w.id") == F.col("e_id"), "left").select("path", "line", F.col("e_id").alias("edge"), F.when(F.col("e_id").isNotNull(), 1).otherwise(0).alias("matches"))
    ends = keyed.filter("w.id is null").select("path", "line", "_n", F.col("w.source").alias("a"), F.col("w.target").alias("b"), F.col("w.type").alias("type"), F.col("w.sign").alias("sign"))
    links = ends.select("path", F.explode(F.array("a", "b")).alias("target")).distinct()
    known = resolve_links(links, paths).select(F.col("path").alias("l_path"), F.col("target").alias("link"), F.coalesce("to", "target").alias("node"))
    one = ends.join(known.withColumnRenamed("node", "from_node"), (F.col("path") == F.col("l_path")) & (F.col("a") == F.col("link"))).drop("l_path", "link")
    two = one.join(known.withColumnRenamed("node", "to_node"), (F.col("path") == F.col("l_path")) & (F.col("b") == F.col("link"))).drop("l_path", "link")
    hits = two.join(e, (F.col("from_node") == F.col("e_source")) & (F.col("to_node") == F.col("e_target")) & (F.col("type") == F.col("e_type")) & (F.col("sign").isNull() | (F.col("sign") == F.col("e_sign"))), "left")
    w = Window.partitionBy("path", "line", "a", "b", "type", "sign", "_n")
    ranked = hits.withColumns({"k": F.row_number().over(w.orderBy(F.asc_nulls_last("e_line"))), "matches": F.count("e_id").over(w).cast("int")})
    return by_id.unionByName(ranked.filter("k = 1").select("path", "line", F.col("e_id").alias("edge"), "matches"))
