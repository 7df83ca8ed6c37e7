"""Text notes as a property graph.

A note has a path and a text: optional frontmatter between ``---`` lines, then lines of which ``[+-]type:: [[Target]] {props}`` are edges.
Parsing is the only Python step (Arrow batches over (path, text)); links are resolved, stubs and edge ids made by joins and windows.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from . import marks
from .graph import PropertyGraph

# Fixed values of the note format.
SKIPPED_KEYS = {"tags", "aliases", "cssclasses", "type", "types"}
LINK_TYPE = "links_to"
#: Columns of an edge that can be asked for but aren't among its properties.
HIDDEN = ("heading", "line")


class BadProps(ValueError):
    def __init__(self, message: str, offset: int):
        super().__init__(message)
        self.offset = offset


def scalar(raw: str):
    """A bare word: number, boolean, null or text."""
    if raw[:1] in "+-.0123456789" and raw[-1:] in ".0123456789" and not raw.lower().lstrip("+-").startswith(("inf", "nan", "_")) and "_" not in raw:
        try:
            return float(raw)
        except ValueError:
            return raw
    return {"true": True, "false": False, "null": None}.get(raw, raw)


class Props:
    """Reads a tolerant property block such as ``{since: 2020, tags: [a, 'b'],}``: names and values may be bare or quoted, lists don't nest."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def next(self) -> str:
        self.at = marks.skip_blank(self.text, self.at)
        return self.text[self.at : self.at + 1]

    def takes(self, mark: str) -> bool:
        here = self.next() == mark
        self.at += here
        return here

    def wants(self, mark: str, what: str) -> None:
        if not self.takes(mark):
            raise BadProps(f"{what} lacks {mark!r}", self.at)

    def quoted(self) -> str:
        quote, out = self.text[self.at], []
        at = self.at + 1
        while at < len(self.text) and self.text[at] != quote:
            c = self.text[at]
            if c == "\\" and at + 1 < len(self.text):
                at += 1
                c = {"n": "\n", "t": "\t"}.get(self.text[at], self.text[at])
            out.append(c)
            at += 1
        if at == len(self.text):
            raise BadProps("a quoted text isn't closed", self.at)
        self.at = at + 1
        return "".join(out)

    def bare(self, ends: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ends:
            self.at += 1
        word = self.text[start : self.at].rstrip()
        if not word:
            raise BadProps("a name or value is missing", self.at)
        return word

    def name(self) -> str:
        return self.quoted() if self.next() in ("'", '"') else self.bare(",:{}[]")

    def value(self):
        c = self.next()
        if c in ("'", '"'):
            return self.quoted()
        if c in ("{", ":"):
            raise BadProps("a value is missing", self.at)
        return scalar(self.bare(",}]"))  # a value may hold colons

    def values(self) -> list:
        out = []
        while not self.takes("]"):
            out.append(self.value())
            if self.next() != "]":
                self.wants(",", "a list")
        return out

    def block(self) -> dict:
        self.wants("{", "a property block")
        out: dict = {}
        while not self.takes("}"):
            name = self.name()
            self.wants(":", "a property")
            out[name] = self.values() if self.takes("[") else self.value()
            if self.next() != "}":
                self.wants(",", "a property block")
        return out


def parse_props(text: str) -> dict:
    return Props(text).block()


def frontmatter(text: str) -> tuple[dict, int]:
    """Its keys (scalars, inline and block lists) and the line after it."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "---":
        return {}, 0
    end = next((i for i, l in enumerate(lines) if i and l.strip() in ("---", "...")), 0)
    if not end:
        return {}, 0
    out: dict = {}
    key = None
    for line in lines[1:end]:
        if m := re.match(r"\s*-(?:\s+(.*)|$)", line):
            if key is not None:
                out[key] = [*(out[key] if isinstance(out[key], list) else []), _plain(m[1] or "")]
        elif m := re.match(r"([^\s:#][^:]*):\s*(.*)", line):
            key, raw = m[1].strip(), m[2].strip()
            out[key] = [_plain(x) for x in re.findall(r"""\[\[.*?\]\]|"[^"]*"|'[^']*'|[^,\s][^,]*""", raw[1:-1])] if raw.startswith("[") and raw.endswith("]") and not raw.startswith("[[") else _plain(raw) if raw else None
    return out, end + 1


def _plain(raw: str):
    raw = raw.strip()
    if not raw:
        return None
    return raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'" else scalar(raw)


def from_root(link: str, source: str) -> str:
    """The path from the vault's root that a link in the note ``source`` names; ``..`` ends at the root."""
    return posixpath.normpath(posixpath.join("/", posixpath.dirname(source), link)).lstrip("/")


def markdown_target(dest: str, source: str) -> tuple[str, str | None] | None:
    """The note a markdown link points to, with the part of it, or None if it isn't one."""
    try:
        link = urlsplit(dest.strip().removeprefix("<").removesuffix(">").strip())
    except ValueError:  # no address at all
        return None
    if link.scheme or link.netloc or not link.path or link.path.endswith("/"):
        return None
    path = unquote(link.path + (f"?{link.query}" if link.query else ""))
    suffix = posixpath.splitext(path)[1]
    to = from_root(path, source)
    if not to or suffix.lower() not in ("", ".md", ".adoc"):
        return None
    return to + ("" if suffix else ".md"), unquote(link.fragment).strip() or None


def link_at(text: str, at: int, source: str) -> tuple[tuple[str, str | None, str | None] | None, int]:
    """The note link here as (target, subpath, alias), None for a link to something else, and where it ends; ``at`` if there is no link."""
    if w := marks.wiki_link(text, at):
        return (w[:3] if w[0] else None), w[3]
    if m := marks.markdown_link(text, at):
        to = markdown_target(m[1], source)
        return ((*to, m[0].strip() or None) if to else None), m[2]
    return None, at


def scan_links(value: str, source: str) -> tuple[list[tuple[str, str | None, str | None]], int]:
    """Comma-separated links at the start of value as (target, subpath, alias), and where they end."""
    out: list = []
    at = 0
    while True:
        start = marks.skip_blank(value, at)
        link, end = link_at(value, start, source)
        if end == start:
            return out, at
        out += [link] if link else []
        at = marks.skip_blank(value, end)
        if not value.startswith(",", at):
            return out, end
        at += 1


def links_in(line: str, source: str) -> Iterator[tuple[str, str | None, str | None]]:
    """All note links of a line outside code spans that aren't shown in place (``![[...]]``)."""
    plain, at = marks.blank_code(line), 0
    while (start := plain.find("[", at)) >= 0:
        link, end = link_at(plain, start, source)
        if link and not plain.startswith("!", start - 1 if start else 0):
            yield link
        at = max(end, start + 1)


def titled_lines(text: str, first: int) -> Iterator[tuple[int, str | None, str]]:
    """(number, heading above, line) of the lines from ``first`` on, outside fences and headings."""
    title = None
    for n, line in marks.outside_fences(x.removesuffix("\r") for x in text.split("\n")[first:]):
        if h := marks.heading(line):
            title = h[1]
        else:
            yield n + first, title, line


def edge_line(line: str, source: str) -> tuple[str, int, list, dict, tuple[int, str] | None] | None:
    """(type, sign, links, properties, problem as (column, message)) of a line that gives edges."""
    if not (head := marks.edge_head(line)):
        return None
    sign, kind, start = head
    links, length = scan_links(line[start:], source)
    if not links:
        return None
    props, problem, at = {}, None, marks.skip_blank(line, start + length)
    if line.startswith("{", at):
        try:
            props = parse_props(line[at:])
        except BadProps as e:
            problem = (at + e.offset, f"malformed property block: {e}")
    return kind, -1 if sign == "-" else 1, links, props, problem


def frontmatter_links(meta: dict, source: str) -> Iterator[tuple[str, tuple[str, str | None, str | None]]]:
    """(key, link) of the links that frontmatter values begin with."""
    for key in meta.keys() - SKIPPED_KEYS:
        for value in meta[key] if isinstance(meta[key], list) else [meta[key]]:
            if isinstance(value, str):
                yield from ((key, link) for link in scan_links(value, source)[0])


def parse_note(path: str, text: str, link_edges: bool = False, frontmatter_edges: bool = True, front: tuple[dict, int] | None = None) -> tuple[list[tuple], list[tuple]]:
    """Edges (type, sign, target, subpath, alias, props, line, heading) and problems (line, column, message). front: the frontmatter, if it is known."""
    meta, first = front or frontmatter(text)
    place = {key: i for i, key in enumerate(meta)}
    found = sorted(frontmatter_links(meta, path), key=lambda x: place[x[0]]) if frontmatter_edges else []
    edges: list[tuple] = [(key, 1, *link, {}, 0, None) for key, link in found]
    problems: list[tuple] = []
    for n, title, line in titled_lines(text, first):
        if given := edge_line(line, path):
            kind, sign, links, props, problem = given
            edges += [(kind, sign, *link, dict(props), n, title) for link in links]
            problems += [(n, *problem)] if problem else []
        elif link_edges:
            edges += [(LINK_TYPE, 1, *link, {}, n, title) for link in links_in(line, path)]
    return edges, problems


def edge_note(meta: dict) -> tuple[str, str, str, int, dict] | None:
    """(source, target, type, sign, properties) of a note that stands for one edge: ``type: edge`` with ``from``, ``to`` and ``edgeType``."""
    ends = [meta.get(k) for k in ("from", "to", "edgeType")]
    if meta.get("type") != "edge" or not all(isinstance(v, str) and v.strip() for v in ends):
        return None
    source, target = ((w[0] if (w := marks.wiki_link(v.strip(), 0)) else v.strip()) for v in ends[:2])
    props = {k: v for k, v in meta.items() if k not in ("type", "from", "to", "edgeType", "sign")}
    return source, target, ends[2].strip(), -1 if meta.get("sign") in (-1, "-") else 1, props


EDGE = "type string, sign int, target string, subpath string, alias string, props string, line int, heading string, place int, source string"
EDGES = "path string, " + EDGE
_EDGE_NAMES = [c.split()[0] for c in EDGE.split(", ")]
_EDGE_KIND = pa.struct([(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.string()) for c in EDGE.split(", ")])
NOTE = "path string, props string, labels array<string>, title string, hash string, edge_note boolean"


def _note(path: str, text: str, link_edges: bool) -> tuple:
    meta, first = frontmatter(text)
    labels: list[str] = []
    for key in ("type", "types"):
        for v in meta.get(key) if isinstance(meta.get(key), list) else [meta.get(key)]:
            if isinstance(v, str) and v.strip() and v.strip() not in labels:
                labels.append(v.strip())
    title = meta.get("title") if isinstance(meta.get("title"), str) and meta["title"].strip() else re.sub(r"\.(md|adoc)$", "", path.rpartition("/")[2])
    if e := edge_note(meta):
        edges = [(e[2], e[3], e[1], None, None, json.dumps(e[4] | {"id": path}), 0, None, 0, e[0])]
    else:
        edges = [(t, s, target, sub, alias, json.dumps(props), line, heading, k, None) for k, (t, s, target, sub, alias, props, line, heading) in enumerate(parse_note(path, text, link_edges, front=(meta, first))[0])]
    props = {k: v for k, v in meta.items() if k != "title"}
    return path, json.dumps(props), labels, title, hashlib.sha256(text.encode()).hexdigest(), e is not None, [dict(zip(_EDGE_NAMES, x, strict=True)) for x in edges]


def parsed_notes(notes: DataFrame, link_edges: bool = False) -> DataFrame:
    """Notes (path, text), each read once: path, properties (JSON), labels, title, the text's SHA-256, whether it is an edge note, and its edges."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.list_(_EDGE_KIND)]
    names = [*(c.split()[0] for c in NOTE.split(", ")), "edges"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_note(path, text or "", link_edges) for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return notes.filter("path is not null").select("path", "text").mapInArrow(run, f"{NOTE}, edges array<struct<{', '.join(c.replace(' ', ':') for c in EDGE.split(', '))}>>")


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.inline("edges"))


def parsed_edges(notes: DataFrame, link_edges: bool = False) -> DataFrame:
    """One row per edge line link of notes (path, text); ``place`` counts a note's links. An edge note is one row with its ``source``."""
    return edges_of(parsed_notes(notes, link_edges))


def note_rows(notes: DataFrame) -> DataFrame:
    """path, properties (JSON), labels, title and the text's SHA-256 of each note, and whether it is an edge note."""
    return parsed_notes(notes).drop("edges")


def link_names(links: DataFrame) -> DataFrame:
    """path, target and name: the paths, or ends of paths, that a link may mean; one of either kind of note where it has no extension."""
    clean = links.select("path", "target").distinct().withColumn("clean", F.regexp_replace(F.trim("target"), "^/+", ""))
    both = F.array(F.concat("clean", F.lit(".md")), F.concat("clean", F.lit(".adoc")))
    return clean.select("path", "target", F.explode(F.when(F.rlike(F.lower("clean"), F.lit(r"\.(md|adoc)$")), F.array("clean")).otherwise(both)).alias("name"))


def path_ends(paths: DataFrame) -> DataFrame:
    """path and end: each path's ends at a folder, in lower case."""
    parts = F.split("path", "/")
    return paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.lower(F.array_join(F.slice(parts, i, F.size(parts)), "/")))).alias("end"))


def resolve_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """links (path, target) with ``to``: the note a link means, or null. An exact path wins, else a path that ends with the link: in the
    source's folder first, then the shortest, then the first by name. A link without an extension that fits notes of both kinds means none.

    The best note of each ending is worked out once, so a link meets three rows at most, however many notes end alike."""
    notes = paths.select("path").distinct()
    best = F.min(F.struct(F.length("path").alias("n"), F.col("path")))["path"]
    by_end = path_ends(notes).groupBy("end").agg(best.alias("by_end"))
    by_place = notes.groupBy(F.lower("path").alias("whole")).agg(best.alias("by_place"))
    exact = notes.select(F.col("path").alias("exact"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    met = link_names(links).join(by_end, F.lower("name") == F.col("end")).join(by_place, F.lower(F.concat(folder, "name")) == F.col("whole"), "left").join(exact, F.col("name") == F.col("exact"), "left")
    chosen = met.groupBy("path", "target").agg(F.count(F.lit(1)).alias("n"), F.first(F.coalesce("exact", "by_place", "by_end")).alias("to"))
    return links.join(chosen.filter("n = 1").drop("n"), ["path", "target"], "left")


def _kind(schema: str) -> str:
    """A property's kind from its schema as a variant."""
    s = schema.upper()
    if s.startswith("ARRAY<"):
        item = _kind(s[6:-1])
        return "list of " + (item if item in ("number", "string", "boolean", "void") else "mixed")
    return {"STRING": "string", "BOOLEAN": "boolean", "VOID": "void", "VARIANT": "mixed"}.get(s, "string" if s.startswith("OBJECT") else "number")


_TYPES = {"number": "double", "string": "string", "boolean": "boolean", "list of number": "array<double>", "list of string": "array<string>", "list of boolean": "array<boolean>", "list of void": "array<string>"}


def _tagged(v: Column, nested: bool = False) -> Column:
    """A variant as a mixed value."""
    schema = F.upper(F.schema_of_variant(v))
    get = lambda t: F.try_variant_get(v, "$", t)
    kinds = [("string", schema == "STRING", "string"), ("boolean", schema == "BOOLEAN", "boolean"), ("number", ~schema.isin("STRING", "BOOLEAN", "VOID") & ~F.startswith(schema, F.lit("ARRAY")), "double")]
    out = None
    for kind, holds, spark_type in kinds:
        col = S.mixed(S.Value(get(spark_type), kind), nested).col
        out = F.when(holds, col) if out is None else out.when(holds, col)
    if not nested:
        items = F.transform(get("array<variant>"), lambda x: _tagged(x, nested=True))
        out = out.when(F.startswith(schema, F.lit("ARRAY")), S.mixed(S.Value(items, "list", "mixed")).col)
    return out


def _typed(rows: DataFrame, json_column: str) -> tuple[DataFrame, list[str], set[str]]:
    """A column for each property name, mixed where its values are of several kinds, and the names among them; all names that occur."""
    kinds = rows.select(F.explode(F.from_json(json_column, "map<string,variant>")).alias("k", "v")).filter("v is not null").select("k", F.schema_of_variant("v").alias("s")).distinct().collect()  # as many rows as the schema has
    found: dict[str, set[str]] = {}
    for r in kinds:
        found.setdefault(r["k"], set()).add(_kind(r["s"]))
    out = rows.withColumn("_props", F.from_json(json_column, "map<string,variant>"))
    names = []
    for name in sorted(found, key=lambda n: (n not in ("type", "types"), n)):
        own = found[name] - {"void"}
        own = own - {"list of void"} if any(k.startswith("list") and k != "list of void" for k in own) else own
        if not own or name in ("id", "sign"):
            continue
        value = F.col("_props")[name]
        if len(own) == 1 and "mixed" not in next(iter(own)):
            column = F.try_variant_get(value, "$", _TYPES[next(iter(own))])
        elif all(k.startswith("list") for k in own):
            column = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _tagged(x, nested=True))
        else:
            column = _tagged(value)
        out = out.withColumn(f"p_{name}", column)
        names.append(name)
    return out.drop("_props"), names, set(found)


def notes_graph(spark: SparkSession, notes: DataFrame, link_edges: bool = False) -> PropertyGraph:
    """Notes as nodes, their edge lines as edges; targets that no note is are stubs named by the link."""
    parsed = parsed_notes(notes, link_edges).persist()
    rows = parsed.drop("edges")
    nodes, names, _ = _typed(rows.filter("not edge_note").drop("edge_note"), "props")
    paths = rows.select("path")
    found = resolve_links(edges_of(parsed), paths)
    edges = found.withColumns({"target_id": F.coalesce("to", "target"), "source_id": F.col("path"), "from": F.col("path"), "pinned": F.get_json_object("props", "$.id")})
    edge_notes = rows.filter("edge_note").select("path")
    some = not edge_notes.isEmpty()
    if some:  # their edges begin at another note
        ends = found.filter("source is not null").select("path", F.col("source").alias("target")).distinct()
        sources = resolve_links(ends, paths).select("path", F.col("target").alias("source"), F.col("to").alias("begin"))
        edges = edges.join(sources, ["path", "source"], "left").withColumns({"from": F.when(F.col("source").isNull(), F.col("path")).otherwise(F.col("begin")), "source_id": F.when(F.col("source").isNull(), F.col("path")).otherwise(F.coalesce("begin", "source"))}).drop("begin")
    kept = edges.persist()
    edges, edge_names, all_names = _typed(kept, "props")
    g = NotesGraph(spark, nodes, names, edges, edge_names, edge_notes if some else None, "id" in all_names)
    g.kept = [parsed, kept]
    return g


class NotesGraph(PropertyGraph):
    """A graph whose labels and types are values in two tables. They are kept until ``close``."""

    def __init__(self, spark: SparkSession, note_table: DataFrame, names: list[str], edge_table: DataFrame, edge_names: list[str], edge_notes: DataFrame | None, some_pinned: bool):
        super().__init__(spark)
        self.edge_notes, self.some_pinned, self.hidden = edge_notes, some_pinned, HIDDEN
        self.note_table, self.names, self.edge_table, self.edge_names = note_table, names, edge_table, edge_names

    def native(self, types, side):
        return None

    def node_props(self, labels=None):
        schema = self.note_table.schema
        return {n: schema[f"p_{n}"].dataType for n in self.names if n not in ("path", "title")} | {"path": T.StringType(), "title": T.StringType()}

    def edge_props(self, types=None):
        return {n: self.edge_table.schema[f"p_{n}"].dataType for n in self.edge_names if n not in HIDDEN} | {"heading": T.StringType(), "line": T.IntegerType()}

    def nodes(self, labels, props, among=None, stubs=True):
        def column(p: str):
            return F.col(p) if p in ("path", "title") else F.col(f"p_{p}")

        rows = self.note_table.select(F.col("path").alias("id"), "labels", F.lit(False).alias("stub"), *(column(p).cast(k).alias(p) for p, k in props.items()))
        for label in labels or ():
            rows = rows.filter(F.array_contains("labels", label))
        if stubs and not labels:
            rows = rows.unionByName(self.stubs().select("id", F.array().cast("array<string>").alias("labels"), F.lit(True).alias("stub"), *((F.col("id") if p == "title" else F.lit(None)).cast(k).alias(p) for p, k in props.items())))
        return rows

    def stubs(self):
        rows = self.sound()
        targets = rows.filter(F.col("to").isNull()).select(F.col("target_id").alias("id"))
        return targets.unionByName(rows.filter(F.col("source").isNotNull() & F.col("from").isNull()).select(F.col("source_id").alias("id"))).distinct()

    def sound(self) -> DataFrame:
        """The edge table without links to edge notes: an edge is no end of an edge."""
        if self.edge_notes is None:
            return self.edge_table
        at = self.edge_notes.select(F.col("path").alias("_note"))
        return self.edge_table.join(at, F.col("target_id") == F.col("_note"), "left_anti")

    def refused_links(self) -> DataFrame:
        """code, path, line and target of the links to edge notes."""
        hits = self.edge_table.filter(F.lit(False))
        if self.edge_notes is not None:
            hits = self.edge_table.join(self.edge_notes.select(F.col("path").alias("_note")), F.col("target_id") == F.col("_note"), "left_semi")
        return hits.select(F.lit("link-to-edge-note").alias("code"), "path", (F.col("line") + 1).alias("line"), F.col("target_id").alias("target"))

    def identified(self) -> DataFrame:
        """The edge table with ids: a pinned one, else source#type#target#ordinal."""
        w = Window.partitionBy("source_id", "type", "target_id").orderBy("path", "place")
        derived = F.concat("source_id", F.lit("#"), "type", F.lit("#"), "target_id", F.lit("#"), (F.row_number().over(w) - 1).cast("string"))
        return self.sound().withColumn("id", F.coalesce("pinned", derived))

    def copies(self) -> DataFrame:
        """path, place, line and id of the edges whose id an earlier one has, by (path, place). Only pinned ids can meet others."""
        rows = self.identified()
        pinned = rows.filter("pinned is not null").select("id").distinct()
        w = Window.partitionBy("id").orderBy("path", "place")
        return rows.join(pinned, "id", "left_semi").withColumn("copy", F.row_number().over(w) - 1).filter("copy > 0").select("path", "place", "line", "id")

    def duplicate_ids(self) -> DataFrame:
        """code, path, line and id of the edges that are left out because an earlier one has their id."""
        return self.copies().select(F.lit("duplicate-edge-id").alias("code"), "path", (F.col("line") + 1).alias("line"), "id")

    def edges(self, types, props, with_id=True):
        rows = self.identified() if with_id else self.sound().withColumn("id", F.lit(None).cast("string"))
        rows = rows.filter(F.col("type").isin(*types)) if types else rows  # a key of the ordinals' window, so it is cut below it
        if self.some_pinned:
            rows = rows.join(self.copies().select("path", "place"), ["path", "place"], "left_anti")
        return rows.select("id", "type", "sign", F.col("source_id").alias("source"), F.col("target_id").alias("target"), *((F.col(p) if p in HIDDEN else F.col(f"p_{p}")).cast(k).alias(p) for p, k in props.items()))

    def ends(self, types, side):
        return set(), False


__all__ = ["notes_graph", "parse_note", "parse_props", "parsed_edges", "resolve_links"]
