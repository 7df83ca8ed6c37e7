"""Schema rules as tables: declared in notes, merged and checked by joins.

Notes of one folder declare types, edge types, their properties and edges, and prefixes. They are read into one table of declarations; the first
declaration of a name by path wins and later ones are findings, prefixes are expanded by a join. Nodes and edges are checked by joins
with the rule tables, so a plan has the same few joins however many rules there are.

A node of several labels has the rules of all: of a property the first label's, of an edge the union, where one that allows any target
allows all. Values are compared by their text. Null and empty values aren't present. Stubs and nodes without labels aren't judged as ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import marks
from ..sources.notes import NotesGraph, scalar
from .validate import SEVERITIES

# Kinds of properties, prefixes and schemes that are known without a declaration, the base of other identifiers.
KINDS = ("text", "number", "boolean", "date", "datetime", "link", "list")
PREFIXES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "sh": "http://www.w3.org/ns/shacl#", "schema": "https://schema.org/", "foaf": "http://xmlns.com/foaf/0.1/"}
SCHEMES = ("http", "https", "urn", "mailto", "tag", "did", "file")
FOLDER, BASE = "Types/", "urn:tgs:"

DECLARATION = "path string, block int, place int, kind string, owner string, name string, uri string, required boolean, many boolean, values array<string>, targets array<string>, sources array<string>, restricts boolean"
_NAMES = [c.split()[0] for c in DECLARATION.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _value(s: str, at: int, ends: str) -> tuple[object, int]:
    """A value that begins here, up to one of the signs ``ends``, and where it ends. IndexError: the line ends too early."""
    at = marks.skip_blank(s, at)
    if s[at : at + 1] in ("{", "[") and not s.startswith("[[", at):
        mapping, out, keys = s[at] == "{", [], []
        close, at = ("}" if mapping else "]"), marks.skip_blank(s, at + 1)
        while s[at] != close:
            if mapping:
                key, at = _value(s, at, ":")
                keys.append(_text(key))
                at += 1
            item, at = _value(s, at, "," + close)
            out.append(item)
            at = marks.skip_blank(s, at)
            if s[at] == ",":
                at = marks.skip_blank(s, at + 1)
        return (dict(zip(keys, out, strict=True)) if mapping else out), at + 1
    if s[at : at + 1] in ("'", '"'):
        end = s.index(s[at], at + 1)
        return s[at + 1 : end], marks.skip_blank(s, end + 1)
    end = at
    while ends and s[end] not in ends:
        end += 1
    raw = s[at : end if ends else len(s)].strip()
    return (scalar(raw) if raw else None), end if ends else len(s)


def flow(raw: str):
    """A value on one line: a map, a list or a scalar. What is neither is text."""
    try:
        value, end = _value(raw.strip(), 0, "")
    except (IndexError, ValueError, RecursionError):
        return raw.strip()
    return value if end == len(raw.strip()) else raw.strip()


def indented(lines: list[tuple[int, str]]):
    """Maps and lists of (indent, text) lines, nested by their indent."""
    if not lines:
        return None
    own = lines[0][0]
    starts = [i for i, (indent, _) in enumerate(lines) if indent <= own]
    groups = [lines[a:b] for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]
    if lines[0][1].startswith("-"):
        return [indented([(0, rest), *g[1:]]) if ":" in (rest := g[0][1][1:].strip()) and rest[:1] not in "{[\"'" else flow(rest) for g in groups]
    out = {}
    for g in groups:
        key, colon, rest = g[0][1].partition(":")
        if colon:
            out[key.strip().strip("\"'")] = flow(rest) if rest.strip() else indented(g[1:])
    return out


def nested_frontmatter(text: str) -> dict:
    lines = text.splitlines()
    end = next((i for i, line in enumerate(lines) if i and line.strip() in ("---", "...")), 0)
    if not end or lines[0].strip() != "---":
        return {}
    kept = [(len(line) - len(line.lstrip()), line.strip()) for line in lines[1:end] if line.strip() and not line.lstrip().startswith("#")]
    found = indented(kept)
    return found if isinstance(found, dict) else {}


def _text(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


class _Reader:
    """The declarations of one note; what is wrong with them as rows of kind ``problem``."""

    def __init__(self, path: str):
        self.path, self.rows, self.block = path, [], 0

    def add(self, kind: str, owner: str | None, name: str | None, uri=None, **more) -> None:
        if uri is not None and not (isinstance(uri, str) and uri.strip()):
            self.problem("invalid-declaration", f"uri of {name}")
            uri = None
        self.rows.append({"path": self.path, "block": self.block, "place": len(self.rows), "kind": kind, "owner": owner, "name": name, "uri": uri and uri.strip()} | more)

    def problem(self, code: str, says: str) -> None:
        self.rows.append({"path": self.path, "block": self.block, "place": len(self.rows), "kind": "problem", "owner": code, "name": says})

    def map_of(self, value, what: str) -> dict:
        if value is not None and not isinstance(value, dict):
            self.problem("invalid-declaration", f"{what} is no mapping")
        return value if isinstance(value, dict) else {}

    def names(self, value, what: str) -> list[str] | None:
        names = [value] if isinstance(value, str) else value
        if names is None or isinstance(names, list) and all(isinstance(x, str) for x in names):
            return names
        self.problem("invalid-declaration", f"{what} is no name or list of names")
        return None

    def properties(self, kind: str, owner: str, given) -> None:
        if isinstance(given, list):
            given = {p if isinstance(p, str) else p["name"]: "text" if isinstance(p, str) else p for p in reversed(given) if isinstance(p, str) or isinstance(p, dict) and isinstance(p.get("name"), str)}
            given = dict(reversed(given.items()))
        for name, spec in self.map_of(given, f"properties of {owner}").items():
            spec = spec if isinstance(spec, dict) else {"kind": spec}
            sort = str(spec.get("kind") or "text").lower()
            if sort not in KINDS:
                self.problem("unknown-kind", f"{owner}.{name}")
            values = spec.get("values")
            if values is not None and not isinstance(values, list):
                self.problem("invalid-declaration", f"values of {owner}.{name} are no list")
                values = None
            self.add(kind, owner, name, spec.get("uri"), required=spec.get("required") is True, many=sort == "list" or spec.get("many") is True, values=None if values is None else [_text(v) for v in values])

    def type(self, name: str, given) -> None:
        self.block += 1
        given = self.map_of(given, name)
        edges = given.get("edges")
        edges = dict.fromkeys(map(_text, edges)) if isinstance(edges, list) else None if edges is None else self.map_of(edges, f"edges of {name}") if isinstance(edges, dict) else self.map_of(edges, f"edges of {name}") and None
        self.add("type", None, name, given.get("uri"), restricts=edges is not None)
        self.properties("property", name, given.get("properties"))
        for kind, spec in (edges or {}).items():
            spec = spec if isinstance(spec, dict) else {"target": spec}
            self.add("edge", name, kind, required=spec.get("required") is True, many=spec.get("many") is not False, targets=self.names(spec.get("target"), f"target of {name} {kind}"))

    def edge_type(self, name: str, given) -> None:
        self.block += 1
        given = self.map_of(given, name)
        self.add("edge_type", None, name, given.get("uri"), targets=self.names(given.get("to"), f"to of {name}"), sources=self.names(given.get("from"), f"from of {name}"))
        self.properties("edge_property", name, given.get("properties"))

    def read(self, meta: dict) -> list[dict]:
        version = _text(meta["tgs"]) if "tgs" in meta else "0"
        if version.partition(".")[0] != "0":
            self.problem("unsupported-version", version)
            return self.rows
        if "schema" in meta or not {"schemas", "edgeTypes", "prefixes"} & meta.keys():
            self.type(self.path.rpartition("/")[2].removesuffix(".md"), meta.get("schema"))
        for name, given in self.map_of(meta.get("schemas"), "schemas").items():
            self.type(name, given)
        for name, given in self.map_of(meta.get("edgeTypes"), "edgeTypes").items():
            self.edge_type(name, given)
        self.block += 1
        for prefix, iri in self.map_of(meta.get("prefixes"), "prefixes").items():
            if isinstance(iri, str) and iri:
                self.add("prefix", None, prefix, iri)
            else:
                self.problem("invalid-declaration", f"prefix {prefix}")
        return self.rows


def declarations(notes: DataFrame, folder: str = FOLDER) -> DataFrame:
    """What the notes (path, text) directly in a folder declare, a row each."""
    kinds = [_ARROW[c.split()[1]] for c in DECLARATION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in _Reader(path).read(nested_frontmatter(text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(_NAMES, kinds, strict=True)], names=_NAMES)

    inside = folder.strip().strip("/") + "/"
    own = notes.filter(F.startswith("path", F.lit(inside)) & F.endswith("path", F.lit(".md")) & ~F.contains(F.substring("path", len(inside) + 1, 1 << 20), F.lit("/")))
    return own.select("path", "text").mapInArrow(run, DECLARATION)


@dataclass
class Rules:
    """Rows of declarations that hold, by kind, with their iri; findings: code, node (the note) and detail."""

    table: DataFrame
    findings: DataFrame

    def of(self, kind: str) -> DataFrame:
        return self.table.filter(F.col("kind") == kind)


def _finding(df: DataFrame, code: str | Column, node: str, detail: Column) -> DataFrame:
    return df.select((F.lit(code) if isinstance(code, str) else code).alias("code"), F.col(node).alias("node"), detail.cast("string").alias("detail"))


def merge(declared: DataFrame, base: str = BASE) -> Rules:
    """The first declaration of a name by path wins, with all that stands in it."""
    heads = declared.filter(F.col("kind").isin("type", "edge_type", "prefix"))
    w = Window.partitionBy("kind", "name").orderBy("path", "block", "place")  # declarations of one name
    ranked = heads.withColumns({"k": F.row_number().over(w), "first": F.first("path").over(w), "held": F.first("uri").over(w)})
    again = ranked.filter("k > 1 and (kind <> 'prefix' or not uri <=> held)")
    won = ranked.filter("k = 1")
    blocks = won.filter("kind <> 'prefix'").select("path", "block")
    rows = declared.filter(~F.col("kind").isin("prefix", "problem")).join(blocks, ["path", "block"], "left_semi")
    spark = declared.sparkSession
    own = won.filter("kind = 'prefix'").select(F.col("name").alias("prefix"), F.col("uri").alias("start"))
    known = spark.createDataFrame(list(PREFIXES.items()), "prefix string, start string").join(own, "prefix", "left_anti").unionByName(own)
    curie = rows.withColumns({"prefix": F.regexp_extract("uri", r"^([A-Za-z][\w.-]*):", 1), "local": F.regexp_extract("uri", r"(?s)^[A-Za-z][\w.-]*:(.*)$", 1)}).join(known, "prefix", "left")
    written = F.startswith("local", F.lit("//")) | (F.col("start").isNull() & F.lower("prefix").isin(*SCHEMES))
    expanded = F.when(F.col("prefix") == "", None).when(written, F.col("uri")).otherwise(F.concat("start", "local"))
    named = F.concat(F.lit(base), F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20")))
    table = curie.withColumn("expanded", expanded).withColumn("iri", F.coalesce("expanded", named))
    bad = table.filter("uri is not null and expanded is null")
    findings = _finding(again, "duplicate-declaration", "path", F.concat_ws(" ", "kind", "name", "first"))
    findings = findings.unionByName(_finding(bad, F.when(F.col("prefix") == "", "invalid-declaration").otherwise("unknown-prefix"), "path", F.concat_ws(" ", "name", "uri")))
    findings = findings.unionByName(_finding(declared.filter("kind = 'problem'"), F.col("owner"), "path", F.col("name")))
    return Rules(table.select(*_NAMES, "iri"), findings)


def long_props(rows: DataFrame, key: str, json_column: str) -> DataFrame:
    """id, name, listed (whether it is a list) and texts (of its elements, or of itself) of the properties that are present."""
    each = rows.select(F.col(key).alias("id"), F.explode(F.from_json(json_column, "map<string,variant>")).alias("name", "v")).filter("v is not null")
    schema = F.upper(F.schema_of_variant("v"))

    def text(v: Column) -> Column:
        number = F.try_variant_get(v, "$", "double")
        return F.when(F.upper(F.schema_of_variant(v)).isin("STRING", "BOOLEAN"), F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(S.number_text(S.Value(number, "number")), F.to_json(v)))

    listed = F.startswith(schema, F.lit("ARRAY"))
    texts = F.when(listed, F.transform(F.try_variant_get("v", "$", "array<variant>"), text)).otherwise(F.array(text(F.col("v"))))
    return each.filter(schema != "VOID").select("id", "name", listed.alias("listed"), texts.alias("texts")).filter("listed or texts[0] <> ''")


def check(nodes: DataFrame, props: DataFrame, edges: DataFrame, edge_props: DataFrame, rules: Rules) -> DataFrame:
    """severity, code, node and detail of what breaks the rules. nodes: id, labels, stub. edges: id, type, source, target. props and edge_props as
    ``long_props`` gives them."""
    judged = nodes.filter("not stub").select("id", "labels")
    label = judged.select("id", F.posexplode("labels").alias("pos", "label"))

    def by(kind: str, *columns: str) -> DataFrame:
        return rules.of(kind).select(F.col("owner").alias("label"), "name", *columns)

    fields = F.struct("required", "many", F.col("values").alias("allowed"))
    wanted = label.join(by("property", "required", "many", "values"), "label").groupBy("id", "name").agg(F.min_by(fields, "pos").alias("r")).select("id", "name", "r.*")
    held = wanted.join(props, ["id", "name"])
    no_value = lambda held: F.filter("texts", lambda x: ~F.array_contains("allowed", x))
    found = [
        _finding(wanted.filter("required").join(props, ["id", "name"], "left_anti"), "missing-property", "id", F.col("name")),
        _finding(held.filter("listed and not many"), "unexpected-list", "id", F.col("name")),
        _finding(held.filter("allowed is not null").select("id", F.explode(no_value(held)).alias("x")), "value-not-allowed", "id", F.col("x")),
    ]
    strict = label.join(rules.of("type").filter("restricts").select(F.col("name").alias("label")), "label").select(F.col("id").alias("source")).distinct()
    targets = F.when(F.count_if(F.col("targets").isNull()) > 0, None).otherwise(F.array_distinct(F.flatten(F.collect_list("targets"))))
    allowed = label.join(by("edge", "required", "many", "targets"), "label").groupBy(F.col("id").alias("source"), F.col("name").alias("type")).agg(F.max("required").alias("required"), F.max("many").alias("many"), targets.alias("allowed"))
    own = edges.select("id", "type", "source", "target")
    counted = own.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))
    kinds = rules.of("edge_type").select(F.col("name").alias("type"), F.col("targets").alias("to_any"), F.col("sources").alias("from_any"))
    ends = judged.filter(F.size("labels") > 0)
    to = ends.select(F.col("id").alias("target"), F.col("labels").alias("to_labels"))
    begin = ends.select(F.col("id").alias("source"), F.col("labels").alias("from_labels"))
    aimed = own.join(allowed.select("source", "type", "allowed"), ["source", "type"], "left").join(kinds, "type", "left").withColumn("wants", F.coalesce("allowed", "to_any")).filter("wants is not null")
    found += [
        _finding(own.join(strict, "source", "left_semi").join(allowed, ["source", "type"], "left_anti"), "edge-not-allowed", "source", F.col("type")),
        _finding(allowed.filter("required").join(counted, ["source", "type"], "left_anti"), "missing-edge", "source", F.col("type")),
        _finding(allowed.filter("not many").join(counted.filter("n > 1"), ["source", "type"], "left_semi"), "too-many-edges", "source", F.col("type")),
        _finding(aimed.join(to, "target").filter(~F.arrays_overlap("to_labels", "wants")), "wrong-target-type", "source", F.col("target")),
        _finding(own.join(kinds.filter("from_any is not null"), "type").join(begin, "source").filter(~F.arrays_overlap("from_labels", "from_any")), "wrong-source-type", "source", F.col("target")),
    ]
    need = rules.of("edge_property").select(F.col("owner").alias("type"), "name", "required", F.col("values").alias("allowed"))
    asked = own.join(need, "type")
    given = asked.join(edge_props, ["id", "name"])
    found += [
        _finding(asked.filter("required").join(edge_props, ["id", "name"], "left_anti"), "missing-edge-property", "source", F.col("name")),
        _finding(given.filter("allowed is not null").select("source", F.explode(no_value(given)).alias("x")), "edge-value-not-allowed", "source", F.col("x")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    severity = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])[F.col("code")], F.lit("error"))
    return out.distinct().select(severity.alias("severity"), "code", "node", "detail")


def check_notes(g: NotesGraph, rules: Rules) -> DataFrame:
    """The findings over a graph of notes."""
    edges = g.identified()
    ends = edges.select("id", "type", F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    return check(g.nodes(None, {}), long_props(g.note_table, "path", "props"), ends, long_props(edges, "id", "props"), rules)
