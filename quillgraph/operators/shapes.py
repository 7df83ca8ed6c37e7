"""Schema declarations and their exchange as SHACL in Turtle.

A declared type has properties and edges; an edge type has ends and properties. Export is deterministic: types by name, properties in their order.
Import reads the same shapes (and others that use the same terms) and reports what it had to drop.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from .validate import EdgeRule, PropertyRule

# Fixed values of the vocabularies.
SH, XSD, RDF = "http://www.w3.org/ns/shacl#", "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
DATATYPES = {"text": XSD + "string", "number": XSD + "decimal", "boolean": XSD + "boolean", "date": XSD + "date", "datetime": XSD + "dateTime", "list": XSD + "string"}
BASE = "urn:graph:"


@dataclass
class Property:
    name: str
    kind: str = "text"
    required: bool = False
    many: bool = False
    values: list = field(default_factory=list)
    default: object = None


@dataclass
class Edge:
    type: str
    required: bool = False
    many: bool = True
    targets: list[str] = field(default_factory=list)


@dataclass
class NodeType:
    name: str
    properties: list[Property] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)


@dataclass
class EdgeType:
    name: str
    sources: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    properties: list[Property] = field(default_factory=list)


@dataclass
class Schema:
    types: dict[str, NodeType] = field(default_factory=dict)
    edge_types: dict[str, EdgeType] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    def rules(self) -> tuple[list[PropertyRule], list[EdgeRule]]:
        """The same as rules for validation."""
        props = [PropertyRule(t.name, p.name, p.required, p.many or p.kind == "list", tuple(p.values)) for t in self.types.values() for p in t.properties]
        edges = [EdgeRule(t.name, e.type, int(e.required), None if e.many else 1, tuple(e.targets)) for t in self.types.values() for e in t.edges]
        return props, edges

    def labels(self, labels: list[str]) -> NodeType:
        """One type for a node with several labels: of properties with one name the first counts, edges are joined."""
        out = NodeType("+".join(labels))
        for t in (self.types[x] for x in labels if x in self.types):
            out.properties += [p for p in t.properties if p.name not in {q.name for q in out.properties}]
            out.edges += [e for e in t.edges if e not in out.edges]
        return out


def _literal(v) -> str:
    return str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else json.dumps(v, ensure_ascii=False)


def _iri(name: str, suffix: str = "") -> str:
    return f"<{BASE}{quote(name, safe='')}{suffix}>"


def _node(pairs: list[tuple[str, object]], indent: int) -> str:
    pad = "\n" + "  " * (indent + 1)
    return (" ;" + pad).join(f"{p} {'[' + pad + '  ' + _node(o, indent + 2) + pad + ']' if isinstance(o, list) else o}" for p, o in pairs)


def _classes(names: list[str]) -> list[tuple[str, object]]:
    if not names:
        return [("sh:nodeKind", "sh:IRI")]
    return [("sh:class", _iri(names[0]))] if len(names) == 1 else [("sh:or", "( " + " ".join(f"[ sh:class {_iri(n)} ]" for n in names) + " )")]


def _cardinality(required: bool, many: bool) -> list[tuple[str, object]]:
    return [("sh:minCount", "1")] * required + [("sh:maxCount", "1")] * (not many)


def _property(p: Property, order: int) -> list[tuple[str, object]]:
    kind = [("sh:nodeKind", "sh:IRI"), (":property", "true")] if p.kind == "link" else [("sh:datatype", f"<{DATATYPES[p.kind]}>")]
    more = [(":kind", '"list"')] if p.kind == "list" else []
    if p.default is not None:
        more.append(("sh:defaultValue", _literal(p.default)))
    if p.values:
        more.append(("sh:in", "( " + " ".join(map(_literal, p.values)) + " )"))
    return [("sh:path", _iri(p.name)), ("sh:name", _literal(p.name)), *kind, *_cardinality(p.required, p.many), *more, ("sh:order", str(order))]


def to_turtle(schema: Schema) -> str:
    blocks = [f"@prefix sh: <{SH}> .\n@prefix rdf: <{RDF}> .\n@prefix : <{BASE}> ."]
    for _, t in sorted(schema.types.items()):
        pairs: list = [("a", "sh:NodeShape"), ("sh:targetClass", _iri(t.name)), ("sh:name", _literal(t.name))]
        pairs += [("sh:property", _property(p, i)) for i, p in enumerate(t.properties)]
        pairs += [("sh:property", [("sh:path", _iri(e.type)), ("sh:name", _literal(e.type)), (":edge", "true"), *_classes(e.targets), *_cardinality(e.required, e.many), ("sh:order", str(i))]) for i, e in enumerate(t.edges, len(t.properties))]
        blocks.append(f"{_iri(t.name, 'Shape')} {_node(pairs, 0)} .")
    for _, t in sorted(schema.edge_types.items()):
        pairs = [("a", "sh:NodeShape"), ("sh:name", _literal(t.name)), ("sh:property", [("sh:path", "rdf:predicate"), ("sh:hasValue", _iri(t.name))])]
        pairs += [("sh:property", [("sh:path", f"rdf:{side}"), *_classes(names)]) for side, names in (("subject", t.sources), ("object", t.targets)) if names]
        pairs += [("sh:property", _property(p, i)) for i, p in enumerate(t.properties)]
        blocks.append(f"{_iri(t.name, 'EdgeShape')} {_node(pairs, 0)} .")
    return "\n\n".join(blocks) + "\n"


_TURTLE = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<string>"(?:[^"\\]|\\.)*")(?:\^\^(?:<[^>]*>|[\w-]*:[\w-]*)|@[\w-]+)?|(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<name>@prefix|[\w-]*:[\w.-]*[\w-]|[\w-]*:|a\b|true\b|false\b)|(?P<op>[\[\]();,.])""", re.X)


def parse_turtle(text: str) -> list[tuple[str, list[tuple[str, object]]]]:
    """Subjects with their (predicate, object) pairs; blank nodes are lists of pairs, collections are tuples, IRIs start with '<'."""
    tokens, at = [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {text[at:at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    prefixes: dict[str, str] = {}
    i = 0

    def term():
        nonlocal i
        kind, t = tokens[i]
        i += 1
        if kind == "string":
            return json.loads(t)
        if kind == "number":
            return float(t) if "." in t else int(t)
        if kind == "iri":
            return t
        if t in ("true", "false"):
            return t == "true"
        if t == "a":
            return f"<{RDF}type>"
        if t == "[":
            out = pairs("]")
            i += 1
            return out
        if t == "(":
            items = []
            while tokens[i][1] != ")":
                items.append(term())
            i += 1
            return tuple(items)
        prefix, _, local = t.partition(":")
        if kind != "name" or prefix not in prefixes:
            raise ValueError(f"unexpected {t!r}")
        return f"<{prefixes[prefix]}{local}>"

    def pairs(end: str) -> list[tuple[str, object]]:
        nonlocal i
        out = []
        while tokens[i][1] != end:
            p = term()
            out.append((p, term()))
            while tokens[i][1] == ",":
                i += 1
                out.append((p, term()))
            while tokens[i][1] == ";":
                i += 1
        return out

    found = []
    while i < len(tokens):
        if tokens[i][1] == "@prefix":
            prefixes[tokens[i + 1][1].rstrip(":")] = tokens[i + 2][1][1:-1]
            i += 4
            continue
        subject = term()
        found.append((subject, pairs(".")))
        i += 1
    return found


def _short(iri: str) -> str:
    return unquote(re.split(r"[#/:]", iri[1:-1])[-1])


def from_turtle(text: str) -> Schema:
    out = Schema()
    sh = lambda n: f"<{SH}{n}>"
    rdf = lambda n: f"<{RDF}{n}>"
    kinds = {f"<{v}>": k for k, v in DATATYPES.items() if k != "list"} | {f"<{XSD}integer>": "number", f"<{XSD}double>": "number", f"<{XSD}float>": "number"}
    known = {sh(n) for n in ("path", "name", "datatype", "nodeKind", "minCount", "maxCount", "defaultValue", "in", "order", "class", "or", "hasValue")} | {f"<{BASE}{n}>" for n in ("kind", "edge", "property")}

    def ends(p: dict) -> list[str]:
        if sh("class") in p:
            return [_short(p[sh("class")])]
        return [_short(dict(x)[sh("class")]) for x in p.get(sh("or"), ()) if sh("class") in dict(x)]

    for subject, pairs in parse_turtle(text):
        if (rdf("type"), sh("NodeShape")) not in pairs:
            out.dropped.append(f"{subject}: not a node shape")
            continue
        shapes = [dict(o) for p, o in pairs if p == sh("property") and isinstance(o, list)]
        edge = next((_short(s[sh("hasValue")]) for s in shapes if s.get(sh("path")) == rdf("predicate") and sh("hasValue") in s), None)
        single = {p: o for p, o in pairs}
        target = single.get(sh("targetClass"))
        name = edge or (_short(target) if target else None)
        if not name:
            out.dropped.append(f"{subject}: no target class")
            continue
        node, rel = NodeType(name), EdgeType(name)
        for s in sorted(shapes, key=lambda s: s.get(sh("order"), 0)):
            path = s.get(sh("path"))
            out.dropped += [f"{name}: {p}" for p in s if p not in known]
            if not isinstance(path, str) or path == rdf("predicate"):
                continue
            if path == rdf("subject"):
                rel.sources = ends(s)
                continue
            if path == rdf("object"):
                rel.targets = ends(s)
                continue
            own, required, many = s.get(sh("name")) or _short(path), s.get(sh("minCount"), 0) >= 1, sh("maxCount") not in s
            if not edge and (s.get(f"<{BASE}edge>") or sh("class") in s or sh("or") in s):
                node.edges.append(Edge(own, required, many, ends(s)))
                continue
            kind = "list" if s.get(f"<{BASE}kind>") == "list" else "link" if s.get(sh("nodeKind")) == sh("IRI") else kinds.get(s.get(sh("datatype")), "text")
            (rel if edge else node).properties.append(Property(own, kind, required, many, list(s.get(sh("in"), ())), s.get(sh("defaultValue"))))
        if edge:
            out.edge_types[name] = rel
        else:
            out.types[name] = node
    return out
