"""Queries over a property graph as DataFrame plans.

A MATCH after a WITH grows from the rows so far: each hop is joined to them, outward from a node that they hold. It is joined together by
itself, and then to the rows by their common ids, where something in it is looked for by its properties while the rows aren't known to be
few, and for OPTIONAL MATCH, which is one left outer join with its WHERE in the condition. A node of which only the id matters isn't
scanned where the edge table says what its ends are. Variable-length hops carry the edges they used: a pattern of one length is a chain of
joins, others are a recursive common table expression, one join a level until no path is left to grow.
Nothing is collected; Catalyst pushes filters and columns to the scans and picks the joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.graph import PropertyGraph
from .lexer import CypherError
from .parser import Expr, Item, Match, NodePattern, Path, Project, RelPattern, Unwind, contains_aggregate, parse

#: Longest path of a pattern that names no upper bound.
MAX_DEPTH = 10


@dataclass
class Bound:
    """A variable: its kind and its columns (by property, or '' for a value)."""

    kind: str  # node, rel, rels, path, value
    cols: dict[str, str]
    props: dict[str, Any] = field(default_factory=dict)
    value: S.Value | None = None


@dataclass
class Result:
    """json: columns whose values are of several types, given as JSON text."""

    df: DataFrame
    kinds: list[tuple[str, str]]
    probes: list[tuple[str, DataFrame]]
    json: set[str] = field(default_factory=set)

    @property
    def notices(self) -> list[str]:
        """What was left out. Asking runs a query for each pattern without an upper bound: is there a longer path?"""
        return [text for text, longer in self.probes if not longer.isEmpty()]


def walk(e: Expr):
    yield e
    for a in e.args:
        if isinstance(a, Expr):
            yield from walk(a)


def text(e: Expr) -> str:
    return f"{e.op}({e.value};{','.join(text(a) if isinstance(a, Expr) else str(a) for a in e.args)})"


def element_of(e: Expr) -> tuple[str, str] | None:
    """(variable, what of it) of an element of a list that a variable holds: ``r[0]``, ``head(relationships(p))``."""
    if e.op == "index" or e.op == "fn" and e.value in ("head", "last"):
        base = e.args[0]
        if base.op == "fn" and base.value == "relationships" and base.args[0].op == "var":
            return base.args[0].value, "rels"
        if base.op == "fn" and base.value == "reverse":
            return element_of(Expr("index", [base.args[0], e], None, e.token))
        if base.op == "var":
            return base.value, ""
    return None


def edge_end(e: Expr) -> tuple[str, str] | None:
    """(startnode or endnode, variable) of ``startNode(r)``."""
    if e.op == "fn" and e.value in ("startnode", "endnode") and e.args[0].op == "var":
        return e.value, e.args[0].value
    return None


def conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return [c for a in e.args for c in conjuncts(a)] if e.op == "bin" and e.value == "AND" else [e]


def variables(e: Expr) -> set[str]:
    return {x.value for x in walk(e) if x.op == "var"}


class Compiler:
    def __init__(self, graph: PropertyGraph, params: dict[str, Any] | None = None, max_depth: int = MAX_DEPTH):
        self.graph, self.params, self.max_depth = graph, params or {}, max_depth
        self.probes: list[tuple[str, DataFrame]] = []
        self.json: set[str] = set()
        #: Whether the rows so far are few: a LIMIT or a total.
        self.few = False
        #: Columns that rows were last ordered by, and whether downwards: collect() gives its elements in this order.
        self.order: list[tuple[str, bool]] = []
        #: Where nothing but count(*) is asked of the matches: the variables asked for after each of them, and the column that counts alike rows.
        self.asked_after: list[set[str]] | None = None
        self.weight: str | None = None
        #: Properties of elements of lists, by their expression's text.
        self.looked: dict[str, S.Value] = {}
        self.fresh = 0
        self.used: dict[str, set[str]] = {}
        self.local: dict[str, list[Expr]] = {}
        self.needs_id: set[int] = set()
        self.outer: tuple[DataFrame | None, dict[str, Bound]] = (None, {})
        #: Of columns of node ids: the one label that they have, and the column of the key that stands for them.
        self.keys: dict[str, tuple[str, str]] = {}

    def same(self, a: str, b: str) -> Column:
        """Two columns of node ids are equal: by their keys where both have one label, so that no id has to be made for a join."""
        one, two = self.keys.get(a), self.keys.get(b)
        return F.col(one[1]) == F.col(two[1]) if one and two and one[0] == two[0] else F.col(a) == F.col(b)

    def new(self, what: str) -> str:
        self.fresh += 1
        return f"_{what}{self.fresh}"

    # What of a variable a query looks at: property names, or * for all.

    def survey(self, clauses: list) -> None:
        def look(e: Expr, bare: str) -> None:
            if e.op == "var":
                self.used.setdefault(e.value, set()).add(bare)
                return
            if e.op == "prop" and e.args[0].op == "var":
                self.used.setdefault(e.args[0].value, set()).add(e.value)
                return
            if e.op == "prop" and (of := element_of(e.args[0])):
                self.used.setdefault(of[0], set()).update({"bound", f"[]{e.value}"})
                for a in e.args[0].args[1:]:
                    look(a, "*")
                return
            if e.op == "prop" and (end := edge_end(e.args[0])):
                self.used.setdefault(end[1], set()).update({"id", f"{end[0]}~{e.value}"})
                return
            if e.op == "agg" and e.value == ("count", False) and e.args and e.args[0].op == "var":
                self.used.setdefault(e.args[0].value, set()).add("bound")
                return
            inner = "*"
            if e.op == "fn" and e.value in ("id", "type", "startnode", "endnode") or e.op == "agg" and e.value[0] == "count" or e.op == "isnull" or e.op == "bin" and e.value in ("=", "<>"):
                inner = "id"
            elif e.op == "haslabel" or e.op == "fn" and e.value == "labels":
                inner = "labels"
            for a in e.args:
                look(a, inner)

        for c in clauses:
            if isinstance(c, Match):
                for e in [v for p in c.paths for x in (*p.nodes, *p.rels) for v in x.props.values()] + ([c.where] if c.where else []):
                    look(e, "*")
            elif isinstance(c, Unwind):
                look(c.expr, "*")
            else:
                if c.star and c.final:
                    self.used.setdefault("*", set()).add("*")
                for i in c.items:
                    look(i.expr, "*" if c.final or i.expr.op == "var" and i.name != i.expr.value else "id")
                for e, _ in c.order:
                    look(e, "id")
                if c.where:
                    look(c.where, "*")

    def wants(self, var: str | None) -> set[str]:
        return (self.used.get(var, set()) if var else set()) | ({"*"} if "*" in self.used.get("*", ()) and var else set())

    # Queries

    def single(self, clauses: list) -> tuple[DataFrame, list[tuple[str, str]]]:
        self.used, self.few, self.looked, self.order = {}, False, {}, []
        self.survey(clauses)
        self.asked_after, self.weight = self.only_counted(clauses), None
        df: DataFrame | None = None
        env: dict[str, Bound] = {}
        for i, c in enumerate(clauses):
            if isinstance(c, Match):
                kept = self.asked_after[i] if self.asked_after else None
                paired = self.pairs(env, c, kept) if kept is not None and df is None else None
                df = self.match(df, env, c) if paired is None else paired
                if kept is not None and i + 2 < len(clauses):
                    df = self.alike(df, env, kept)
            elif isinstance(c, Unwind):
                df = self.unwind(df, env, c)
            else:
                df, env, kinds = self.project(self.one_row() if df is None else df, env, c)
                self.few = bool(c.limit) or self.few or all(contains_aggregate(i.expr) for i in c.items) and bool(c.items) and not c.star
        return df, kinds

    # Matches of which only the number is asked

    def only_counted(self, clauses: list) -> list[set[str]] | None:
        """If a query is matches and a projection that counts their rows and nothing else: the variables that are asked for after each match."""
        *matches, last = clauses
        if not matches or any(not isinstance(m, Match) or m.optional for m in matches) or not isinstance(last, Project) or last.star:
            return None
        shown = [i.expr for i in last.items] + [e for e, _ in last.order]
        sums = [x for e in shown for x in walk(e) if x.op == "agg"]
        if not sums or any(x.value != ("count", False) or x.args for x in sums):
            return None
        after = [set().union(*(variables(e) for e in shown))]
        for m in reversed(matches[1:]):
            named = {x.var for p in m.paths for x in (p, *p.nodes, *p.rels) if x.var}
            inside = [e for p in m.paths for x in (*p.nodes, *p.rels) for e in x.props.values()] + ([m.where] if m.where else [])
            after.append(after[-1] | named | set().union(*(variables(e) for e in inside)))
        return after[::-1]

    def alike(self, df: DataFrame, env: dict[str, Bound], kept: set[str]) -> DataFrame:
        """The different rows of the variables that are still asked for, with how many there are of each: later hops meet each once."""
        own = {v: b for v, b in env.items() if v in kept}
        if any(b.kind != "node" for b in own.values()):
            return df
        by, rest = [], []
        for b in own.values():
            known = self.keys.get(b.cols["id"])
            decides = known[1] if known else b.cols["id"]
            by.append(decides)
            rest += [F.first(F.col(c)).alias(c) for c in b.cols.values() if c != decides]
        number = F.sum(F.col(self.weight)) if self.weight else F.count(F.lit(1))
        self.weight = self.new("c")
        env.clear()
        env.update(own)
        return df.groupBy(*by).agg(number.alias(self.weight), *rest).filter(F.col(self.weight) > 0)

    def pairs(self, env: dict[str, Bound], m: Match, kept: set[str]) -> DataFrame | None:
        """Two hops that meet in a node, where only that node is asked for: its ids with the number of pairs of different relationships.

        Of l and r relationships of a node that fit the one and the other side, l * r pairs are made, less those of a relationship with itself."""
        path = m.paths[0]
        if len(m.paths) > 1 or len(path.rels) != 2 or path.var or any(r.var or r.hops or r.direction == "both" for r in path.rels):
            return None
        a, n, b = path.nodes
        if not n.var or n.var in (a.var, b.var) or a.var and a.var == b.var or {a.var, b.var} & kept or m.where and not variables(m.where) <= {n.var}:
            return None
        if any(x.op == "var" for y in (*path.nodes, *path.rels) for e in y.props.values() for x in walk(e)):
            return None
        types = [set(r.types) for r in path.rels]
        meet = not types[0] or not types[1] or bool(types[0] & types[1])
        self.needs_id, self.outer = {id(r) for r in path.rels} if meet else set(), (None, env)
        self.local = {n.var: conjuncts(m.where)} if m.where else {}
        sides = []
        for nodes, rel in (([a, n], path.rels[0]), ([n, b], path.rels[1])):
            rels: list = []
            df, found = self.path(Path(None, nodes, [rel]), env, {}, {}, [], rels)
            sides.append((df, found[n.var], rels[0][1]))
        (left, mid, edge), (right, other, other_edge) = sides
        keys = [self.keys.get(x.cols["id"]) for x in (mid, other)]
        keyed = bool(keys[0] and keys[1] and keys[0][0] == keys[1][0])
        by = keys[0][1] if keyed else mid.cols["id"]
        shown = [c for c in mid.cols.values() if c != by]
        e, l, r = self.new("e"), self.new("l"), self.new("r")
        none = F.lit(None)
        ones = left.select(by, *shown, (edge if meet else none.cast("string")).alias(e), F.lit(1).alias(l), F.lit(0).alias(r))
        twos = right.select(F.col(keys[1][1] if keyed else other.cols["id"]).alias(by), *(none.cast(left.schema[c].dataType).alias(c) for c in shown), (other_edge if meet else none.cast("string")).alias(e), F.lit(0).alias(l), F.lit(1).alias(r))
        firsts = [F.first(c, ignorenulls=True).alias(c) for c in shown]
        each = ones.unionByName(twos).filter(F.col(by).isNotNull()).groupBy(by, e).agg(F.sum(l).alias(l), F.sum(r).alias(r), *firsts)
        self.weight = self.new("c")
        number = F.sum(l) * F.sum(r) - (F.sum(F.col(l) * F.col(r)) if meet else F.lit(0))
        out = each.groupBy(by).agg(number.alias(self.weight), *firsts).filter(F.col(self.weight) > 0)
        env[n.var] = mid
        return out.filter(S.boolean(self.value(m.where, env), "WHERE")) if m.where else out

    def one_row(self) -> DataFrame:
        return self.graph.spark.range(1).select(F.lit(1).alias("_one"))

    def unwind(self, df: DataFrame | None, env: dict[str, Bound], c: Unwind) -> DataFrame:
        v = self.value(c.expr, env)
        if v.type != "list":
            raise CypherError("runtime", "UNWIND needs a list", c.token.line, c.token.column)
        col = self.new("u")
        out = (self.one_row() if df is None else df).withColumn(col, F.explode(v.col))
        env[c.var] = Bound("value", {"": col}, value=S.Value(F.col(col), v.item, whole=v.whole))
        return out

    # Patterns

    def match(self, df: DataFrame | None, env: dict[str, Bound], m: Match) -> DataFrame:
        keys: dict[str, str] = {}  # bound variables by their stand-in here
        own: dict[str, Bound] = {}
        later: list[tuple[Any, Expr, Any]] = []
        rels: list[tuple[set[str] | None, Column, bool]] = []
        inside: DataFrame | None = None
        # Conditions on one new node alone hold before any hop.
        alone = [(next(iter(variables(c))), c) for c in conjuncts(m.where) if len(variables(c)) == 1 and not contains_aggregate(c)]
        self.local = {v: [c for w, c in alone if w == v] for v, _ in alone if v not in env}
        hops = [r for p in m.paths for r in p.rels]
        m = replace(m, paths=[self.turned(p, env) for p in m.paths])
        self.needs_id = {id(r) for p in m.paths for r in p.rels if p.var or r.hops or any(o is not r and (not r.types or not o.types or set(r.types) & set(o.types)) for o in hops)}
        self.crossed = {id(r) for r in hops if any(o is not r and (not r.types or not o.types or set(r.types) & set(o.types)) for o in hops)}
        self.outer = (df, env)
        grows = df is not None and not m.optional
        if grows:
            inside = df
        for path in m.paths:
            if grows and (self.few or not self.selective(path, env)) and any(n.var in env or n.var in own for n in path.nodes):
                inside, found = self.path(path, env, own, keys, later, rels, inside)
                own |= {k: v for k, v in found.items() if k not in own and k not in env}
                continue
            part, found = self.path(path, env, own, keys, later, rels)
            shared = [self.same(own[v].cols["id"], found[v].cols["id"]) for v in found if v in own]
            if grows:  # to the rows so far by what they hold
                shared += [self.same(env[keys[k]].cols["id"], found[k].cols["id"]) for k in found if k in keys and k not in own]
            if inside is None:
                inside = part
            elif shared:
                inside = inside.join(part, reduce(lambda a, b: a & b, shared))
            else:
                inside = inside.crossJoin(part)
            own |= {k: v for k, v in found.items() if k not in own}
        for i, (types, a, a_list) in enumerate(rels):  # no edge twice in one MATCH
            for other, b, b_list in rels[:i]:
                if types is None or other is None or types & other:
                    inside = inside.filter(~F.arrays_overlap(a, b) if a_list and b_list else ~F.array_contains(a, b) if a_list else ~F.array_contains(b, a) if b_list else a != b)
        joined = env | {k: v for k, v in own.items() if k not in keys}
        tests = [self.same(env[v].cols["id"], own[k].cols["id"]) for k, v in keys.items()]
        asked = [e for c in ([m.where] if m.where else []) for e in walk(c)]
        inside = self.lookups(inside, joined if grows or df is None else own, asked)
        for bound, expr, prop in later:
            tests.append(S.equal(self.property(bound, prop), self.value(expr, joined)))
        if m.where:
            where = S.boolean(self.value(m.where, joined), "WHERE")
            tests.append(where)
        env |= {k: v for k, v in own.items() if k not in keys}
        if not m.optional:
            return reduce(DataFrame.filter, tests, inside)
        df = self.one_row() if df is None else df
        condition = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
        return df.join(inside, condition, "left")

    def turned(self, path: Path, env: dict[str, Bound]) -> Path:
        """A cycle of different nodes, begun so that its last relationship is one of which two nodes have one at most: closing it then makes
        no further rows, and the hops that would make rows for nothing aren't walked."""
        names = [n.var for n in path.nodes]
        if path.var or len(path.rels) < 3 or not names[0] or names[0] != names[-1] or any(r.hops or r.direction == "both" for r in path.rels) or any(v in env for v in names if v):
            return path
        if any(path.nodes[-1].props) or len(set(filter(None, names[1:]))) < len(list(filter(None, names[1:]))):
            return path
        nodes, rels = path.nodes[:-1], path.rels
        nodes = [replace(nodes[0], labels=[*nodes[0].labels, *(x for x in path.nodes[-1].labels if x not in nodes[0].labels)]), *nodes[1:]]
        for k in range(len(rels), 0, -1):  # as it stands first
            if rels[k - 1].types and self.graph.single(rels[k - 1].types):
                if k == len(rels):
                    return path
                first = nodes[k] if nodes[k].var else replace(nodes[k], var=self.new("v"))
                around = [first, *nodes[k + 1 :], *nodes[:k]]
                return Path(None, [*around, replace(first, labels=[], props={})], rels[k:] + rels[:k])
        return path

    def selective(self, path: Path, env: dict[str, Bound]) -> bool:
        """Whether some new node of the path is looked for by its properties."""
        return any((n.props or self.local.get(n.var)) and n.var not in env for n in path.nodes)

    def path(self, path: Path, env: dict[str, Bound], own: dict[str, Bound], keys: dict[str, str], later: list, rels: list, rows: DataFrame | None = None) -> tuple[DataFrame, dict[str, Bound]]:
        """The path by itself: each variable of it new, those bound before under stand-in names. With rows: the rows, grown by the path."""
        found: dict[str, Bound] = {}

        def stand_in(var: str | None, kind: str) -> str:
            if var is None:
                return self.new("v")
            if var in env:
                if env[var].kind != kind:
                    raise CypherError("syntax", f"{var} is a {env[var].kind}, not a {kind}")
                if rows is not None and kind == "node":
                    found[var] = env[var]
                    return var
                k = next((k for k, v in keys.items() if v == var), None) or self.new(f"k_{var}_")
                keys[k] = var
                return k
            return var

        names = [stand_in(n.var, "node") for n in path.nodes]
        self.path_props(path)
        df, hops = None, list(zip(path.rels, path.nodes[1:], names[1:], strict=True))
        if rows is not None:
            found |= {n: own[n] for n in names if n in own}
            df = self.grow(path, names, found, own, later, rels, rows, stand_in)
            return self.bind_path(path, names, df, found), found
        if not hops:
            return self.scan(path.nodes[0], names[0], found, later, self.wants(path.nodes[0].var) if names[0] == path.nodes[0].var else {"id"}), found
        for i, (rel, node, name) in enumerate(hops):
            before, before_name = path.nodes[i], names[i]
            rel_name = stand_in(rel.var, "rels" if rel.hops else "rel")
            from_end = rel.hops and df is None and len(hops) == 1 and name not in own and name != before_name
            from_end = from_end and self.reach(node, name) > self.reach(before, before_name)
            if rel.hops and before_name not in own and not from_end and (df is not None or self.reach(before, before_name)):
                # Trails grow from the rows so far, which are carried through the hops.
                df = self.start_rows(before, before_name, found, later, own) if df is None else df
                chained = self.chained(rel, rel_name, before, found, df, found[before_name].cols["id"])
                df, end = chained or self.trails(rel, rel_name, found, rels, df, found[before_name].cols["id"])
                df = self.attach(df, node, name, end, found, later, rel, "out" if rel.direction == "in" else "in", own)
                continue
            if from_end:  # More is known of the end: the same from there.
                df = self.start_rows(node, name, found, later, own)
                df, end = self.trails(rel, rel_name, found, rels, df, found[name].cols["id"], back=True)
                df = self.attach(df, before, before_name, end, found, later, rel, "in" if rel.direction == "in" else "out", own)
                continue
            near = "source" if (rel.direction == "in") == (df is None and not self.constrained(before, before_name) and self.constrained(node, name)) else "target"
            hop, start, end = self.hop(rel, rel_name, found, later, rels, near)
            if df is None:
                df = hop
                df = self.attach(df, before, before_name, start, found, later, rel, "in" if rel.direction == "in" else "out", own)
            else:
                df = df.join(hop, self.same(found[before_name].cols["id"], start))
            df = self.attach(df, node, name, end, found, later, rel, "out" if rel.direction == "in" else "in", own)
        return self.bind_path(path, names, df, found), found

    def grow(self, path: Path, names: list[str], found: dict[str, Bound], own: dict[str, Bound], later: list, rels: list, rows: DataFrame, stand_in) -> DataFrame:
        """The rows, grown hop by hop outward from a node of the path that they hold."""
        known = [i for i, n in enumerate(names) if n in found]
        for i in known:
            rows = self.checked(rows, path, i, found[names[i]], later)
        at = known[0] if known[-1] != len(names) - 1 or known[0] == 0 else known[-1]
        right, left = [(i, i + 1) for i in range(at, len(path.rels))], [(i + 1, i) for i in range(at - 1, -1, -1)]
        for here, there in right + left:
            rel, back = path.rels[min(here, there)], there < here
            name = stand_in(rel.var, "rels" if rel.hops else "rel")
            side = "source" if (rel.direction == "in") != back else "target"
            begin = found[names[here]].cols["id"]
            if rel.hops:
                rows, end = self.trails(rel, name, found, rels, rows, begin, back)
            else:
                hop, start, end = self.hop(rel, name, found, later, rels, {"source": "target", "target": "source"}[side])
                start, end = (end, start) if back else (start, end)
                rows = rows.join(hop, self.same(begin, start))
            rows = self.attach(rows, path.nodes[there], names[there], end, found, later, rel, "out" if side == "source" else "in", own)
        return rows

    def checked(self, rows: DataFrame, path: Path, i: int, bound: Bound, later: list) -> DataFrame:
        """The rows in which a node bound before is what the path says of it."""
        p = path.nodes[i]
        near = [(path.rels[i - 1], "target")] if i else []
        near += [(path.rels[i], "source")] if i < len(path.rels) else []
        for rel, side in near:
            ends, complete = self.graph.ends(rel.types or None, side if rel.direction == "out" else {"source": "target", "target": "source"}[side])
            if p.labels and not p.props and rel.direction != "both" and not rel.hops and complete and ends == set(p.labels) and len(ends) == 1:
                return rows
        if not p.labels and not p.props:
            return rows
        mine: dict[str, Bound] = {}
        fitting = self.scan(p, self.new("v"), mine, later, {"id"})
        return rows.join(fitting, self.same(bound.cols["id"], next(iter(mine.values())).cols["id"]))

    def path_props(self, path: Path) -> None:
        """Properties of a path's relationships that are asked for through it are wanted of each of them."""
        asked = {w[2:] for w in self.wants(path.var) if w.startswith("[]")} if path.var else set()
        if path.var:
            self.listed = self.listed | {id(r): path.rels for r in path.rels}
        self.rel_props = self.rel_props | {id(r): asked | {w[2:] for w in self.wants(r.var) if w.startswith("[]")} for r in path.rels}

    def bind_path(self, path: Path, names: list[str], df: DataFrame, found: dict[str, Bound]) -> DataFrame:
        if path.var:
            ids = [found[n].cols["id"] for n in names]
            nodes = F.array(F.struct(F.col(ids[0]).alias("id")))
            edges = None
            props = self.shared_props(path.rels)
            for rel, b in zip(path.rels, ids[1:], strict=True):
                own_rel = found[self.rel_names[id(rel)]]
                if own_rel.kind == "rels":
                    step, between = F.col(own_rel.cols["list"]), F.transform(F.col(own_rel.cols["ends"]), lambda x: F.struct(x.alias("id")))
                else:
                    step, between = F.array(self.rel_struct(own_rel, props)), F.array(F.struct(F.col(b).alias("id")))
                edges = step if edges is None else F.concat(edges, step)
                nodes = F.concat(nodes, between)
            col = self.new("p")
            df = df.withColumn(col, F.struct(nodes.alias("nodes"), edges.alias("rels")))
            found[path.var] = Bound("path", {"": col}, value=S.Value(F.col(col), "path", ref=path.var, props=props))
        return df

    def shared_props(self, rels: list[RelPattern]) -> dict[str, Any]:
        """The asked properties of relationships that stand in one list, and their types."""
        kinds = self.graph.edge_props(sorted({t for r in rels for t in r.types}) if all(r.types for r in rels) else None)
        return {k: kinds[k] for k in sorted({k for r in rels for k in self.rel_props.get(id(r), ())}) if k in kinds}

    rel_names: dict[int, str] = {}
    rel_props: dict[int, set[str]] = {}

    def scan(self, p: NodePattern, name: str, found: dict[str, Bound], later: list, wants: set[str], among: set[str] | None = None) -> DataFrame:
        kinds = self.graph.node_props(p.labels)
        props = {k: t for k, t in kinds.items() if "*" in wants or k in wants or k in p.props}
        unknown = [k for k in p.props if k not in kinds and k != "stub"]
        label = self.one_table(p.labels, among)
        rows = self.graph.nodes(p.labels, props, among, **({"stubs": False, "key": True} if label else {}))
        prefix = self.new("n")
        cols = {c: f"{prefix}_{c}" for c in rows.columns}
        rows = rows.toDF(*cols.values())
        if label:
            self.keys[cols["id"]] = (label, cols.pop("_key"))
        found[name] = Bound("node", cols, props)
        for k, e in p.props.items():
            if k in unknown:
                rows = rows.filter(F.lit(False))
            elif any(x.op == "var" for x in walk(e)):
                later.append((found[name], e, k))
            else:
                rows = rows.filter(S.equal(self.property(found[name], k), self.value(e, {})))
        for e in self.local.get(name, ()):
            rows = rows.filter(S.boolean(self.value(e, {name: found[name]}), "WHERE"))
        return rows

    def one_table(self, labels: list[str], among: set[str] | None) -> str | None:
        """The label whose table alone is looked in, if its nodes have a key."""
        tables = self.graph.node_tables
        fitting = [x for x in tables if (among is None or x in among) and all(y in (x, *tables[x].more_labels) or tables[x].label_column for y in labels or ())]
        fitting = fitting if labels or among is not None else []
        return fitting[0] if len(fitting) == 1 and tables[fitting[0]].key else None

    def constrained(self, p: NodePattern, name: str) -> bool:
        """Whether a node is one of few: by properties, a condition, or as bound before."""
        return bool(p.props or self.local.get(name) or name != p.var and p.var in self.outer[1])

    def reach(self, p: NodePattern, name: str) -> int:
        """How much is known of a node that trails could start from: 2 if it is one of few, 1 if its labels are known, else 0."""
        return 2 if self.constrained(p, name) else int(bool(p.labels))

    def start_rows(self, p: NodePattern, name: str, found: dict[str, Bound], later: list, own: dict[str, Bound]) -> DataFrame:
        """The rows of a node that a variable-length hop starts from; of one bound before, its different ids."""
        outer, env = self.outer
        if name != p.var and p.var in env and outer is not None:
            col = self.new("n")
            found[name] = Bound("node", {"id": col})
            return outer.select(F.col(env[p.var].cols["id"]).alias(col)).distinct()
        return self.scan(p, name, found, later, self.wants(p.var) if name == p.var and name not in own else {"id"})

    def attach(self, df: DataFrame, p: NodePattern, name: str, end: str, found: dict[str, Bound], later: list, rel: RelPattern, side: str, own: dict[str, Bound]) -> DataFrame:
        """Binds the node at column ``end``."""
        if name in found:  # a cycle in this path
            return df.filter(self.same(found[name].cols["id"], end))
        wants = self.wants(p.var) if name == p.var and name not in own else {"id"}
        labels, complete = self.graph.ends(rel.types or None, "source" if side == "out" else "target")
        if rel.direction == "both" or rel.hops:
            other, also = self.graph.ends(rel.types or None, "target" if side == "out" else "source")
            labels, complete = labels | other, complete and also
        implied = not p.labels or (complete and labels == set(p.labels) and len(p.labels) == 1)
        if implied and not p.props and wants <= {"id"}:
            found[name] = Bound("node", {"id": end})
            return df
        among = labels if complete and labels else None
        rows = self.scan(p, name, found, later, wants, among)
        return df.join(rows, self.same(end, found[name].cols["id"]))

    def edge_rows(self, rel: RelPattern, props: dict[str, Any], with_id: bool, near: str | None = None) -> DataFrame:
        ends = () if rel.hops or rel.direction == "both" else tuple(s for s in ("source", "target") if self.graph.native(rel.types or None, s))
        rows = self.graph.edges(rel.types or None, props, with_id, **({"keys": ends} if ends else {}), **({"near": near} if near and rel.direction != "both" else {}))
        start, end = F.col("source"), F.col("target")
        if rel.direction == "out":
            return rows.withColumns({"start": start, "end": end})
        if rel.direction == "in":
            return rows.withColumns({"start": end, "end": start})
        there = rows.withColumns({"start": start, "end": end})
        return there.unionByName(rows.filter(start != end).withColumns({"start": end, "end": start}))

    def filtered_edges(self, rel: RelPattern, name: str, near: str | None = None) -> tuple[DataFrame, dict[str, Any]]:
        """The edges that a relationship can be, and their properties. Their ids are worked out only if something asks for them."""
        kinds = self.graph.edge_props(rel.types or None)
        wants = self.wants(rel.var)
        props = {k: t for k, t in kinds.items() if k not in ("id", "sign") and ("*" in wants or k in wants or k in rel.props or k in self.rel_props.get(id(rel), ()))}
        with_id = bool({"*", "id"} & wants) or id(rel) in self.needs_id or name != rel.var or "id" in rel.props or any("~" in x for x in wants)
        rows = self.edge_rows(rel, props, with_id, near if self.graph.by_end else None)
        bound = Bound("rel", {c: c for c in rows.columns}, props)
        for k, e in rel.props.items():
            if k not in kinds and k not in ("id", "sign"):
                rows = rows.filter(F.lit(False))
            elif rel.hops or not any(x.op == "var" for x in walk(e)):
                rows = rows.filter(S.equal(self.property(bound, k), self.value(e, {})))
        for end, column in (("startnode", "source"), ("endnode", "target")):
            asked = [w.partition("~")[2] for w in wants if w.startswith(f"{end}~")]
            if asked and not rel.hops:
                known = {k: t for k, t in self.graph.node_props(None).items() if k in asked}
                nodes = self.graph.nodes(None, known).select(F.col("id").alias("_end"), *(F.col(c).alias(f"{end}~{c}") for c in known))
                rows = rows.join(nodes, F.col(column) == F.col("_end"), "left").drop("_end")
                props |= {f"{end}~{k}": t for k, t in known.items()}
        return rows, props

    def hop(self, rel: RelPattern, name: str, found: dict[str, Bound], later: list, rels: list, near: str | None = None) -> tuple[DataFrame, str, str]:
        """The edges of a relationship with their start and end. near: the end (source or target) that the rows so far are joined to."""
        self.rel_names = {**self.rel_names, id(rel): name}
        kinds = self.graph.edge_props(rel.types or None)
        rows, props = self.filtered_edges(rel, name, near)
        prefix = self.new("r")
        types = set(rel.types) or None
        if rel.hops:
            steps = self.steps(rows)
            starts = self.graph.nodes(None, {}).select("id") if rel.hops[0] == 0 else steps.select(F.col("from").alias("id")).distinct()
            first = self.new("n")
            out, last = self.trails(rel, name, found, rels, starts.toDF(first), first)
            return out, first, last
        cols = {c: f"{prefix}_{c}" for c in rows.columns}
        rows = rows.toDF(*cols.values())
        for place, side in (("start", "source"), ("end", "target")) if rel.direction != "in" else (("start", "target"), ("end", "source")):
            if key := cols.pop(f"{side}_key", None):
                self.keys[cols[place]] = (self.graph.native(rel.types or None, side), key)
        found[name] = Bound("rel", cols, props)
        later += [(found[name], e, k) for k, e in rel.props.items() if (k in kinds or k in ("id", "sign")) and any(x.op == "var" for x in walk(e))]
        rels.append((types, F.col(cols["id"]), False))
        return rows, cols["start"], cols["end"]

    def steps(self, rows: DataFrame, props: dict[str, Any] | None = None) -> DataFrame:
        """The edge of each step, the asked properties in it, and its ends in the direction of the pattern."""
        kept = [F.struct(*((F.col(k) if k in rows.columns else F.lit(None)).cast(t).alias(k) for k, t in props.items())).alias("properties")] if props else []
        return rows.select(F.struct("id", "type", "sign", "source", "target", *kept).alias("edge"), F.col("start").alias("from"), F.col("end").alias("to"))

    def chained(self, rel: RelPattern, name: str, before: NodePattern, found: dict[str, Bound], df: DataFrame, at: str) -> tuple[DataFrame, str] | None:
        """Trails of one length whose steps each have edge tables of their own, and of which only properties are asked: no edge can come
        twice, so that no ids are worked out, and steps carry nothing but what is asked."""
        low, high = rel.hops
        labels = {x for x, t in self.graph.node_tables.items() if all(y in (x, *t.more_labels) or t.label_column for y in before.labels)} if before.labels else set()
        asked = self.wants(rel.var)
        if not labels or low != high or not low or rel.direction == "both" or rel.props or id(rel) in self.listed or id(rel) in self.crossed or name != rel.var and rel.var:
            return None
        if any(w != "bound" and (not w.startswith("[]") or w == "[]id") for w in asked):
            return None
        sides = ("source", "target") if rel.direction == "out" else ("target", "source")
        tables = self.graph.chain(rel.types or None, labels, sides, high)
        if not tables or any(t is x for i, ts in enumerate(tables) for us in tables[:i] for t in ts for x in us):
            return None
        self.rel_names = {**self.rel_names, id(rel): name}
        props = self.shared_props([rel])
        prefix = self.new("r")
        last, steps, ends = (f"{prefix}_{c}" for c in ("last", "list", "ends"))
        carried, none = df.columns, F.lit(None)
        known = self.keys.get(at)
        now, key = df.withColumn(last, F.col(at)), known[1] if known else None
        kept, fields = [], {"id": "string", "type": "string", "sign": "int", "source": "string", "target": "string"}
        for i, among in enumerate(tables):
            native = [self.graph.native(rel.types or None, side, among) for side in sides]
            rows = self.graph.edges(rel.types or None, props, False, tuple(s for s, n in zip(sides, native, strict=True) if n), among=among)
            here, there, step_key = (f"{prefix}_{c}{i}" for c in ("here", "there", "key"))
            own = {c: f"{prefix}_{c}_{i}" for c in [*(c for c in fields if f"[]{c}" in asked), *props]}  # plain columns until all hops are joined
            by_key = bool(key and known and native[0] == known[0])
            step = rows.select(F.col(f"{sides[0]}_key" if by_key else sides[0]).alias(here), F.col(sides[1]).alias(there), *(F.col(c).alias(x) for c, x in own.items()), *([F.col(f"{sides[1]}_key").alias(step_key)] if native[1] else []))
            now = now.join(step, F.col(key if by_key else last) == F.col(here)).drop(here, last).withColumnRenamed(there, last)
            inside = [F.struct(*(F.col(own[k]).cast(t).alias(k) for k, t in props.items())).alias("properties")] if props else []
            kept.append(F.struct(*((F.col(own[c]) if c in own else none.cast(t)).alias(c) for c, t in fields.items()), *inside))
            known, key = ((native[1], step_key), step_key) if native[1] else (None, None)
        now = now.select(*carried, last, *([key] if key else []), F.array(*kept).alias(steps), F.array().cast("array<string>").alias(ends))
        if known:
            self.keys[last] = known
        found[name] = Bound("rels", {"list": steps, "ends": ends}, value=S.Value(F.col(steps), "list", "rel", props=props))
        return now, last

    def trails(self, rel: RelPattern, name: str, found: dict[str, Bound], rels: list, df: DataFrame, at: str, back: bool = False) -> tuple[DataFrame, str]:
        """The rows of df, once for each trail from the node in column ``at`` (``back``: to it), and the column of the trail's other end."""
        self.rel_names = {**self.rel_names, id(rel): name}
        low, high = rel.hops
        bounded = high is not None
        high = self.max_depth if high is None else high
        props = self.shared_props(self.listed.get(id(rel), [rel]))
        step = self.steps(self.filtered_edges(rel, name, "target" if (rel.direction == "in") != back else "source")[0], props)
        edge = step.schema["edge"].dataType.simpleString()
        prefix = self.new("r")
        last, steps, ends = (f"{prefix}_{c}" for c in ("last", "list", "ends"))
        carried = df.columns
        now = df.select(*carried, F.col(at).alias(last), F.array().cast(f"array<{edge}>").alias(steps), F.array().cast("array<string>").alias(ends))
        here, there = ("to", "from") if back else ("from", "to")

        def longer(now: DataFrame) -> DataFrame:
            unused = ~F.exists(steps, lambda x: x["id"] == F.col("edge.id"))
            grow = (lambda a, x: F.array_prepend(a, x)) if back else (lambda a, x: F.array_append(a, x))
            return now.join(step, (F.col(last) == F.col(here)) & unused).select(*carried, F.col(there).alias(last), grow(F.col(steps), F.col("edge")).alias(steps), grow(F.col(ends), F.col("to")).alias(ends))

        if low == high or high <= 1:
            frames = [now] if low == 0 else []
            for _ in range(high):
                now = longer(now)
            frames += [now] if high or not frames else []
            out = reduce(DataFrame.unionByName, frames)
        else:
            out = self.levels(now, step, carried, (last, steps, ends), edge, (here, there), low, high)
        if not bounded:
            widest = out.filter(F.size(steps) == high)
            self.probes.append((f"variable-length pattern without an upper bound: paths of over {high} edges are not looked for", longer(widest)))
        found[name] = Bound("rels", {"list": steps, "ends": ends}, value=S.Value(F.col(steps), "list", "rel", props=props))
        rels.append((set(rel.types) or None, F.transform(F.col(steps), lambda x: x["id"]), True))
        return out, last

    #: Relationships of a variable length by the path whose list they share.
    listed: dict[int, list[RelPattern]] = {}

    def levels(self, now: DataFrame, step: DataFrame, carried: list[str], own: tuple[str, str, str], edge: str, sides: tuple[str, str], low: int, high: int) -> DataFrame:
        """The rows of all levels from low to high: one join a level, each over the rows that the level before has found."""
        last, steps, ends = own
        here, there = sides
        self.fresh += 1
        start, edges, found = (f"_{x}{self.fresh}_{id(self):x}" for x in ("start", "edges", "found"))
        put = "array_prepend" if sides[0] == "to" else "array_append"
        keep = "".join(f"w.`{c}`, " for c in carried)
        spark = self.graph.spark
        if spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000":  # Spark's default stops larger results with an error
            spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        now.createOrReplaceTempView(start)
        step.createOrReplaceTempView(edges)
        try:
            out = spark.sql(f"""WITH RECURSIVE {found} AS (
                SELECT {keep.replace("w.", "")}`{last}`, `{steps}`, `{ends}`, 0 AS `{found}` FROM {start}
                UNION ALL
                SELECT {keep}s.`{there}`, CAST({put}(w.`{steps}`, s.edge) AS array<{edge}>), CAST({put}(w.`{ends}`, s.`to`) AS array<string>), w.`{found}` + 1
                FROM {found} w JOIN {edges} s ON w.`{last}` = s.`{here}` WHERE w.`{found}` < {high} AND NOT exists(w.`{steps}`, x -> x.id = s.edge.id)
            ) SELECT * FROM {found} WHERE `{found}` >= {low}""")
        finally:
            spark.catalog.dropTempView(start)
            spark.catalog.dropTempView(edges)
        return out.drop(found)

    # Expressions

    def property(self, b: Bound, key: str) -> S.Value:
        if b.kind == "node" and key == "stub":
            return S.Value(F.col(b.cols["stub"]), "boolean")
        if b.kind == "rel" and key == "id":
            return S.Value(F.col(b.cols["id"]), "string")
        if b.kind == "rel" and key == "sign":
            return S.Value(F.col(b.cols["sign"]), "number", whole=True)
        if key not in b.props:
            return S.null()
        return S.of_column(F.col(b.cols[key]), b.props[key])

    def element_property(self, v: S.Value, key: str) -> S.Value | None:
        """A property of a node or relationship in a list, as far as the list holds it."""
        if key == "id":
            return S.Value(v.col, "string")
        if v.type == "rel" and key in ("type", "source", "target", "sign"):
            return S.Value(v.struct[key], "number" if key == "sign" else "string", whole=key == "sign")
        if v.props is None:
            return None
        return S.of_column(v.struct["properties"][key], v.props[key]) if key in v.props else S.null()

    def lookups(self, df: DataFrame, env: dict[str, Bound], exprs: list[Expr], grouped: Any = None) -> DataFrame:
        """df with the properties that these expressions ask of single elements of lists of nodes: one join by id for each element."""
        wanted: dict[str, tuple[S.Value, dict[str, str]]] = {}
        for e in exprs:
            base = e.args[0] if e.args and isinstance(e.args[0], Expr) else None
            if base is None or not (e.op in ("prop", "haslabel") or e.op == "fn" and e.value == "labels") or base.op not in ("index", "fn", "var") or text(e) in self.looked:
                continue
            if not variables(base) <= set(env) and grouped is None or base.op == "var" and (base.value not in env or env[base.value].kind != "late"):
                continue
            v = self.value(base, env, grouped)
            if v.type == "node" and not v.ref and (e.op != "prop" or self.element_property(v, e.value) is None):
                wanted.setdefault(text(base), (v, {}))[1][text(e)] = e.value if e.op == "prop" else ""
        kinds = self.graph.node_props(None)
        for v, asked in wanted.values():
            props = {k: kinds[k] for k in asked.values() if k in kinds}
            prefix = self.new("e")
            rows = self.graph.nodes(None, props)
            rows = rows.toDF(*(f"{prefix}_{c}" for c in rows.columns))
            df = df.withColumn(prefix, v.col).join(rows, F.col(prefix) == F.col(f"{prefix}_id"), "left")
            for place, key in asked.items():
                if not key:
                    self.looked[place] = S.Value(F.col(f"{prefix}_labels"), "list", "string")
                else:
                    self.looked[place] = S.Value(F.col(f"{prefix}_stub"), "boolean") if key == "stub" else S.of_column(F.col(f"{prefix}_{key}"), props[key]) if key in props else S.null()
        return df

    def rel_struct(self, b: Bound, props: dict[str, Any]) -> Column:
        kept = [F.struct(*((F.col(b.cols[k]) if k in b.cols else F.lit(None)).cast(t).alias(k) for k, t in props.items())).alias("properties")] if props else []
        return F.struct(*(F.col(b.cols[c]).alias(c) for c in ("id", "type", "sign", "source", "target")), *kept)

    def reference(self, name: str, env: dict[str, Bound], token) -> S.Value:
        if name not in env:
            raise CypherError("syntax", f"variable {name} is not defined", token.line, token.column)
        b = env[name]
        if b.kind in ("value", "path", "rels", "late"):
            return b.value
        return S.Value(F.col(b.cols["id"]), b.kind, ref=name)

    def value(self, e: Expr, env: dict[str, Bound], grouped: Any = None) -> S.Value:
        """grouped: in an aggregating projection, gives the column of an aggregate or of a key."""
        if grouped is not None and (hit := grouped(e)) is not None:
            return hit
        if (e.op in ("prop", "haslabel") or e.op == "fn" and e.value == "labels") and (hit := self.looked.get(text(e))) is not None:
            if e.op == "haslabel":
                return S.Value(reduce(lambda a, b: a & b, [F.array_contains(hit.col, x) for x in e.value]), "boolean")
            return hit
        go = lambda x: self.value(x, env, grouped)
        try:
            return self.raw_value(e, env, go)
        except CypherError as err:
            if err.line or not e.token:
                raise
            raise CypherError(err.kind, str(err).partition(": ")[2], e.token.line, e.token.column) from None

    def raw_value(self, e: Expr, env: dict[str, Bound], go) -> S.Value:
        if e.op == "lit":
            return S.literal(e.value)
        if e.op == "param":
            if e.value not in self.params:
                raise CypherError("runtime", f"parameter ${e.value} is missing")
            return S.literal(self.params[e.value])
        if e.op == "var":
            return self.reference(e.value, env, e.token)
        if e.op == "prop":
            return self.member(e, env, go)
        if e.op == "index":
            v, i = go(e.args[0]), go(e.args[1])
            v = S.part(v, "list") if v.type == "mixed" and i.type == "number" else v
            if v.type == "list" and i.type == "number":
                n = i.col.cast("int")
                return S.element(v, F.try_element_at(v.col, F.when(n >= 0, n + 1).otherwise(n)))
            if v.type in ("map", "node", "rel") and e.args[1].op == "lit" and isinstance(e.args[1].value, str):
                return self.raw_value(Expr("prop", [e.args[0]], e.args[1].value, e.token), env, go)
            if "null" in (v.type, i.type):
                return S.null()
            raise CypherError("runtime", f"{v.type}[{i.type}]")
        if e.op == "haslabel":
            v = go(e.args[0])
            if v.type != "node":
                raise CypherError("runtime", "a label needs a node")
            return S.Value(reduce(lambda a, b: a & b, [F.array_contains(env[v.ref].cols["labels"], x) for x in e.value]), "boolean")
        if e.op == "list":
            return S.list_of([go(a) for a in e.args])
        if e.op == "map":
            values = [go(a) for a in e.args]
            return S.Value(F.struct(*(v.col.alias(k) for k, v in zip(e.value, values, strict=True))), "map", keys=tuple(e.value))
        if e.op == "not":
            return S.Value(~S.boolean(go(e.args[0]), "NOT"), "boolean")
        if e.op in ("neg", "pos"):
            v = go(e.args[0])
            c = S.only(v, "number", "a sign needs a number")
            return S.Value(-c if e.op == "neg" else c, "null" if v.type == "null" else "number", whole=v.whole)
        if e.op == "isnull":
            c = go(e.args[0]).col.isNull()
            return S.Value(~c if e.value else c, "boolean")
        if e.op == "case":
            pairs = [go(a) for a in e.args]
            out = None
            columns, like = S.united([*pairs[1::2], pairs[-1]])
            for c, v in zip(pairs[:-1:2], columns, strict=False):
                out = F.when(S.boolean(c, "WHEN"), v) if out is None else out.when(S.boolean(c, "WHEN"), v)
            return S.Value(out.otherwise(columns[-1]), like.type, like.item, like.whole, keys=like.keys)
        if e.op == "bin":
            return self.binary(e.value, go(e.args[0]), go(e.args[1]))
        if e.op == "fn":
            return self.function(e, env, go)
        raise CypherError("syntax", f"{e.op} can't stand here")

    def member(self, e: Expr, env: dict[str, Bound], go) -> S.Value:
        end = edge_end(e.args[0])
        if end and e.value != "id" and end[1] in env and env[end[1]].kind == "rel":
            b, key = env[end[1]], f"{end[0]}~{e.value}"
            return S.of_column(F.col(b.cols[key]), b.props[key]) if key in b.props else S.null()
        v = go(e.args[0])
        if v.type in ("node", "rel"):
            found = self.property(env[v.ref], e.value) if v.ref else self.element_property(v, e.value)
            if found is None:
                raise CypherError("runtime", "a property of a list's node can't be asked here: bind the node first")
            return found
        if v.type == "map":
            return S.Value(v.col[e.value], self.map_type(e, v)) if not v.keys or e.value in v.keys else S.null()
        if v.type == "null":
            return S.null()
        raise CypherError("runtime", f"a property of {v.type}")

    def map_type(self, e: Expr, v: S.Value) -> str:
        known = {"id": "string", "type": "string", "source": "string", "target": "string", "sign": "number"}
        return known.get(e.value, "string")

    def binary(self, op: str, a: S.Value, b: S.Value) -> S.Value:
        if op in ("AND", "OR", "XOR"):
            l, r = S.boolean(a, op), S.boolean(b, op)
            return S.Value({"AND": l & r, "OR": l | r, "XOR": l != r}[op], "boolean")
        if op in ("=", "<>"):
            c = S.equal(a, b)
            return S.Value(c if op == "=" else ~c, "boolean")
        if op in ("<", ">", "<=", ">="):
            return S.Value(S.compare(op, a, b), "boolean")
        if op == "IN":
            return S.Value(S.member(a, b), "boolean")
        if op in ("STARTS", "ENDS", "CONTAINS"):
            return S.Value(S.text_test(op, a, b), "boolean")
        if op == "=~":
            return S.Value(F.rlike(a.col, F.concat(F.lit("^(?:"), b.col, F.lit(")$"))), "boolean")
        return S.arithmetic(op, a, b)

    def function(self, e: Expr, env: dict[str, Bound], go) -> S.Value:
        name = e.value
        args = [go(a) for a in e.args]
        a = args[0] if args else S.null()
        b = env.get(a.ref) if a.ref else None
        if name == "id":
            return S.Value(a.col, "string") if a.type in ("node", "rel") else S.null()
        if name == "type":
            return S.null() if a.type != "rel" else S.Value(F.col(b.cols["type"]) if b else a.struct["type"], "string")
        if name == "labels":
            if a.type == "node" and not b:
                if a.props is None:
                    raise CypherError("runtime", "labels of a list's node can't be asked here: bind the node first")
                return S.Value(a.struct["labels"], "list", "string")
            return S.Value(F.col(b.cols["labels"]), "list", "string") if a.type == "node" else S.null()
        if name in ("startnode", "endnode"):
            if a.type != "rel":
                return S.null()
            side = "source" if name == "startnode" else "target"
            return S.Value(F.struct((F.col(b.cols[side]) if b else a.struct[side]).alias("id")), "map", keys=("id",))
        if name in ("keys", "properties") and a.type in ("node", "rel") and not b:
            raise CypherError("runtime", f"{name} of a list's element can't be asked here: bind it first")
        if name in ("keys", "properties") and a.type in ("node", "rel"):
            own = [k for k in b.props if "~" not in k and not (a.type == "rel" and k in self.graph.hidden)]
            if name == "properties":
                return S.Value(F.struct(*(F.col(b.cols[k]).alias(k) for k in own)) if own else F.struct(F.lit(None).alias("_")), "map", keys=tuple(own))
            return S.Value(F.array_compact(F.array(*(F.when(F.col(b.cols[k]).isNotNull(), F.lit(k)) for k in own))), "list", "string")
        if name == "properties" and a.type == "map":
            return a
        return S.call(name, args)

    # Projections

    def output(self, v: S.Value, env: dict[str, Bound]) -> Column:
        """A value as it leaves the query: nodes and edges as structs."""
        if v.type == "node" and v.ref:
            b = env[v.ref]
            props = F.struct(*(F.col(b.cols[k]).alias(k) for k in b.props)) if b.props else F.lit(None)
            return F.when(F.col(b.cols["id"]).isNotNull(), F.struct(F.col(b.cols["id"]).alias("id"), (F.col(b.cols["labels"]) if "labels" in b.cols else F.lit(None)).alias("labels"), (F.col(b.cols["stub"]) if "stub" in b.cols else F.lit(None)).alias("stub"), props.alias("properties")))
        if v.type in ("node", "rel") and not v.ref:
            return v.struct
        if v.type == "mixed":
            return S.json_text(v)
        if v.type == "list" and v.item == "mixed":
            return F.transform(v.col, lambda x: S.json_text(S.Value(x, "mixed", "flat")))
        if v.type == "rel":
            return F.when(F.col(env[v.ref].cols["id"]).isNotNull(), self.rel_struct(env[v.ref], {}))
        return v.col

    def aggregate(self, e: Expr, env: dict[str, Bound]) -> S.Value:
        name, distinct = e.value
        if name == "count":
            if not e.args:
                return S.Value(F.coalesce(F.sum(self.weight), F.lit(0)) if self.weight else F.count(F.lit(1)), "number", whole=True)
            v = self.value(e.args[0], env)
            c = F.col(env[v.ref].cols["type"]) if v.type == "rel" and v.ref and not distinct else v.col  # null only where the edge is
            if v.type == "node" and v.ref and (known := self.keys.get(env[v.ref].cols["id"])):
                c = F.col(known[1])
            return S.Value(F.count_distinct(c) if distinct else F.count(c), "number", whole=True)
        v = self.value(e.args[0], env)
        if name in ("sum", "avg", "stdev", "percentilecont"):
            if v.type not in ("number", "mixed", "null"):
                raise CypherError("runtime", f"{name} of {v.type}", e.token.line, e.token.column)
            v = S.Value(S.only(v, "number", f"{name} needs numbers"), "number", whole=v.whole)
        if name == "sum":
            return S.Value(F.coalesce(F.sum_distinct(v.col) if distinct else F.sum(v.col), F.lit(0)), "number", whole=v.whole)
        if name == "avg":
            return S.Value(F.avg(v.col) if not distinct else F.sum_distinct(v.col).cast("double") / F.nullif(F.count_distinct(v.col), F.lit(0)), "number")
        if name in ("min", "max"):
            return S.Value((F.min if name == "min" else F.max)(v.col), v.type, whole=v.whole)
        if name == "collect":
            c, props = self.output(v, env), v.props
            if v.type == "mixed":
                c = S.mixed(v, nested=True).col
            elif v.type in ("node", "rel") and v.ref:
                props = {k: t for k, t in env[v.ref].props.items() if "~" not in k and not (v.type == "rel" and k in self.graph.hidden)}
                c = F.when(v.col.isNotNull(), self.rel_struct(env[v.ref], props)) if v.type == "rel" else c
            rows = self.in_order(c) if self.order else F.collect_list(c)
            return S.Value(F.array_distinct(rows) if distinct else rows, "list", v.type, v.whole, props=props)
        if name == "stdev":
            return S.Value(F.stddev_samp(v.col), "number")
        p = self.value(e.args[1], env)
        return S.Value(F.percentile(v.col, p.col), "number")

    def in_order(self, c: Column) -> Column:
        """The values of a group in the order of its rows, wherever these came from; nulls are left out."""
        keys = [F.col(h).alias(f"k{i}") for i, (h, _) in enumerate(self.order)]
        found = F.collect_list(F.when(c.isNotNull(), F.struct(*keys, c.alias("v"))))

        def before(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for i, (_, down) in reversed(list(enumerate(self.order))):
                x, y = (b[f"k{i}"], a[f"k{i}"]) if down else (a[f"k{i}"], b[f"k{i}"])
                unlike = F.when(x.isNull(), F.lit(1)).when(y.isNull(), F.lit(-1)).when(x < y, F.lit(-1)).otherwise(F.lit(1))
                out = F.when(x.eqNullSafe(y), out).otherwise(unlike)
            return out

        return F.transform(F.array_sort(found, before), lambda x: x["v"])

    def number(self, e: Expr, what: str) -> int:
        v = e.value if e.op == "lit" else self.params.get(e.value) if e.op == "param" else None
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise CypherError("runtime", f"{what} needs a whole number from 0", e.token.line if e.token else 0, e.token.column if e.token else 0)
        return v

    def project(self, df: DataFrame, env: dict[str, Bound], c: Project) -> tuple[DataFrame, dict[str, Bound], list[tuple[str, str]]]:
        items = ([Item(Expr("var", value=k, token=c.token), k) for k in env if not k.startswith("_")] if c.star else []) + c.items
        aliases = {i.name: i.expr for i in items}
        order = [(aliases[e.value] if e.op == "var" and e.value in aliases else e, down) for e, down in c.order]
        grouping = any(contains_aggregate(i.expr) for i in items) or any(contains_aggregate(e) for e, _ in order)
        asked = [x for e in [*(i.expr for i in items), *(self.unalias(e, aliases, env) for e, _ in order)] for x in walk(e)]
        df = self.lookups(df, env, [x for x in asked if not contains_aggregate(x)])
        if grouping:
            df, env, values, ordering = self.group(df, env, items, order, aliases)
        else:
            values = [self.value(i.expr, env) for i in items]
            scope = {**{k: v for k, v in env.items()}}
            ordering = [(self.value(self.unalias(e, aliases, env), scope), down) for e, down in order]
        out_env: dict[str, Bound] = {}
        names, columns, kinds = [], [], []
        for item, v in zip(items, values, strict=True):
            kinds.append((item.name, {"node": "node", "rel": "relationship", "path": "path"}.get(v.type, "scalar")))
            if c.final and (v.type == "mixed" or v.type == "list" and v.item == "mixed"):
                self.json.add(item.name)
            if v.type in ("node", "rel") and not v.ref and not c.final:  # what a list holds of it
                whole, one = self.new("w"), self.new("w")
                columns += [v.col.alias(one), v.struct.alias(whole)]
                names.append([one, whole])
                out_env[item.name] = Bound("late", {"": one, "struct": whole, "id": one}, value=S.Value(F.col(one), v.type, struct=F.col(whole), props=v.props))
            elif c.final or v.type not in ("node", "rel"):
                col = item.name if c.final else self.new("w")
                columns.append((self.output(v, env) if c.final else v.col).alias(col))
                names.append([col])
                out_env[item.name] = Bound("path" if v.type == "path" else "value", {"": col}, value=S.Value(F.col(f"`{col}`"), v.type, v.item, v.whole, keys=v.keys, props=v.props))
            else:
                old = env[v.ref]
                new = {k: f"{self.new('w')}_{n}" for n, k in enumerate(old.cols)}
                columns += [F.col(old.cols[k]).alias(new[k]) for k in old.cols]
                names.append(list(new.values()))
                if known := self.keys.get(old.cols["id"]):  # goes along, so that later hops need no ids
                    key = self.new("w")
                    columns.append(F.col(known[1]).alias(key))
                    names[-1].append(key)
                    self.keys[new["id"]] = (known[0], key)
                out_env[item.name] = Bound(old.kind, new, old.props)
        hidden = []
        for v, _down in ordering:
            h = self.new("o")
            hidden.append(h)
            columns.append(self.rank(v).alias(h))
        carried = [] if grouping or ordering or c.final or c.distinct else self.order  # an earlier order holds on
        columns += [F.col(h) for h, _ in carried]
        df = df.select(*columns)
        shown = [n for group in names for n in group]
        self.order = [] if c.final else carried or [(h, down) for h, (_, down) in zip(hidden, ordering, strict=True)]
        shown += [h for h, _ in self.order]
        if c.distinct:
            keys = [out_env[i.name].cols.get("id") or out_env[i.name].cols.get("") for i in items]
            df = df.dropDuplicates(keys) if not hidden else self.first_of(df, keys, [(h, down) for h, (_, down) in zip(hidden, ordering, strict=True)])
        if ordering:
            df = df.orderBy(*[F.desc_nulls_first(h) if down else F.asc_nulls_last(h) for h, (_, down) in zip(hidden, ordering, strict=True)])
        if c.skip:
            df = df.offset(self.number(c.skip, "SKIP"))
        if c.limit:
            df = df.limit(self.number(c.limit, "LIMIT"))
        df = df.select(*[F.col(f"`{n}`") for n in shown])
        if c.where:
            df = self.lookups(df, out_env, list(walk(c.where)))
            df = df.filter(S.boolean(self.value(c.where, out_env), "WHERE"))
        return df, out_env, kinds

    def first_of(self, df: DataFrame, keys: list[str], ordering: list[tuple[str, bool]]) -> DataFrame:
        """Of equal rows the first in the order that is asked for."""
        by = [F.desc_nulls_first(h) if down else F.asc_nulls_last(h) for h, down in ordering]
        place = self.new("k")
        w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*by)
        return df.withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).drop(place)

    def unalias(self, e: Expr, aliases: dict[str, Expr], env: dict[str, Bound]) -> Expr:
        if e.op == "var" and e.value in aliases and e.value not in env:
            return aliases[e.value]
        return Expr(e.op, [self.unalias(a, aliases, env) if isinstance(a, Expr) else a for a in e.args], e.value, e.token)

    def rank(self, v: S.Value) -> Column:
        return v.col.cast("boolean") if v.type == "null" else v.col

    def group(self, df: DataFrame, env: dict[str, Bound], items: list[Item], order: list[tuple[Expr, bool]], aliases: dict[str, Expr]):
        """Items without an aggregate are the keys. What else a mixed item looks at comes from a first row of its group."""
        keys = [i for i in items if not contains_aggregate(i.expr)]
        key_cols, agg_cols = [], []
        place: dict[str, S.Value] = {}
        out_env: dict[str, Bound] = {}

        for i in keys:
            v = self.value(i.expr, env)
            if v.type in ("node", "rel") and v.ref:
                b = env[v.ref]
                new = {k: self.new("g") for k in b.cols}
                decides = "id"
                if known := self.keys.get(b.cols["id"]):
                    decides, key = "", self.new("g")
                    key_cols.append(F.col(known[1]).alias(key))
                    self.keys[new["id"]] = (known[0], key)
                else:
                    key_cols.append(F.col(b.cols["id"]).alias(new["id"]))
                agg_cols += [F.first(F.col(b.cols[k])).alias(new[k]) for k in b.cols if k != decides]  # the id or key decides them
                out_env[v.ref] = Bound(b.kind, new, b.props)
                place[text(i.expr)] = S.Value(F.col(new["id"]), v.type, ref=v.ref)
            else:
                name = self.new("g")
                key_cols.append(v.col.alias(name))
                struct = None
                if v.struct is not None:
                    struct = F.col(name + "_s")
                    agg_cols.append(F.first(v.struct).alias(name + "_s"))
                place[text(i.expr)] = S.Value(F.col(name), v.type, v.item, v.whole, keys=v.keys, struct=struct, props=v.props)

        def collect(e: Expr) -> None:
            if text(e) in place:
                return
            if e.op == "agg":
                v = self.aggregate(e, env)
                name = self.new("a")
                agg_cols.append(v.col.alias(name))
                place[text(e)] = S.Value(F.col(name), v.type, v.item, v.whole, props=v.props)
            elif not contains_aggregate(e) and e.op not in ("lit", "param"):
                v = self.value(e, env)
                name = self.new("f")
                agg_cols.append(F.first(v.col).alias(name))
                place[text(e)] = S.Value(F.col(name), v.type, v.item, v.whole)
            else:
                for a in e.args:
                    collect(a)

        order = [(self.unalias(e, aliases, env), down) for e, down in order]
        for e in [i.expr for i in items] + [e for e, _ in order]:
            collect(e)
        agg_cols = agg_cols or [F.count(F.lit(1)).alias(self.new("a"))]
        df = df.groupBy(*key_cols).agg(*agg_cols) if key_cols else df.agg(*agg_cols)
        lookup = lambda e: place.get(text(e))
        df = self.lookups(df, out_env, [x for e in [i.expr for i in items] + [e for e, _ in order] for x in walk(e) if contains_aggregate(x)], lookup)
        return df, out_env, [self.value(i.expr, out_env, lookup) for i in items], [(self.value(e, out_env, lookup), down) for e, down in order]


def run(graph: PropertyGraph, query: str, params: dict[str, Any] | None = None, extended: bool = False, max_depth: int = MAX_DEPTH) -> Result:
    """Compiles a query; nothing runs until an action on the result's DataFrame."""
    q = parse(query, extended)
    c = Compiler(graph, params, max_depth)
    frames = [c.single(p) for p in q.parts]
    df, kinds = frames[0]
    for other, k in frames[1:]:
        if [n for n, _ in k] != [n for n, _ in kinds]:
            raise CypherError("syntax", "UNION needs the same columns")
        df = df.unionByName(other)
    return Result(df if len(frames) == 1 or q.union_all else df.distinct(), kinds, c.probes, c.json)
