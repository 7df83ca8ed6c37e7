"""Typed expressions of the query language as Spark columns.

A value carries its static type, because the language never casts: values of different types are unequal and not ordered by ``<``.
Where the types of one column differ by row (a property of several kinds, ``CASE``, ``coalesce``, list elements) it is *mixed*: a struct
of a rank and one field for each type. Spark's order of that struct is the language's total order, so sorting, grouping, ``min`` and
``max`` need nothing of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import CypherError


@dataclass
class Value:
    col: Column
    type: str  # number, string, boolean, temporal, list, map, node, rel, path, mixed, null
    item: str = "null"  # of a list
    whole: bool = False  # a number that is an integer
    ref: str | None = None  # variable of a node, rel or path
    keys: tuple[str, ...] = ()  # of a map
    struct: Column | None = None  # of a node or relationship that is an element of a list: what the list holds of it
    props: dict | None = None  # the properties in that struct, or in those of a list's elements


#: The language's order of types, as far as values of several types can be told apart by row.
RANKS = {"list": 3, "string": 4, "boolean": 5, "number": 6}
ITEM = "struct<rank:int,text:string,flag:boolean,number:double>"
MIXED = f"struct<rank:int,items:array<{ITEM}>,text:string,flag:boolean,number:double>"
_FIELDS = {"string": "text", "boolean": "flag", "number": "number"}


def _tagged(col: Column, kind: str, items: Column | None, nested: bool) -> Column:
    fields = [F.lit(RANKS[kind]).alias("rank")] + ([] if nested else [(F.lit(None) if items is None else items).alias("items")])
    fields += [(col if k == kind else F.lit(None)).alias(f) for k, f in _FIELDS.items()]
    return F.when(col.isNotNull(), F.struct(*fields)).cast(ITEM if nested else MIXED)


def mixed(v: Value, nested: bool = False) -> Value:
    """v with its type in each row; nested: as an element of a list."""
    if v.type == "null":
        return Value(F.lit(None).cast(ITEM if nested else MIXED), "mixed")
    if v.type == "mixed":
        return Value(F.when(v.col.isNotNull(), F.struct(v.col["rank"].alias("rank"), *(v.col[f].alias(f) for f in _FIELDS.values()))).cast(ITEM), "mixed") if nested else v
    if v.type == "temporal":
        v = Value(v.col.cast("string"), "string")
    if v.type == "list" and not nested and v.item in (*_FIELDS, "mixed", "null"):
        items = v.col.cast(f"array<{ITEM}>") if v.item == "null" else v.col if v.item == "mixed" else F.transform(v.col, lambda x: _tagged(x, v.item, None, True))
        return Value(_tagged(v.col, "list", items, False), "mixed")
    if v.type not in _FIELDS:
        raise CypherError("runtime", f"{v.type} can't stand beside values of other types")
    return Value(_tagged(v.col, v.type, None, nested), "mixed")


def part(v: Value, kind: str) -> Value:
    """A mixed value where it is of this type, else null."""
    return Value(v.col["items"], "list", "mixed") if kind == "list" else Value(v.col[_FIELDS[kind]], kind)


def element(v: Value, col: Column) -> Value:
    """A value for one element of list v."""
    if v.item in ("node", "rel"):
        return Value(col["id"], v.item, struct=col, props=v.props)
    if v.item == "mixed":
        whole = [col["rank"].alias("rank"), F.lit(None).alias("items"), *(col[f].alias(f) for f in _FIELDS.values())]
        return Value(F.when(col.isNotNull(), F.struct(*whole)).cast(MIXED), "mixed")
    return Value(col, v.item, whole=v.whole)


def united(values: list[Value]) -> tuple[list[Column], Value]:
    """The columns of values that stand for each other, of one type, and a value of that type to describe them."""
    kinds = {v.type for v in values} - {"null"}
    if len(kinds) > 1:
        return [mixed(v).col for v in values], Value(F.lit(None), "mixed")
    items = {v.item for v in values if v.type == "list"} - {"null"}
    if kinds == {"list"} and len(items) > 1:
        return [mixed_list(v).col for v in values], Value(F.lit(None), "list", "mixed")
    first = next((v for v in values if v.type != "null" and (v.type != "list" or not items or v.item in items)), null())
    return [v.col for v in values], Value(F.lit(None), first.type, first.item, all(v.whole or v.type == "null" for v in values), keys=first.keys)


def mixed_list(v: Value) -> Value:
    return Value(mixed(v).col["items"], "list", "mixed") if v.type == "list" else Value(F.lit(None).cast(f"array<{ITEM}>"), "list", "mixed")


def json_text(v: Value) -> Column:
    """A mixed value, or one in a list, as it leaves a query: as JSON."""
    c = v.col
    text = F.to_json(F.array(c["text"]))
    plain = F.when(c["rank"] == RANKS["number"], number_text(Value(c["number"], "number"))).when(c["rank"] == RANKS["string"], F.substring(text, F.lit(2), F.length(text) - 2)).when(c["rank"] == RANKS["boolean"], c["flag"].cast("string"))
    if v.item == "item":
        return F.coalesce(plain, F.lit("null"))
    return plain if v.item == "flat" else F.when(c["rank"] == RANKS["list"], F.concat(F.lit("["), F.array_join(F.transform(c["items"], lambda x: json_text(Value(x, "mixed", "item"))), ","), F.lit("]"))).otherwise(plain)


def type_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "temporal"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, (T.StructType, T.MapType)):
        return "map"
    return "null"


def of_column(col: Column, t: T.DataType) -> Value:
    if t.simpleString() == MIXED:
        return Value(col, "mixed")
    if isinstance(t, T.ArrayType) and t.elementType.simpleString() == ITEM:
        return Value(col, "list", "mixed")
    return Value(col, type_of(t), type_of(t.elementType) if isinstance(t, T.ArrayType) else "null", isinstance(t, T.IntegralType), keys=tuple(t.names) if isinstance(t, T.StructType) else ())


def literal(v) -> Value:
    if v is None:
        return Value(F.lit(None), "null")
    if isinstance(v, bool):
        return Value(F.lit(v), "boolean")
    if isinstance(v, (int, float)):
        return Value(F.lit(v), "number", whole=isinstance(v, int))
    if isinstance(v, str):
        return Value(F.lit(v), "string")
    if isinstance(v, (list, tuple)):
        items = [literal(x) for x in v]
        return list_of(items)
    raise CypherError("runtime", f"a parameter can't be {type(v).__name__}")


def list_of(items: list[Value]) -> Value:
    kinds = {i.type for i in items} - {"null"}
    if len(kinds) > 1 or "mixed" in kinds:
        return Value(F.array(*[mixed(i, nested=True).col for i in items]), "list", "mixed")
    kind = kinds.pop() if kinds else "null"
    return Value(F.array(*[i.col for i in items]) if items else F.array(), "list", kind, all(i.whole for i in items))


def null() -> Value:
    return Value(F.lit(None), "null")


def boolean(v: Value, what: str) -> Column:
    return only(v, "boolean", f"{what} needs booleans").cast("boolean")


def only(v: Value, kind: str, says: str) -> Column:
    """The column of a value of this type; a mixed one fails in the rows where it is of another."""
    if v.type == "mixed":
        return F.when(v.col.isNull() | (v.col["rank"] == RANKS[kind]), part(v, kind).col).otherwise(F.raise_error(F.lit(f"runtime: {says}")))
    if v.type not in (kind, "null"):
        raise CypherError("runtime", f"{says}, not {v.type}")
    return v.col


def _same(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Columns that can be compared, or None if the types differ."""
    if {a.type, b.type} == {"temporal", "string"}:
        return a.col.cast("timestamp"), b.col.cast("timestamp")
    return (a.col, b.col) if a.type == b.type else None


def equal(a: Value, b: Value) -> Column:
    if "null" in (a.type, b.type):
        return F.lit(None).cast("boolean")
    if "mixed" in (a.type, b.type) and {a.type, b.type} <= {"mixed", "temporal", *RANKS}:
        return mixed(a).col == mixed(b).col
    both = _same(a, b)
    if both is None:
        return F.when(a.col.isNull() | b.col.isNull(), F.lit(None)).otherwise(F.lit(False))
    return both[0] == both[1]


def compare(op: str, a: Value, b: Value) -> Column:
    if "mixed" in (a.type, b.type) and {a.type, b.type} <= {"mixed", *RANKS}:
        if a.type != b.type:
            kind = b.type if a.type == "mixed" else a.type
            return F.lit(None).cast("boolean") if kind == "list" else compare(op, part(a, kind) if a.type == "mixed" else a, part(b, kind) if b.type == "mixed" else b)
        l, r = a.col, b.col
        same_kind = (l["rank"] == r["rank"]) & (l["rank"] > RANKS["list"])
        return F.when(same_kind, {"<": l < r, ">": l > r, "<=": l <= r, ">=": l >= r}[op])
    both = _same(a, b) if a.type in ("number", "string", "boolean", "temporal") else None
    if both is None:
        return F.lit(None).cast("boolean")
    l, r = both
    return {"<": l < r, ">": l > r, "<=": l <= r, ">=": l >= r}[op]


def member(a: Value, b: Value) -> Column:
    if b.type == "null":
        return F.lit(None).cast("boolean")
    if b.type != "list":
        raise CypherError("runtime", "IN needs a list")
    if a.type == "null":
        return F.when(F.size(b.col) == 0, F.lit(False)).otherwise(F.lit(None))
    if "mixed" in (a.type, b.item):
        return F.exists(b.col, lambda x: equal(a, element(b, x)))
    if b.item not in (a.type, "null"):
        return F.when(F.size(b.col) == 0, F.lit(False)).when(a.col.isNull() | F.exists(b.col, lambda x: x.isNull()), F.lit(None)).otherwise(F.lit(False))
    return F.exists(b.col.cast("array<string>") if b.item == "null" else b.col, lambda x: x == a.col)


def text_test(op: str, a: Value, b: Value) -> Column:
    a, b = (part(x, "string") if x.type == "mixed" else x for x in (a, b))
    if a.type != "string" or b.type != "string":
        return F.lit(None).cast("boolean")
    return {"STARTS": F.startswith, "ENDS": F.endswith, "CONTAINS": F.contains}[op](a.col, b.col)


def number_text(v: Value) -> Column:
    """Integers have no point, whatever their column's type."""
    if v.whole:
        return v.col.cast("bigint").cast("string")
    d = v.col.cast("double")
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def to_string(v: Value) -> Value:
    if v.type == "number":
        return Value(number_text(v), "string")
    if v.type == "mixed":
        return Value(F.when(v.col["rank"] == RANKS["string"], v.col["text"]).otherwise(json_text(v)), "string")
    return Value(v.col.cast("string"), "string")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+":
        if "list" in (a.type, b.type) and "null" not in (a.type, b.type):
            whole = a if a.type == "list" else b
            one = None if a.type == b.type else b if whole is a else a
            if len({x.item for x in (a, b) if x.type == "list"} - {"null"} | ({one.type} if one else set())) > 1:  # elements of several types
                parts = [mixed_list(x).col if x.type == "list" else F.array(mixed(x, nested=True).col) for x in (a, b)]
                return Value(F.concat(*parts), "list", "mixed")
            if one is None:
                return Value(F.concat(a.col, b.col), "list", a.item if a.item != "null" else b.item)
            return Value(F.concat(*(F.array(x.col) if x is one else x.col if x.item != "null" else F.array().cast("array<" + {"number": "double", "boolean": "boolean"}.get(one.type, "string") + ">") for x in (a, b))), "list", one.type)
        if "string" in (a.type, b.type):
            if {a.type, b.type} <= {"string", "number", "mixed", "null"}:
                return Value(F.concat(to_string(a).col, to_string(b).col), "string")
            raise CypherError("runtime", f"+ of {a.type} and {b.type}")
    if not {a.type, b.type} <= {"number", "mixed", "null"}:
        raise CypherError("runtime", f"{op} of {a.type} and {b.type}")
    a, b = (Value(only(x, "number", f"{op} needs numbers"), "number") if x.type == "mixed" else x for x in (a, b))
    l, r, whole = a.col, b.col, a.whole and b.whole
    if op in "+-*":
        if whole:
            l, r = l.cast("bigint"), r.cast("bigint")
        return Value({"+": l + r, "-": l - r, "*": l * r}[op], "number", whole=whole)
    x, y = l.cast("double"), r.cast("double")
    if op == "/":
        zero = F.when(x.isNull(), F.lit(None)).when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        return Value(F.when(y == 0, zero).otherwise(x / F.nullif(y, F.lit(0.0))), "number")
    if op == "%":
        if whole:
            return Value(F.when(r == 0, F.lit(float("nan"))).otherwise((l % F.nullif(r, F.lit(0))).cast("double")), "number")
        return Value(F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.nullif(y, F.lit(0.0))), "number")
    return Value(F.pow(x, y), "number")


def _string(v: Value, name: str) -> Column:
    return only(v, "string", f"{name} needs a string").cast("string")


def _number(v: Value, name: str) -> Column:
    return only(v, "number", f"{name} needs a number")


def _cut(s: Column, start: Column, end: Column) -> Column:
    """Characters from start to end, where negative places count from the end of the text."""
    n = F.length(s)
    a = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(F.least(start, n))
    b = F.when(end < 0, F.greatest(n + end, F.lit(0))).otherwise(F.least(end, n))
    return F.when(s.isNull(), F.lit(None)).otherwise(F.substring(s, a + 1, F.greatest(b - a, F.lit(0))))


def call(name: str, args: list[Value]) -> Value:
    """The functions that need no graph."""
    a = args[0] if args else null()
    string = lambda c: Value(c, "string")
    if name in ("tolower", "toupper"):
        return string((F.lower if name == "tolower" else F.upper)(_string(a, name)))
    if name in ("trim", "ltrim", "rtrim"):
        space = r"[\s   -     　﻿]+"
        pattern = {"trim": f"^{space}|{space}$", "ltrim": f"^{space}", "rtrim": f"{space}$"}[name]
        return string(F.regexp_replace(_string(a, name), pattern, ""))
    if name == "replace":
        s, old, new = (_string(x, name) for x in args)
        between = F.concat(new, F.array_join(F.split(s, ""), "\x00"), new)
        spread = F.when(s == "", new).otherwise(F.replace(between, F.lit("\x00"), new))
        return string(F.when(old == "", spread).otherwise(F.replace(s, old, new)))
    if name == "substring":
        s, start = _string(a, name), _number(args[1], name).cast("int")
        return string(_cut(s, start, start + _number(args[2], name).cast("int") if len(args) > 2 else F.length(s)))
    if name == "left":
        return string(_cut(_string(a, name), F.lit(0), _number(args[1], name).cast("int")))
    if name == "right":
        n = _number(args[1], name).cast("int")
        s = _string(a, name)
        return string(F.when(n == 0, F.when(s.isNotNull(), F.lit(""))).otherwise(_cut(s, -n, F.length(s))))
    if name == "split":
        return Value(F.split(_string(a, name), F.concat(F.lit("\\Q"), _string(args[1], name), F.lit("\\E")), -1), "list", "string")
    if name in ("size", "length"):
        if a.type == "list":
            return Value(F.when(a.col.isNotNull(), F.size(a.col)), "number", whole=True)
        if a.type == "path":
            return Value(F.size(a.col["rels"]), "number", whole=True)
        return Value(F.length(_string(a, name)), "number", whole=True)
    if name == "coalesce":
        columns, like = united(args)
        return Value(F.coalesce(*columns), like.type, like.item, like.whole, keys=like.keys)
    if name == "tostring":
        return to_string(a)
    if name in ("tointeger", "tofloat"):
        if a.type == "string":
            d = F.when(F.trim(a.col) == "", F.lit(0.0)).otherwise(a.col.try_cast("double"))
        else:
            d = _number(a, name).cast("double")
        whole = name == "tointeger"
        return Value(F.when(~F.isnan(d), F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d))).cast("bigint") if whole else d, "number", whole=whole)
    if name == "toboolean":
        if a.type == "boolean":
            return a
        low = F.lower(_string(a, name))
        return Value(F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False)), "boolean")
    if name in ("abs", "floor", "ceil", "round", "sign"):
        x = _number(a, name)
        col = {"abs": F.abs(x), "floor": F.floor(x), "ceil": F.ceil(x), "round": F.floor(x + F.lit(0.5)), "sign": F.signum(x).cast("int")}[name]
        return Value(col, "number", whole=name != "abs" or a.whole)
    if name in ("head", "last"):
        if a.type not in ("list", "mixed"):
            raise CypherError("runtime", f"{name} needs a list")
        a = part(a, "list") if a.type == "mixed" else a
        return element(a, F.get(a.col, 0) if name == "head" else F.try_element_at(a.col, F.lit(-1)))
    if name == "reverse":
        return Value(F.reverse(a.col), a.type, a.item)
    if name == "keys" and a.type == "map":
        return Value(F.array(*[F.lit(k) for k in a.keys]), "list", "string")
    if name in ("nodes", "relationships"):
        if a.type != "path":
            raise CypherError("runtime", f"{name} needs a path")
        return Value(a.col["nodes" if name == "nodes" else "rels"], "list", "node" if name == "nodes" else "rel", props=None if name == "nodes" else a.props)
    raise CypherError("runtime", f"{name} of {a.type}")
