"""Results as JSON: nodes, edges and paths carry a ``_type`` tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compile import Result


def _tagged(kind: str, c: Column) -> Column:
    tag = {"node": "node", "relationship": "relationship", "path": "path"}.get(kind)
    body = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    if not tag:
        return body
    # {"v":{...}} becomes {"v":{"_type":"node",...}}; a null stays null.
    return F.when(c.isNull(), F.lit('{"v":null}')).otherwise(F.concat(F.lit('{"v":{"_type":"' + tag + '",'), F.substring(body, 7, 1_000_000_000)))


def rows(result: Result) -> DataFrame:
    """One JSON array of values per row, in column order."""
    parts = []
    for name, kind in result.kinds:
        j = _tagged(kind, F.col(f"`{name}`"))
        parts.append(F.substring(j, 6, 1_000_000_000))  # without {"v":
    values = [F.substring(p, F.lit(1), F.length(p) - 1) for p in parts]
    return result.df.select(F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")).alias("row"))


def columns(result: Result) -> list[dict[str, str]]:
    return [{"name": n, "kind": k} for n, k in result.kinds]


def read(rows: DataFrame) -> DataFrame:
    """The inverse: from rows (``row``, a JSON array, and any other columns) one row for each value, with its place, its kind, the value as a
    variant, and of nodes and edges the id."""
    others = [c for c in rows.columns if c != "row"]
    each = rows.select(*others, F.posexplode(F.from_json("row", "array<variant>")).alias("place", "value"))
    kind = F.coalesce(F.try_variant_get("value", "$._type", "string"), F.lit("scalar"))
    return each.select(*others, "place", kind.alias("kind"), F.try_variant_get("value", "$.id", "string").alias("id"), "value")
