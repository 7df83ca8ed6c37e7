"""Merkle manifest of a dataset, with proofs by coordinate lookup.

A row is a leaf, the digest of its fields. The leaves of a source stand in the order of doc_id and are the lowest level of its
tree; ``GROUP`` consecutive nodes of a level make a node of the next. What remains of each source is the lowest level of the top
tree. A node's coordinates are (tree, level, idx), a tree's key is the rank of its source, the top tree's is ``TOP``.

All nodes are a written table. What a leaf needs to prove itself follows from its place and its tree's size alone: at each level
the coordinates of the run it stands in. The leaves of a run need the same coordinates, so these are exploded once for a run,
joined to the nodes, put in order and joined left and right of the place of the leaf; the fold goes from the leaf to the root.

Places come from one range shuffle of digests by (source, doc_id, digest, row): texts aren't shuffled. A source's rows are spread
over tasks by doc_id, rows of one doc_id by digest and place of the read, and a task's share of a source is added to the counts of
earlier tasks. Levels of few nodes, in which each is looked up by many, are broadcast (together at most ``BROADCAST_NODES``);
Spark joins the others by shuffle, and adaptive execution splits a key that stands out.

Nulls are digested as such and come first in order, null doc_ids like any other; equal doc_ids of a source are ordered by their
leaves, and equal rows are leaves of their own with proofs of their own. An empty table has no rows and no root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

GROUP, TOP = 16, -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of all broadcast levels together, about 100 bytes each, and rows and bytes of the broadcast table of shares.
BROADCAST_NODES, BROADCAST_SHARES, SHARE_BYTES = 65_536, 50_000, 8 << 20
_TASK = 33  # monotonically_increasing_id: the task above these bits, the row below


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def place_leaves(leaves: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Of leaves (source, doc_id, leaf and more): the same with tree, idx and n, the leaves of that tree; a stable table. And all trees: tree, source, n."""
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row")]
    sorted_rows = leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    rows = common.stash(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "leaves")
    rows = rows.withColumn("task", F.shiftright("at", _TASK)).withColumn("at", F.col("at").bitwiseAND((1 << _TASK) - 1))
    shares = rows.groupBy("source", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("share"))  # a source has one a task at most
    source = Window.partitionBy("source")
    earlier = source.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumns({"before": F.coalesce(F.sum("share").over(earlier), F.lit(0)), "n": F.sum("share").over(source), "head": F.col("task") == F.min("task").over(source)})
    shares = common.stash(shares, "shares")
    heads = shares.filter("head").withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy("first")) - 1)
    begun = heads.groupBy("task").agg(F.count(F.lit(1)).alias("heads"))  # one row a task: so is what the next window sees
    begun = begun.withColumn("trees", F.coalesce(F.sum("heads").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    trees = common.stash(heads.join(begun, "task").select((F.col("trees") + F.col("place")).alias("tree"), "source", "n"), "trees")
    of = shares.alias("s").join(trees.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "task", "first", "before", "s.n", "tree")
    size = shares.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("source")).alias("bytes")).first()
    if size["n"] <= BROADCAST_SHARES and (size["bytes"] or 0) <= SHARE_BYTES:
        of = F.broadcast(of)
    placed = rows.alias("r").join(of.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.task") == F.col("o.task")))
    kept = [F.col(f"r.{c}") for c in leaves.columns]
    return placed.select(*kept, "tree", (F.col("before") + F.col("at") - F.col("first")).alias("idx"), "n"), trees


def build_levels(lowest: DataFrame, most: int, group: int) -> list[DataFrame]:
    """The written levels of trees of at most ``most`` leaves: tree, idx, n (nodes of the level), digest."""
    levels = [common.stash(lowest, "nodes")]
    while most > 1:
        below = levels[-1].filter("n > 1").groupBy("tree", F.expr(f"idx div {group}").alias("idx"))
        run = F.sort_array(F.collect_list(F.struct("idx", "digest")))  # at most group
        above = below.agg(F.first("n").alias("m"), run.alias("run"))
        levels.append(common.stash(above.select("tree", "idx", F.expr(f"(m - 1) div {group} + 1").alias("n"), F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256).alias("digest")), "nodes"))
        most = -(-most // group)
    return levels


def remaining(levels: list[DataFrame]) -> DataFrame:
    """The last node of each tree."""
    return reduce(DataFrame.unionAll, [x.filter("n = 1").select("tree", "digest") for x in levels])


def lookup_proofs(leaves: DataFrame, levels: list[DataFrame], tops: list[DataFrame], n_trees: int, group: int = GROUP) -> DataFrame:
    """leaves (tree, idx, n and more) with subroot and proof: per level to fold, what stands left and right of the leaf's line."""
    depth = len(levels)

    def run_at(step: int, tree: Column, level: int, own: str, last: str) -> Column:
        """own and last: place in the level of what the run lies below, and of the level's last node."""
        width, low = group**level, f"({own}) div {group ** (level + 1)} * {group}L"
        fields = [F.lit(step).alias("step"), tree.alias("tree"), F.lit(level).alias("level"), F.expr(f"({own}) div {width}").alias("own"), F.expr(f"{last} div {width} > 0").alias("folds")]
        return F.struct(*fields, F.expr(f"sequence({low}, least({low} + {group - 1}L, {last} div {width}))").alias("run"))

    steps = [F.when(F.expr(f"{k} = 0 or (n - 1) div {group**k} > 0"), run_at(k, F.col("tree"), k, f"run * {group}L", "(n - 1)")) for k in range(depth)]
    steps += [run_at(depth + k, F.lit(TOP).cast("long"), k, "tree", f"{n_trees - 1}L") for k in range(len(tops)) if k == 0 or (n_trees - 1) // group**k]
    runs = leaves.filter(F.col("idx") % group == 0).select("tree", F.expr(f"idx div {group}").alias("run"), "n")
    asked = runs.select(F.col("tree").alias("of"), F.col("run").alias("in"), F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull())).alias("s"))
    asked = asked.select("of", "in", "s.step", "s.tree", "s.level", "s.own", "s.folds", F.explode("s.run").alias("idx"))
    tables = [x.select("tree", F.lit(k).alias("level"), "idx", "digest", F.lit(k).alias("step")) for k, x in enumerate(levels)]
    tables += [x.select("tree", F.lit(k).alias("level"), "idx", "digest", F.lit(depth + k).alias("step")) for k, x in enumerate(tops)]
    sizes, room, few, many = [x.count() for x in [*levels, *tops]], BROADCAST_NODES, [], []
    for k in sorted(range(len(tables)), key=sizes.__getitem__):
        room -= sizes[k]
        (few if room >= 0 else many).append(k)
    at, found = ["step", "tree", "level", "idx"], []
    for group_of, small in ((few, True), (many, False)):
        if group_of:
            nodes = reduce(DataFrame.unionAll, [tables[k] for k in group_of])
            found.append(asked.filter(F.col("step").isin(group_of)).join(F.broadcast(nodes) if small else nodes, at))
    sibling = F.struct("step", "idx", "own", "folds", "digest")
    known = reduce(DataFrame.unionAll, found).groupBy("of", "in").agg(F.sort_array(F.collect_list(sibling)).alias("nodes"))  # at most a run a level

    def beside(step: int, own: Column | None) -> Column:
        mine = F.filter("nodes", lambda x: (x["step"] == step) & x["folds"])
        place = (lambda x: x["own"]) if own is None else (lambda x: own)
        joined = lambda keep: F.array_join(F.transform(F.filter(mine, keep), lambda x: x["digest"]), "")
        return F.when(F.size(mine) > 0, F.struct(joined(lambda x: x["idx"] < place(x)).alias("left"), joined(lambda x: x["idx"] > place(x)).alias("right")))

    above = [k for k in range(1, depth + len(tops))]
    proven = known.select(
        "of",
        "in",
        F.filter("nodes", lambda x: x["step"] == 0).alias("nodes"),
        F.filter(F.array(*[beside(k, None) for k in above]), lambda x: x.isNotNull()).alias("above"),
        F.filter("nodes", lambda x: (x["step"] == depth) & (x["idx"] == x["own"]))[0]["digest"].alias("subroot"),
    )
    own = leaves.withColumns({"of": F.col("tree"), "in": F.expr(f"idx div {group}")}).join(proven, ["of", "in"])
    lowest = F.filter(F.array(beside(0, F.col("idx"))), lambda x: x.isNotNull())
    return own.select(*leaves.columns, "subroot", F.concat(lowest, "above").alias("proof"))


def fold(leaf: Column, proof: Column) -> Column:
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def proof_text(proof: Column) -> Column:
    return F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "")


def manifest(leaves: DataFrame, group: int = GROUP) -> tuple[DataFrame, list[DataFrame], list[DataFrame], str | None]:
    """Of leaves (source, doc_id, leaf and more): them with subroot and proof, the levels of all trees, those of the top tree, and the root."""
    placed, trees = place_leaves(leaves, group)
    size = trees.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("most")).first()
    levels = build_levels(placed.select("tree", "idx", "n", F.col("leaf").alias("digest")), size["most"] or 0, group)
    subroots = remaining(levels).select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(size["trees"]).cast("long").alias("n"), "digest")
    tops = build_levels(subroots, size["trees"], group)
    root = remaining(tops).first()
    return lookup_proofs(placed, levels, tops, size["trees"], group), levels, tops, root["digest"] if root else None


def op13_merkle_lookup_proofs(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    fields = {c: F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string") for c in FIELDS}
    hit = F.crc32(fields["doc_id"].cast("string").cast("binary")) % 5 == 0
    lower = F.translate(fields["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    intact = leaf_digest(*fields.values())
    # A row that isn't touched has one digest: the second is only worked out where the text changes.
    changed = F.when(hit, leaf_digest(*(fields | {"text": lower}).values()))
    leaves = docs.select(fields["doc_id"].alias("doc_id"), fields["source"].alias("source"), intact.alias("leaf"), changed.alias("changed"))
    proven, _, _, root = manifest(leaves)
    out = proven.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(depth: int = 6) -> str:
    """The same over trees of up to GROUP**depth leaves."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digest = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in [*FIELDS[:-1], text]) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"
    parts = [
        f"docs as (select doc_id, source, {digest('text')} as leaf, case when {crc} % 5 = 0 then {digest(lower)} end as changed from documents)",
        "placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n from docs)",
        "a0 as (select source as tree, idx, n, leaf as digest from placed)",
    ]

    def rise(name: str) -> None:
        for k in range(depth):
            parts.append(f"{name}{k + 1} as (select tree, idx // {GROUP} as idx, (any_value(n) - 1) // {GROUP} + 1 as n, sha256(string_agg(digest, '' order by idx)) as digest from {name}{k} where n > 1 group by tree, idx // {GROUP})")
        for k in range(depth):
            parts.append(f"{name}s{k} as (select a.tree, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as l, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as r from {name}{k} a join {name}{k} b on a.tree is not distinct from b.tree and a.idx // {GROUP} = b.idx // {GROUP} where a.n > 1 group by a.tree, a.idx)")
        parts.append(f"{name}end as (" + " union all ".join(f"select tree, digest from {name}{k} where n = 1" for k in range(depth + 1)) + ")")

    rise("a")
    parts.append("b0 as (select 0 as tree, row_number() over (order by tree nulls first) - 1 as idx, count(*) over () as n, digest, tree as source from aend)")
    rise("b")
    parts.append("f0 as (select p.*, b.idx as place, b.digest as subroot, '' as proof, coalesce(changed, leaf) as node from placed p join b0 b on p.source is not distinct from b.source)")
    for step, (name, k) in enumerate([(x, k) for x in "ab" for k in range(depth)]):
        on = f"f.source is not distinct from s.tree and f.idx // {GROUP**k} = s.idx" if name == "a" else f"f.place // {GROUP**k} = s.idx"
        parts.append(f"f{step + 1} as (select f.* replace (f.proof || coalesce(s.l || s.r, '') as proof, case when s.l is null then f.node else sha256(s.l || f.node || s.r) end as node) from f{step} f left join {name}s{k} s on {on})")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, digest as root, sha256(proof) as proof_sha256, node as folded_root, node = digest as verified from f{2 * depth}, bend"


SQL = _sql()
