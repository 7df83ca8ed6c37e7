"""SimHash near-dedup with BK-trees.

A fingerprint has 64 bits over the XXH64 hashes (seed 42) of a text's three-word shingles. Fingerprints that differ in 3 bits or
fewer are linked, and the classes are the components of the links.

Search: only distinct fingerprints are compared. Of five blocks of bits, two agree between linked fingerprints, so each fingerprint
goes to the ten shards named by two of its blocks. A shard's BK-tree (children keyed by their integer distance to the parent) is
built and searched where the shard's rows are: a query follows only the edges whose distance is within the radius of its own. Trees
aren't sent through the driver, since together they hold the fingerprints of all documents. A shard beyond ``CAP`` fingerprints is
dealt again by two of five blocks of its other bits, twice at most; after that so many bits are equal that at most
2**14 fingerprints are left in one. Shards give a spanning forest, never all pairs.

Rows: a null text has no words, like an empty one: fingerprint zero. A row with a null doc_id is linked like any other and has the smallest
non-null doc_id of its class, null if there is none. Equal rows give equal results. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS, CAP, SHINGLE, SEED = 3, 1024, 3, 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 255):
        part = h[i : i + 255]
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes())


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = common.flat_bytes(batch.column("text"))
        at = at.tolist()
        f = np.array([fingerprint(bytes(data[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(f.view(np.int64))], names=[*rest, "f"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and f, the fingerprint as a signed long."""
    return common.texts(docs).mapInArrow(_fingerprint_batches, "doc_id long, f long")


class BKTree:
    """Distinct integers; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            at = 0
            while True:
                d = (value ^ self.values[at]).bit_count()
                child = self.children[at].get(d)
                if child is None:
                    self.children[at][d] = len(self.values)
                    break
                at = child
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            for key, child in self.children[at].items():
                if d - radius <= key <= d + radius:
                    todo.append(child)
        return found


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join each value to the smallest of its component under links within the radius."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.near(v, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    least: dict[int, int] = {}
    for i, v in enumerate(values):
        least[r] = min(v, least.get(r := root(i), v))
    return [(v, m) for i, v in enumerate(values) if (m := least[root(i)]) != v]


def _shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; a shard may run over several batches."""
    key, held = None, []

    def done(edges: list[tuple[int, int]]) -> None:
        if len(held) > 1:
            edges += forest([v & (2**64 - 1) for v in held])

    def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        keys, values = batch.column("key").to_numpy(), batch.column("f").to_numpy()
        if not len(keys):
            continue
        edges: list[tuple[int, int]] = []
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        big = np.flatnonzero(np.diff(cuts) > 1)
        ends = {0, len(cuts) - 2}
        for i in sorted(ends | set(big.tolist())):
            a, b = int(cuts[i]), int(cuts[i + 1])
            if keys[a] != key:
                done(edges)
                key, held = keys[a], []
            held += values[a:b].tolist()
        yield out(edges)
    edges = []
    done(edges)
    yield out(edges)


def _bits(f, places: list[int]):
    """The bits of f at these runs of places, side by side."""
    out = F.lit(0).cast("long")
    runs: list[list[int]] = []
    for p in places:
        if runs and p == runs[-1][-1] + 1:
            runs[-1].append(p)
        else:
            runs.append([p])
    for r in runs:
        out = F.shiftleft(out, len(r)).bitwiseOR(F.shiftrightunsigned(f, r[0]).bitwiseAND(F.lit((1 << len(r)) - 1)))
    return out


def _keys(f, free: list[int]) -> list[tuple[object, list[int]]]:
    """For each of the ten choices of two of five blocks of the free bits: the key, and the bits that stay free."""
    blocks = [b.tolist() for b in np.array_split(np.array(free), 5)]
    return [(_bits(f, blocks[i] + blocks[j]), [p for k, b in enumerate(blocks) if k not in (i, j) for p in b]) for i, j in combinations(range(5), 2)]


def links(distinct: DataFrame, cap: int = CAP, levels: int = 3) -> DataFrame:
    """Edges (a, b) among distinct fingerprints f whose components are those of all links."""
    f = F.col("f")
    first = _keys(f, list(range(64)))
    rows = distinct.select("f", F.explode(F.array(*[F.struct(F.lit(t).alias("table"), k.alias("bits")) for t, (k, _) in enumerate(first)])).alias("k")).select("f", F.col("k.table").alias("table"), F.xxhash64("k.table", "k.bits").alias("key"))
    frees = [free for _, free in first]
    found: DataFrame | None = None
    for level in range(levels):
        hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("key")
        last = level == levels - 1 or not (hot := common.stash(hot, "hot")).head(1)
        cold = rows if last else rows.join(hot, "key", "left_anti")
        edges = cold.select("key", "f").repartition("key").sortWithinPartitions("key").mapInArrow(_shard_batches, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if last:
            break
        dense = rows.join(hot, "key", "left_semi")
        choices = [_keys(f, free) for free in frees]
        again = F.lit(None)
        for t, c in enumerate(choices):
            again = F.when(F.col("table") == t, F.array(*[F.struct(F.lit(10 * t + i).alias("table"), F.xxhash64("key", F.lit(i), k).alias("key")) for i, (k, _) in enumerate(c)])).otherwise(again)
        rows = dense.select("f", F.explode(again).alias("k")).select("f", F.col("k.table").alias("table"), F.col("k.key").alias("key"))
        frees = [free for c in choices for _, free in c]
    return found


def _rooted(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each fingerprint with its least doc_id and the root of its class; the stars of the components."""
    nodes = prints.groupBy("f").agg(F.min("doc_id").alias("least"))
    stars = components(links(nodes.select("f")))
    rooted = nodes.join(stars.select(F.col("a").alias("f"), F.col("b").alias("root")), "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    return common.stash(rooted, "rooted"), stars


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    prints = common.stash(fingerprints(docs), "prints")
    joined, stars = _rooted(prints)
    inside = joined.join(stars.select(F.col("b").alias("root")).distinct(), "root", "left_semi")
    classes = inside.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = joined.join(classes, "root", "left").select("f", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(by_print, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: that of the smallest doc_id, a null one being the last.

    Rows are told apart by doc_id and 96 bits of hashes of the text, so a doc_id that several texts share stays where its text does. Of
    rows that agree in both, one stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.col("doc_id").cast("long").alias("k_id"), F.xxhash64(text).alias("k_long"), F.hash(text).alias("k_int")]
    prints = common.texts(docs, *key[1:]).mapInArrow(_fingerprint_batches, "doc_id long, k_long long, k_int int, f long")
    prints = common.stash(prints, "prints")
    rooted, _ = _rooted(prints)
    rows = prints.groupBy("doc_id", "k_long", "k_int", "f").agg(F.count(F.lit(1)).alias("n")).join(rooted.select("f", "root"), "f")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k_long", "k_int")
    rows = rows.select("root", "n", place.alias("place"))
    classes = rows.groupBy("root").agg(F.min("place").alias("first"), F.sum("n").alias("size")).filter("size > 1")
    met = rows.join(classes, "root").filter("n > 1 or not place <=> first")
    met = common.stash(met.select(F.col("place.doc_id").alias("m_id"), F.col("place.k_long").alias("m_long"), F.col("place.k_int").alias("m_int"), F.expr("place <=> first").alias("stays")), "met")
    met = met.hint("merge")  # it grows with the documents, so its size at hand is no reason to broadcast it
    whole = docs.select(F.struct("*").alias("row"), *key)
    same = F.col("k_id").eqNullSafe(F.col("m_id")) & (F.col("k_long") == F.col("m_long")) & (F.col("k_int") == F.col("m_int"))
    alone = whole.join(met, same, "left_anti").select("row")
    equal = whole.join(met.filter("stays"), same, "left_semi").groupBy("k_id", "k_long", "k_int").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return alone.unionByName(equal.select("row")).select("row.*")


def op3_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
