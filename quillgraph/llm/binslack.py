"""Sequence packing by minimum bin slack.

Documents are token ids plus an end id, cut into pieces of the capacity and one shorter rest. Pieces of a length are alike, so
the packing is found on the multiset of lengths alone, at most ``capacity`` counts however many documents there are: a window
takes the longest length left, then a bitset subset-sum over the lengths left (with their counts) finds the sum with the least
padding, backtracking gives how many of each length it takes, and the window is repeated as often as the counts allow.
Each piece then finds its place from its rank among the pieces of its length. Ranks come from counts of (length, salt), so a
length that holds a third of all rows is spread over all salts.

Padding of a window is what it lacks to the capacity, and none at a power of two. A null or empty text is the end id alone; null
doc_ids are kept; repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks, common

CAPACITY, END_ID, SALTS = 1024, 0, 1024
#: Pieces that a salt may have of all lengths together.
PER_SALT = 1_000_000
TOKENIZER = "byte_bpe_50k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def padding(total: int, capacity: int) -> int:
    return 0 if total & (total - 1) == 0 else capacity - total


def fill(seed: int, left: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length the window of ``seed`` takes, itself included. ``left``: counts of lengths, longest first."""
    reach, steps = 1 << seed, []
    full = (1 << capacity + 1) - 1
    target = 1 << capacity
    for length, count in left.items():
        if reach & target:
            break
        count = min(count - (length == seed), (capacity - seed) // length)
        step = 1
        while count > 0:  # 1, 2, 4, ... and the rest: all numbers up to count
            n = min(step, count)
            steps.append((length, n, reach))
            reach |= reach << n * length & full
            count -= n
            step *= 2
    best = min((s for s in range(seed, capacity + 1) if reach >> s & 1), key=lambda s: (padding(s, capacity), -s)) if not reach & target else capacity
    taken = {seed: 1}
    for length, n, before in reversed(steps):
        if not before >> best & 1:  # this sum was only reached with these n
            taken[length] = taken.get(length, 0) + n
            best -= n * length
    return taken


@dataclass
class Plan:
    """windows: (times, {length: how many}); per length the ranks at which a window's share begins."""

    capacity: int
    windows: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    lengths: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)

    def padding(self) -> int:
        return sum(times * padding(sum(k * n for k, n in use.items()), self.capacity) for times, use in self.windows)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of a multiset of lengths from 1 to capacity."""
    left = {k: counts[k] for k in sorted(counts, reverse=True) if counts[k] > 0}
    windows = []
    while left:
        use = fill(next(iter(left)), left, capacity)
        times = min(left[k] // n for k, n in use.items())
        windows.append((times, use))
        for k, n in use.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return lay_out(windows, capacity)


def lay_out(windows: list[tuple[int, dict[int, int]]], capacity: int) -> Plan:
    """Sequences in the order of the windows; in each, its pieces longest first."""
    out = Plan(capacity, windows)
    shares: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for times, use in windows:
        offset = 0
        for k in sorted(use, reverse=True):
            shares.setdefault(k, []).append((used.get(k, 0), base, use[k], offset))
            used[k] = used.get(k, 0) + times * use[k]
            offset += k * use[k]
        base += times
    out.lengths = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in shares.items()}
    return out


def place(lengths: np.ndarray, ranks: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of these lengths with these ranks (from 0) among their length."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k in np.unique(lengths):
        at = np.flatnonzero(lengths == k)
        first, base, each, place_in = p.lengths[int(k)]
        w = np.searchsorted(first, ranks[at], side="right") - 1
        local = ranks[at] - first[w]
        sequence[at] = base[w] + local // each[w]
        offset[at] = place_in[w] + local % each[w] * k
    return sequence, offset


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, with the CRC-32 of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks.tokenizer_table(tokenizer)
        for batch in batches:
            for part, data, offsets in chunks.pieces_of(batch):
                ids, at = table.encode_texts(data, offsets)
                rows: list[tuple] = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    rows += [(doc_id, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity]), len(own)) for s in range(0, len(own), capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=[c.split()[0] for c in PIECES.split(", ")])

    return common.texts(docs).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS, planner: Callable[[dict[int, int], int], Plan] = plan) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stable table with ``length`` from 1 to capacity and doc_id, start, ids_crc32 to rank by).

    planner: the packing of a multiset of lengths, of a size that doesn't grow with the counts."""
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    p = pieces.sparkSession.sparkContext.broadcast(Plan(capacity, lengths=planner(totals, capacity).lengths))
    salts = max(1, salts, -(-sum(totals.values()) // PER_SALT))  # so that no length's share of a salt grows with the input
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))).join(bases, ["length", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = place(b.column("length").to_numpy(), b.column("rank").to_numpy(), p.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rn") - 1).alias("rank")).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(common.stash(token_pieces(docs), "pieces"))


def op6_bin_slack_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
