"""Best-fit packing by sums of squares.

N(g) is the number of open sequences that lack g tokens to the capacity. Each document goes where the sum of all N(g) squared
becomes smallest: into a sequence of some gap that holds it, or into a new one. Documents of a length are alike, so the placing
runs over the multiset of lengths alone, at most ``capacity`` counts, in an order that is shuffled once by a fixed seed, since
the rule does best where lengths arrive mixed. Then the documents of sequences that stayed open are placed anew, longest first,
and again as long as that saves sequences.

The count of each length is written in base ``LOT``. Its highest digits are placed first, in lots of that power of ``LOT``, the squares
being those of the counts with the lot moved; each next digit goes in smaller lots into the sequences open by then, down to single
documents. That is the one rule for tables of every size: the lots of a length depend on its own count alone. The number of placings
grows with the logarithm of the number of documents only, and no document is left out of it. Ranks among pieces of a length then tell
each piece its place, as in ``binslack``.

A document that fills sequences is cut into pieces of the capacity and a shorter rest. A null or empty text is the end id alone;
null doc_ids are kept, repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import binslack, common

CAPACITY, END_ID = 2048, 0
TOKENIZER = "word_bpe_49k.json"
LOT, ROUNDS, SEED = 64, 8, 7
_FAR = np.iinfo(np.int64).max

#: What a sequence holds: the sequence before its last document, and that document's length.
Held = tuple | None


class Sequences:
    """All sequences so far, alike ones together. gaps: N, in documents."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.gaps = np.zeros(capacity + 1, np.int64)
        self.open: list[list[tuple[int, Held]]] = [[] for _ in range(capacity + 1)]
        self.full: list[tuple[int, Held]] = []

    def best_gap(self, length: int, lot: int) -> int:
        """The gap of the sequences that a lot of this length goes into; the capacity stands for new ones.

        Moving a lot from gap g to g - length changes the sum of squares by 2 * lot * (N(g - length) - N(g) + lot), where gap 0
        (full) and new sequences count for nothing on their side.
        """
        to = self.gaps[1 : self.capacity - length] - self.gaps[length + 1 : self.capacity] + lot if length + 1 < self.capacity else self.gaps[:0]
        change = np.concatenate(([lot - 2 * self.gaps[length]] if length < self.capacity else [], 2 * to)).astype(np.int64)
        change[self.gaps[length : self.capacity] < lot] = _FAR
        new = lot + 2 * self.gaps[self.capacity - length] if length < self.capacity else lot
        at = int(np.argmin(change)) if len(change) else -1
        return length + at if at >= 0 and change[at] <= new else self.capacity

    def place(self, length: int, lot: int) -> None:
        gap = self.best_gap(length, lot)
        held: Held = None
        if gap < self.capacity:
            times, held = self.open[gap].pop()
            if times > lot:  # lots only shrink, each a multiple of the next: a group has one lot at least
                self.open[gap].append((times - lot, held))
            self.gaps[gap] -= lot
        self._put(gap - length, lot, (held, length))

    def _put(self, gap: int, times: int, held: Held) -> None:
        if gap:
            self.gaps[gap] += times
            self.open[gap].append((times, held))
        else:
            self.full.append((times, held))

    def unfinished(self) -> list[tuple[int, Held]]:
        return [x for group in self.open for x in group]


def contents(held: Held) -> dict[int, int]:
    out: dict[int, int] = {}
    while held:
        held, length = held
        out[length] = out.get(length, 0) + 1
    return out


def place_all(counts: dict[int, int], capacity: int, mixed: bool, base: int = LOT) -> Sequences:
    """All documents of these lengths, mixed or longest first, by the digits of their counts."""
    out, lot = Sequences(capacity), 1
    while max(counts.values(), default=0) >= lot * base:
        lot *= base
    left = dict(counts)
    while True:
        order = [k for k in sorted(left, reverse=True) for _ in range(left[k] // lot)]
        if mixed:
            random.Random(SEED).shuffle(order)
        for length in order:
            out.place(length, lot)
        left = {k: n % lot for k, n in left.items()}
        if lot == 1:
            return out
        lot //= base


def plan(counts: dict[int, int], capacity: int = CAPACITY, base: int = LOT) -> binslack.Plan:
    """The packing of a multiset of lengths from 1 to capacity."""
    now = place_all({k: n for k, n in counts.items() if n > 0}, capacity, True, base)
    done = now.full
    for _ in range(ROUNDS):
        again: dict[int, int] = {}
        for times, held in now.unfinished():
            for k, n in contents(held).items():
                again[k] = again.get(k, 0) + times * n
        new = place_all(again, capacity, False, base)
        if sum(n for n, _ in new.full + new.unfinished()) >= sum(n for n, _ in now.unfinished()):
            break
        done, now = done + new.full, new
    merged: dict[tuple, int] = {}
    for times, held in done + now.unfinished():
        key = tuple(sorted(contents(held).items(), reverse=True))
        merged[key] = merged.get(key, 0) + times
    return binslack.lay_out([(times, dict(key)) for key, times in merged.items()], capacity)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there."""
    pieces = common.stash(binslack.token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    packed = binslack.pack(pieces, capacity, planner=plan)
    return packed.select("doc_id", F.expr(f"cast(start div {capacity} as int)").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
