"""Exact substring dedup by column-wise construction of a collection Burrows-Wheeler transform (BWT) and its common prefixes.

A byte is removed if a string of ``length`` bytes over it also starts earlier: in a smaller doc_id, or earlier in the same document.

1. Candidates. Each document is cut into segments, runs of neighbouring windows (strings of ``length`` bytes) that share their minimizer, the
   ``GRAM``-byte string of least hash in a window: the segment's anchor. Equal windows have equal anchors in equal places. Segments whose
   anchor no other segment has hold no repeat and are left out; of all others the bytes are fetched. Nothing is removed at this point.
2. Collections. What stands right of a segment's anchor and what stands left of it, read backwards, are two strings of a collection; whole
   shards of segments that share their anchor go into one collection together. Its transform is built column by column: in each round the next
   symbol of every string goes to its place, and the common prefixes of it and of its neighbour are updated. Both lie in files that a
   round reads and writes front to back.
3. Two windows of a shard with ``a`` bytes left of the anchor are equal if the transform's common prefixes say that their left strings share ``a``
   bytes and their right strings the others. All but the first place by (doc_id, start) are marked. Every removed byte is under a mark.

Segments of equal bytes are a run: one member of the collection stands for all, and the later ones are marked. Runs are formed by
comparing bytes, first within a task, so that a passage of very many documents is one row per task and segment before it is dealt by key.
A key of more than ``HOT`` different segments (the edges of a passage that a large share of all documents holds) isn't one task's: there each
window is a segment of its own, keyed by its hash, and goes through runs and collections like any other.

Rows: a null or empty text has nothing to remove. A row with a null doc_id takes no part and keeps its text. Different texts with one
doc_id are one document's parts, in the order of 96 bits of hashes of them; rows that agree in both are one part and get the same result. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 100, 40
#: Bytes of text hashed at once, of text whose segments are compared before they are dealt by key, and of strings in one collection.
CHUNK, LOCAL, COLLECTION = 1 << 18, 24 << 20, 1 << 18
#: Rows of a transform that are read or written at once, different segments of a collection (beyond, no further shard is added), segments in memory at once, and for each task of the shards; tasks at most.
BLOCK, MEMBERS, GATHERED, EACH, MOST_TASKS = 1 << 18, 20_000, 100_000, 50_000, 50_000
#: The windows of a key with more different segments are dealt by themselves. At most FEW_KEYS such keys are broadcast.
HOT, FEW_KEYS = 50_000, 20_000
#: Bytes between the places of different texts of one doc_id: more than a text has.
PART = 1 << 40
#: A segment's windows and the place of its anchor are one number, anchor * WIDE + windows.
WIDE = 1 << 12

_MIX, _BASE = np.uint64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15
_POS = np.uint64((1 << 20) - 1)
_LUT = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 2**64))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` bytes, by doubling."""
    known = {1: _LUT[data]}
    n = 1
    while 2 * n <= size:
        h = known[n]
        known[2 * n] = h[: len(h) - n] * _power(n) + h[n:]
        n *= 2
    out, done = known[n], n
    while done < size:
        part = 1 << (size - done).bit_length() - 1
        h = known[part]
        m = len(out) - part
        out = out[:m] * _power(part) + h[done : done + m]
        done += part
    out = out ^ out >> np.uint64(31)
    return out * _MIX


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start in row, windows, key, place of the anchor) of the segments of texts laid end to end. A segment spans windows + length - 1 bytes."""
    out: list[tuple[np.ndarray, ...]] = []
    at, total = 0, len(data)
    step = CHUNK - length
    while at < total:  # windows that start in [at, at + step)
        part = data[at : at + step + length - 1]
        if len(part) >= length:
            h = gram_hashes(part, gram)
            place = np.arange(len(h), dtype=np.uint64)
            low = sliding_min(h & ~_POS | place, length - gram + 1) & _POS
            n = len(low)
            a, b = int(np.searchsorted(offsets, at, side="right")) - 1, int(np.searchsorted(offsets, at + n, side="left"))
            firsts, ends = np.clip(offsets[a:b] - at, 0, n), np.clip(offsets[a + 1 : b + 1] - length + 1 - at, 0, n)
            some = ends > firsts
            edge = np.zeros(n + 1, np.int8)
            edge[firsts[some]] += 1
            edge[ends[some]] -= 1
            valid = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
            change = np.ones(n, bool)
            change[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
            starts = np.flatnonzero(change & valid)
            last = np.ones(n, bool)
            last[:-1] = (low[1:] != low[:-1]) | ~valid[1:]
            stops = np.flatnonzero(last & valid)
            rows = np.searchsorted(offsets, starts + at, side="right") - 1
            anchors = low[starts].astype(np.int64)
            out.append((rows, starts + at - offsets[rows], stops - starts + 1, h[anchors], anchors - starts))
        at += step
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def merged(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges within each text."""
    if not len(start):
        return start, end, doc
    order = np.lexsort((start, doc))
    start, end, doc = start[order], end[order], doc[order]
    part = start // PART
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])))
    low, high = start - part * PART, end - part * PART
    moved = (np.cumsum(fresh) - 1) * (int(high.max()) + 1)  # each text's ranges beyond those of the one before
    reach = np.maximum.accumulate(high + moved) - moved
    head = fresh.copy()
    head[1:] |= low[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return start[at], np.maximum.reduceat(end, at), doc[at]


class Collection:
    """BWT and common prefixes of the suffixes of many strings, built by inserting one symbol of each string a round.

    Both lie in files. A round reads the last round's files front to back, ``block`` rows at a time, and writes new ones; in memory are a
    block, and for each string the row of its longest suffix so far.
    """

    def __init__(self, strings: list[bytes], folder: str, block: int = BLOCK):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.data = np.frombuffer(b"".join([*strings, b"\0"]), np.uint8)  # never empty
        self.folder, self.block = folder, block
        self.kind = np.uint8 if self.lengths.max(initial=0) < 255 else np.int32  # of common prefixes

    def _symbol(self, who: np.ndarray, used: int) -> np.ndarray:
        """The symbol before the last ``used`` of each string, moved up by one; 0 where the string has no more. UTF-8 has no byte 255."""
        at = self.ends[who] - 1 - used
        has = used < self.lengths[who]
        return np.where(has, self.data[np.where(has, at, 0)] + np.uint8(1), 0).astype(np.uint8)

    def _scan(self, files: tuple, size: int, place: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """What comes of putting the symbols at these rows (in order) before their suffixes: the rows of the longer suffixes with the
        string that each is of (as a place in ``place``) and its common prefix with the row before; and rows after them with theirs.
        """
        count = np.zeros(256, np.int64)  # of each symbol in the blocks so far
        least = np.full(256, -1, np.int64)  # the least common prefix after its last row, -1: none so far
        waits = np.zeros(256, bool)  # its last row gets a longer suffix, so the next one's common prefix changes
        out: list[tuple[np.ndarray, ...]] = []
        for s in range(0, size, self.block):
            n = min(self.block, size - s)
            bwt, lcp = files[0].read(s, n, np.uint8), files[1].read(s, n, self.kind)
            a, b = np.searchsorted(place, [s, s + n])
            order = pc.array_sort_indices(pa.array(bwt)).to_numpy().view(np.int64)  # stable
            per_symbol = np.bincount(bwt, minlength=256)
            head = np.cumsum(per_symbol) - per_symbol
            live = np.zeros(n, bool)
            live[place[a:b] - s] = True
            ordered = live.take(order)
            mine = np.flatnonzero(ordered)
            at_mine = order.take(mine)
            symbol = bwt.take(at_mine)
            after = mine + 1
            # The next row of the same symbol, if it is in this block and gets no longer suffix itself.
            old = after < (head + per_symbol)[symbol]
            old[old] = ~ordered.take(after[old])
            after = after[old]
            symbol_after = symbol[old]
            met = np.flatnonzero(waits & (per_symbol > 0)) if s else []
            if len(met) and len(met := met[~ordered[head[met]]]):
                after, symbol_after = np.append(after, head[met]), np.append(symbol_after, bwt[order[head[met]]])
            low = [self._least(lcp, order, at, chosen, head[sy], least, sy) for at, chosen, sy in ((at_mine, mine, symbol), (order.take(after), after, symbol_after))]
            base = before + count - head
            out.append((base[symbol] + mine, np.searchsorted(place, at_mine + s), low[0], base[symbol_after] + after, low[1]))
            if s + n < size:
                there = np.flatnonzero(per_symbol)
                last = order[head[there] + per_symbol[there] - 1]
                by_place = np.argsort(last)
                tail = np.minimum.reduceat(np.append(lcp, self.kind(np.iinfo(self.kind).max)), last[by_place] + 1)
                least = np.minimum(least, int(lcp.min()))
                least[there[by_place]] = np.minimum.accumulate(tail[::-1])[::-1]
                waits[there] = live[last]
                count += per_symbol
        row, who, low, after, low_after = (np.concatenate(c) for c in zip(*out, strict=True)) if len(out) > 1 else out[0]
        if len(out) > 1:
            o, o2 = np.argsort(row), np.argsort(after)
            row, who, low, after, low_after = row[o], who[o], low[o], after[o2], low_after[o2]
        return row, who, low, after, low_after

    def _least(self, lcp: np.ndarray, order: np.ndarray, at: np.ndarray, chosen: np.ndarray, head: np.ndarray, least: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The common prefix of each row with the one before it, once their symbols are put before them: one more than the least
        between them and the last row of that symbol; 0 if there is none."""
        out = np.empty(len(at), np.int64)
        inside = chosen > head
        if len(at) and inside.any():
            ranges = np.empty((int(inside.sum()), 2), np.int64)
            ranges[:, 0], ranges[:, 1] = order.take(chosen[inside] - 1) + 1, at[inside] + 1
            out[inside] = np.minimum.reduceat(np.append(lcp, self.kind(0)), ranges.ravel())[::2]
        firsts = np.flatnonzero(~inside)  # at most one of each symbol
        out[firsts] = -1
        for i in firsts[least[symbol[firsts]] >= 0].tolist():
            out[i] = min(least[symbol[i]], int(lcp[: at[i] + 1].min()))
        return out + 1

    def _insert(self, old: tuple, new: tuple, size: int, row: np.ndarray, symbols: np.ndarray, low: np.ndarray, after: np.ndarray, low_after: np.ndarray) -> None:
        """Writes the old files with the new rows among them."""
        gap = row - np.arange(len(row))  # old rows before each new one
        done = 0
        for s in range(0, size, self.block):
            n = min(self.block, size - s)
            end = int(np.searchsorted(gap, s + n)) if s + n < size else len(row)
            begin = s + done
            here = row[done:end] - begin
            stay = np.ones(n + end - done, bool)
            stay[here] = False
            a, b = np.searchsorted(after, [begin, begin + len(stay)])
            for i, (kind, values) in enumerate(((np.uint8, symbols), (self.kind, low))):
                c = np.empty(len(stay), kind)
                c[stay] = old[i].read(s, n, kind)
                c[here] = values[done:end]
                if i:
                    c[after[a:b] - begin] = low_after[a:b]
                new[i].write(begin, c)
            done = end

    def build(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In the order of all suffixes, first the empty ones by string: the common prefix with the one before, the string that it
        is of, and its length."""
        m = len(self.lengths)
        who = np.flatnonzero(self.lengths > 0)
        place, size = who, m
        with ExitStack() as stack:
            old, new = (tuple(stack.enter_context(Stream(os.path.join(self.folder, f"{name}{i}"))) for name in ("bwt", "lcp")) for i in range(2))
            symbols = self._symbol(np.arange(m), 0)
            old[0].write(0, symbols)
            old[1].write(0, np.zeros(m, self.kind))
            counts = np.bincount(symbols, minlength=256)
            used = 0
            while len(who):
                used += 1
                # A suffix that starts with c comes after the m empty ones, and after all that start with less.
                before = m + np.cumsum(counts) - counts - counts[0]
                row, string, low, after, low_after = self._scan(old, size, place, before)
                who = who[string]
                symbols = self._symbol(who, used)
                self._insert(old, new, size, row, symbols, low, after, low_after)
                counts = counts + np.bincount(symbols, minlength=256)
                size += len(row)
                old, new = new, old
                goes_on = self.lengths[who] > used
                who, place = who[goes_on], row[goes_on]
            bwt, lcp = old[0].read(0, size, np.uint8), old[1].read(0, size, self.kind)
        # Each string's suffixes, from the empty one on: the row of the next longer one is told by the symbol before.
        longer = np.empty(size, np.int32)
        longer[pc.array_sort_indices(pa.array(bwt)).to_numpy().view(np.int64)] = np.arange(m - counts[0], m - counts[0] + size, dtype=np.int32)
        owner, length = np.empty(size, np.int32), np.zeros(size, np.int32)
        owner[:m] = np.arange(m)
        who = np.argsort(-self.lengths, kind="stable")
        place = who
        for k in range(1, used + 1):
            n = int(np.searchsorted(-self.lengths[who], -k, side="right"))
            who, place = who[:n], longer[place[:n]]
            owner[place], length[place] = who, k
        return lcp, owner, length


class Stream:
    """A file of numbers that is read and written front to back."""

    def __init__(self, path: str):
        self.file = os.open(path, os.O_RDWR | os.O_CREAT)

    def __enter__(self) -> Stream:
        return self

    def __exit__(self, *_) -> None:
        os.close(self.file)

    def read(self, at: int, n: int, kind: type) -> np.ndarray:
        out = np.empty(n, kind)
        view, done, base = memoryview(out).cast("B"), 0, at * out.itemsize
        while done < len(view):
            got = os.preadv(self.file, [view[done:]], base + done)
            if not got:
                raise EOFError
            done += got
        return out

    def write(self, at: int, values: np.ndarray) -> None:
        view, done, base = memoryview(values).cast("B"), 0, at * values.itemsize
        while done < len(view):
            done += os.pwrite(self.file, view[done:], base + done)


def full_order(strings: list[bytes], folder: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Of whole strings in the order of the transform: each one's place, and the common prefix of each place with the one before."""
    c = Collection(strings, folder, block)
    lcp, owner, size = c.build()
    at = np.flatnonzero(size == c.lengths[owner])
    place = np.empty(len(strings), np.int64)
    place[owner[at]] = np.arange(len(at))
    shared = np.zeros(len(at), np.int64)
    if len(at) > 1:
        shared[1:] = np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1)
    return place, shared


@dataclass
class Member:
    """A different segment of a collection: the shard that it is of, its contexts' numbers, and how long they are."""

    shard: int
    left: int
    right: int
    n_left: int
    n_right: int


def repeats(contexts: list[bytes], members: list[Member], member: np.ndarray, doc: np.ndarray, start: np.ndarray, folder: str, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc) of the repeats among segments. Segment i is ``members[member[i]]``; equal segments are one member."""
    order = np.lexsort((start, doc, member))
    member, doc, start = member[order], doc[order], start[order]
    heads = np.concatenate(([True], member[1:] != member[:-1]))
    first_doc, first_start = doc[heads], start[heads]  # by member
    shard, left, right, n_left, n_right = (np.array(c, np.int64) for c in zip(*((m.shard, m.left, m.right, m.n_left, m.n_right) for m in members), strict=True))
    place, shared = full_order(contexts, folder)
    left, right = place[left], place[right]
    rank = np.empty(len(members), np.int64)
    rank[np.lexsort((first_start, first_doc))] = np.arange(len(members))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    around = length - gram
    for a in range(around + 1):  # windows with a bytes left of the anchor
        at = np.flatnonzero((n_left >= a) & (n_right >= around - a))
        if len(at) < 2:
            continue
        key = (shard[at] * len(contexts) + np.cumsum(shared < a)[left[at]]) * len(contexts) + np.cumsum(shared < around - a)[right[at]]
        by_key = np.lexsort((rank[at], key))
        later = by_key[1:][key[by_key[1:]] == key[by_key[:-1]]]
        if len(later):
            who = at[later]
            found.append((who, first_start[who] + n_left[who] - a))
    # A run's later segments: each of their windows comes in its first one too.
    again = (doc != first_doc[member]) | (start != first_start[member])
    ends = start + (n_left + n_right)[member] + gram
    who, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return merged(np.concatenate((s, start[again])), np.concatenate((s + length, ends[again])), np.concatenate((first_doc[who], doc[again])))


#: What a task says about segments. WANTED: one with its place, whose key has company. PROBE: that a key occurs, with how many different
#: segments, and its place if it is the task's only one. HOT_KEY: a key of very many different segments.
FOUND = "kind byte, key long, doc_id long, start long, n int, different int"
WANTED, PROBE, HOT_KEY = 0, 1, 2


def _rows(kind: int, key: np.ndarray, doc=None, start=None, n=None, different=None) -> pa.RecordBatch:
    k = len(key)
    longs = (np.zeros(k, np.int64) if c is None else np.ascontiguousarray(c).view(np.int64) for c in (key, doc, start))
    ints = (np.zeros(k, np.int32) if c is None else np.asarray(c, np.int32) for c in (n, different))
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int8)), *map(pa.array, longs), *map(pa.array, ints)], names=[c.split()[0] for c in FOUND.split(", ")])


def _met(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """What a task says about its segments, given by key, doc_id, start, windows and a hash by which different ones are counted."""
    key, doc, start, n, content = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(key, kind="stable")
    k = key[order]
    cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    single = np.zeros(len(k), bool)
    single[order[cuts[np.diff(np.append(cuts, len(k))) == 1]]] = True
    company = np.flatnonzero(~single)
    if len(company):
        both = np.lexsort((content[company], key[company]))
        a, b = key[company][both], content[company][both]
        new_key = np.concatenate(([True], a[1:] != a[:-1]))
        fresh = new_key | np.concatenate(([True], b[1:] != b[:-1]))
        heads = np.flatnonzero(new_key)
        yield _rows(PROBE, a[heads], different=np.add.reduceat(fresh.astype(np.int32), heads))
    for kind, at in ((WANTED, company), (PROBE, np.flatnonzero(single))):
        for i in range(0, len(at), 200_000):
            j = at[i : i + 200_000]
            yield _rows(kind, key[j], doc[j], start[j], n[j], np.ones(len(j)))


def _segment_batches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for whole in batches:
            for batch in common.small_batches(whole, "text"):
                raw, offsets = common.flat_bytes(batch.column("text"))
                begin = int(offsets[0])
                raw = raw[begin : int(offsets[-1])]
                offsets = offsets - begin
                rows, start, n, key, anchor = segments(np.frombuffer(raw, np.uint8), offsets, length, gram)
                if len(rows):
                    at = start + offsets[rows]
                    content = np.array([xxh3_64_intdigest(raw[a:b]) for a, b in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)], np.uint64)
                    held.append((key, batch.column("doc_id").to_numpy()[rows], start + batch.column("base").to_numpy()[rows], (anchor * WIDE + n).astype(np.int32), content))
                size += len(raw)
                if size >= LOCAL:
                    if held:
                        yield from _met(held)
                    held, size = [], 0
        if held:
            yield from _met(held)
        held = []
        common.give_back()

    return run


def _candidate_batches(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key. Probes with a place whose key has company become wanted, and keys of more than ``hot`` different segments are named.

        Of a key that runs over several batches only a count, a sum and the first probe are kept.
        """
        latest, probes, different, first = None, 0, 0, None

        def wanted(key, doc, start, n) -> pa.RecordBatch:
            return _rows(WANTED, key, doc, start, n)

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == WANTED).any():
                yield batch.filter(pa.array(kind == WANTED))
            rows = batch.filter(pa.array(kind == PROBE))
            if not rows.num_rows:
                continue
            key, doc, start, n, d = (rows.column(i).to_numpy() for i in range(1, 6))
            cuts = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
            count, total = np.diff(cuts), np.add.reduceat(d.astype(np.int64), cuts[:-1])
            if key[0] == latest:
                if first is not None:  # it has company now
                    yield wanted(*first)
                    first = None
                count[0] += probes
                total[0] += different
            elif latest is not None and different > hot:
                yield _rows(HOT_KEY, np.array([latest]))
            go = np.repeat(count > 1, np.diff(cuts)) & (n > 0)
            if go.any():
                yield wanted(key[go], doc[go], start[go], n[go])
            over = total[:-1] > hot
            if over.any():
                yield _rows(HOT_KEY, key[cuts[:-2][over]])
            if key[-1] != latest or len(count) > 1:
                alone = count[-1] == 1 and n[-1] > 0
                first = tuple(c[-1:] for c in (key, doc, start, n)) if alone else None
            latest, probes, different = key[-1], int(count[-1]), int(total[-1])
        if latest is not None and different > hot:
            yield _rows(HOT_KEY, np.array([latest]))

    return run


#: A MARK is a range of n bytes to remove, a STRING is a segment with its bytes and n, the place of its anchor.
STRINGS = "kind byte, key long, doc_id long, start long, n int, data binary"
MARK, STRING = 0, 1
#: Deals marks over the tasks that strings are dealt to.
_SPREAD = np.int64(0x5851F42D4C957F2D)


def _strings(kind: int, key: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, data: list[bytes] | None = None) -> pa.RecordBatch:
    k = len(key)
    columns = [pa.array(np.full(k, kind, np.int8)), *(pa.array(np.asarray(c, np.int64)) for c in (key, doc, start)), pa.array(np.asarray(n, np.int32)), pa.nulls(k, pa.binary()) if data is None else pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STRINGS.split(", ")])


def _by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of key, and where each key begins among them, one more at the end."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.append(np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), len(k))


def runs(key: np.ndarray, doc: np.ndarray, start: np.ndarray, anchor: np.ndarray, data: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Segments of equal bytes are put together: the first by (doc_id, start) goes on for the run, and the others, being later, are marked."""
    order, cuts = _by_key(key)
    string = np.arange(len(key))
    several = np.diff(cuts) > 1
    for a, b in zip(cuts[:-1][several].tolist(), cuts[1:][several].tolist(), strict=True):
        known: dict[bytes, int] = {}
        for i in order[a:b].tolist():
            string[i] = known.setdefault(data[i], i)
    by_place = np.lexsort((start, doc, string))
    sorted_ = string[by_place]
    heads = by_place[np.concatenate(([True], sorted_[1:] != sorted_[:-1]))]
    head = np.empty(len(key), np.int64)
    head[string[heads]] = heads
    head = head[string]
    later = (doc != doc[head]) | (start != start[head])
    if later.any():
        ends = start[later] + np.fromiter((len(data[i]) for i in np.flatnonzero(later).tolist()), np.int64)
        s, e, d = merged(start[later], ends, doc[later])
        for i in range(0, len(s), 100_000):
            j = slice(i, i + 100_000)
            yield _strings(MARK, d[j] * _SPREAD, d[j], s[j], e[j] - s[j])
    for i in range(0, len(heads), 20_000):
        at = heads[i : i + 20_000]
        some = [data[j] for j in at.tolist()]
        yield _strings(STRING, key[at], doc[at], start[at], anchor[at], some)


def settle(key: np.ndarray, doc: np.ndarray, start: np.ndarray, anchor: np.ndarray, data: list[bytes], folder: str, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Puts shards of segments that share their anchor through collections; marks come out."""
    order, cuts = _by_key(key)
    at: list[int] = []
    member: list[int] = []
    members: list[Member] = []
    contexts: dict[bytes, int] = {}
    size, shards = 0, 0

    def collection() -> Iterator[pa.RecordBatch]:
        i = np.array(at)
        s, e, d = repeats(list(contexts), members, np.array(member), doc[i], start[i], folder, length, gram)
        if len(s):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array((e - s).astype(np.int32))], names=["doc_id", "start", "n"])

    anchors = anchor.tolist()
    several = np.diff(cuts) > 1
    for a, b in zip(cuts[:-1][several].tolist(), cuts[1:][several].tolist(), strict=True):
        known: dict[bytes, int] = {}  # members by their bytes
        found: dict[bytes, int] = {}  # shards by the bytes of their anchor, should two anchors have one hash
        for i in order[a:b].tolist():
            d = data[i]
            number = known.get(d)
            if number is None:
                number = known[d] = len(members)
                left, right = d[: anchors[i]][::-1], d[anchors[i] + gram :]
                numbers = []
                for c in (left, right):
                    k = contexts.get(c)
                    if k is None:
                        k = contexts[c] = len(contexts)
                        size += len(c)
                    numbers.append(k)
                shard = found.setdefault(d[anchors[i] : anchors[i] + gram], shards + len(found))
                members.append(Member(shard, *numbers, len(left), len(right)))
            at.append(i)
            member.append(number)
        shards += len(found)
        if size >= COLLECTION or len(members) > MEMBERS:
            yield from collection()
            at, member, members, contexts, size, shards = [], [], [], {}, 0, 0
    if at:
        yield from collection()


def _fetch_batches(length: int, windows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The wanted segments of a task's documents, equal ones put together; or each of their windows as a string of its own, keyed by its hash."""
        from xxhash import xxh3_64_intdigest

        held: list[tuple[np.ndarray, ...]] = []
        data: list[bytes] = []
        for whole in batches:
            for batch in common.small_batches(whole, "text"):
                raw, offsets = common.flat_bytes(batch.column("text"))
                found = batch.column("found")
                key, start, n = (found.flatten().field(c).to_numpy() for c in range(3))
                row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
                base = batch.column("base").to_numpy()[row]
                own = (start >= base) & (start < base + PART)  # else it is of another text with this doc_id
                key, start, n, row, base = key[own], start[own], n[own].astype(np.int64), row[own], base[own]
                anchor, n = n // WIDE, n % WIDE
                doc, at = batch.column("doc_id").to_numpy()[row], offsets[row] + start - base
                if windows:
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    doc, start, at, anchor, n = np.repeat(doc, n), np.repeat(start, n) + step, np.repeat(at, n) + step, np.repeat(anchor, n) - step, np.ones(len(step), np.int64)
                pieces = [bytes(raw[a:b]) for a, b in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)]
                if windows:
                    key = np.array([xxh3_64_intdigest(p) for p in pieces], np.uint64).view(np.int64)
                held.append((key, doc, start, anchor))
                data += pieces
                if len(data) >= GATHERED:
                    yield from runs(*(np.concatenate(c) for c in zip(*held, strict=True)), data)
                    held, data = [], []
        if data:
            yield from runs(*(np.concatenate(c) for c in zip(*held, strict=True)), data)
        held, data = [], []
        common.give_back()

    return run


def _shard_batches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key: marks go through, the strings of whole shards are settled."""
        held: list[tuple] = []
        size = 0
        with tempfile.TemporaryDirectory() as folder:  # the files of one collection at a time, gone with the task

            def out() -> Iterator[pa.RecordBatch]:
                key, doc, start, anchor = (np.concatenate([h[i] for h in held]) for i in range(4))
                return settle(key, doc, start, anchor, [d for h in held for d in h[4]], folder, length, gram)

            for batch in batches:
                kind = batch.column("kind").to_numpy()
                if (kind == MARK).any():
                    yield batch.filter(pa.array(kind == MARK)).select(["doc_id", "start", "n"])
                rows = batch.filter(pa.array(kind == STRING))
                if not rows.num_rows:
                    continue
                columns = [rows.column(c).to_numpy() for c in ("key", "doc_id", "start", "n")]
                key, data = columns[0], rows.column("data").to_pylist()
                if size >= GATHERED:
                    cut = int(np.searchsorted(key, held[-1][0][-1], side="right"))  # where the shard ends that the last batch broke off
                    held.append((*(c[:cut] for c in columns), data[:cut]))
                    size += cut
                    if cut == len(key):
                        continue
                    yield from out()
                    columns, data, held, size = [c[cut:] for c in columns], data[cut:], [], 0
                held.append((*columns, data))
                size += len(data)
            if held:
                yield from out()
            held = []
        common.give_back()

    return run


RANGES = "doc_id long, start long, n int"


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and base of the rows with a doc_id. Texts that share a doc_id are laid PART bytes apart, in the order of hashes of them."""
    rows = common.texts(docs).filter("doc_id is not null")
    hashed = rows.select("doc_id", F.xxhash64("text").alias("h"), F.hash("text").alias("h2"))
    # Partial counts and extremes: a doc_id of any number of rows is one row per task.
    shared = hashed.groupBy("doc_id").agg(F.min(F.struct("h", "h2")).alias("a"), F.max(F.struct("h", "h2")).alias("b")).filter("a <> b").select("doc_id")
    shared = common.stash(shared, "shared_ids")
    if not shared.head(1):
        return rows.select("doc_id", "text", F.lit(0).cast("long").alias("base"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "h2")) - 1
    based = hashed.join(shared, "doc_id", "left_semi").distinct().select("doc_id", "h", "h2", (order.cast("long") * PART).alias("base"))
    based = common.stash(based, "bases")
    whole = rows.select("*", F.xxhash64("text").alias("h"), F.hash("text").alias("h2")).join(based, ["doc_id", "h", "h2"], "left")
    return whole.select("doc_id", "text", F.coalesce("base", F.lit(0).cast("long")).alias("base"))


def _dealt(texts: DataFrame) -> DataFrame:
    """By doc_id, for both joins of ranges to texts: one shuffle serves both."""
    return texts.repartition(_partitions(texts.sparkSession, texts.rdd.getNumPartitions(), 1), "doc_id")


def _partitions(spark, rows: int, each: int) -> int:
    """Tasks for so many rows, Spark's setting at least: for work that is much greater than its bytes."""
    return min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)))


def marked_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, start, n) of byte ranges to remove from ``named`` documents; start counts from the doc_id's first base, and ranges may overlap."""
    spark = texts.sparkSession
    probes = texts.mapInArrow(_segment_batches(length, gram), FOUND)
    # Only probes have to meet by their key; what is wanted already is dealt evenly, however many have one key.
    where = F.when(F.col("kind") == WANTED, F.xxhash64("doc_id", "start")).otherwise(F.col("key"))
    met = common.stash(probes.repartition(where).sortWithinPartitions("key").mapInArrow(_candidate_batches(hot), FOUND), "segments")
    kinds = {r["kind"]: r["n"] for r in met.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = met.filter(F.col("kind") == WANTED).select("key", "doc_id", "start", "n")

    def settled(some: DataFrame, windows: bool) -> DataFrame:
        by_doc = some.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n")).alias("found"))
        strings = _dealt(texts).join(by_doc, "doc_id").mapInArrow(_fetch_batches(length, windows), STRINGS)
        dealt = strings.repartition(_partitions(spark, kinds.get(WANTED, 0), EACH), "key")
        return dealt.sortWithinPartitions("key").mapInArrow(_shard_batches(length, gram), RANGES)

    n_hot = kinds.get(HOT_KEY, 0)
    if not n_hot:
        return settled(wanted, False)
    keys = met.filter(F.col("kind") == HOT_KEY).select("key")
    few = F.broadcast(keys) if n_hot <= FEW_KEYS else keys
    return settled(wanted.join(few, "key", "left_anti"), False).unionByName(settled(wanted.join(few, "key", "left_semi"), True))


def _left_of(raw: bytes, ranges: list[tuple[int, int]]) -> str:
    """The text without the ranges, and without characters of which a byte is in one."""
    at, out = 0, []
    for a, b in sorted(ranges):
        a, b = max(a, at), min(b, len(raw))
        if b <= at:
            continue
        while at < a < len(raw) and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        out.append(raw[at : max(a, at)])
        at = b
    out.append(raw[at:])
    return b"".join(out).decode("utf-8")


def kept(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, the number of removed bytes and of maximal removed runs."""
    out, at, removed, spans, last = [], 0, 0, 0, -1
    for a, b in sorted(ranges):
        b = min(b, len(raw))
        if b <= at:
            continue
        if a > last:
            spans += 1
        out.append(raw[at : max(a, at)])
        removed += b - max(a, at)
        at = last = b
    out.append(raw[at:])
    return b"".join(out), removed, spans


def _own(ranges: list[dict] | None, base: int) -> list[tuple[int, int]]:
    return [(s - base, s - base + r["n"]) for r in ranges or () if base <= (s := r["start"]) < base + PART]


def _with_ranges(docs: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """doc_id, text, base and ranges of every row."""
    texts = named(docs)
    by_doc = marked_ranges(texts, length, gram, hot).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    unnamed = common.texts(docs).filter("doc_id is null").select("doc_id", "text", F.lit(0).cast("long").alias("base"), F.lit(None).cast("array<struct<start:bigint,n:int>>").alias("ranges"))
    return _dealt(texts).join(by_doc, "doc_id", "left").unionByName(unnamed)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The same columns, with repeats removed from text (whole characters) and n_chars, if there is one, counted anew. Documents of which only white space is left are gone."""
    h, h2 = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.hash(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = named(docs)
    by_doc = marked_ranges(texts, length, gram, hot).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    marked = _dealt(texts).join(by_doc, "doc_id").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), F.hash("text").alias("_h2"), F.col("base").alias("_base"), F.col("ranges").alias("_ranges")).dropDuplicates(["_id", "_h", "_h2"])
    joined = docs.join(marked, (F.col("doc_id").cast("long") == F.col("_id")) & (h == F.col("_h")) & (h2 == F.col("_h2")), "left").select(*(docs[c] for c in docs.columns), "_base", "_ranges")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, base, found in zip(batch.column(at), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                new.append(_left_of(text.as_buffer().to_pybytes(), _own(found, base)) if found and text.is_valid else text.as_py())
            left = batch.select(list(range(batch.num_columns - 2))).set_column(at, batch.schema.field(at).name, pa.array(new, batch.schema.field(at).type))
            yield left.filter(pa.array([t is not None and not t.isspace() and t != "" for t in new], pa.bool_()))

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, base, ranges in zip(*(batch.column(c).to_pylist() if c != "text" else batch.column(c) for c in ("doc_id", "text", "base", "ranges")), strict=True):
            raw = text.as_buffer().to_pybytes()
            left, removed, spans = kept(raw, _own(ranges, base))
            rows.append((doc, len(raw), removed, spans, hashlib.sha256(left).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int64()] * 4 + [pa.string()], strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs and the SHA-256 of what is left."""
    return _with_ranges(docs, length, gram, hot).mapInArrow(_digest_batches, RESULT)


def op9_bcr_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(common.documents(spark, sf_dir))
