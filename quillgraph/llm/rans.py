"""Token-id files coded by a static range asymmetric numeral system (rANS).

A file holds shards. A shard holds whole documents in ascending doc_id order, about ``SHARD`` tokens, and one frequency table
that all its blocks share. A block codes up to ``BLOCK`` tokens in ``LANES`` interleaved states over one word stream, apart from
any other block. Every ``STEPS`` steps a checkpoint keeps the states and the place in the stream, so each stretch between
checkpoints can be decoded by itself: the decoder runs all stretches of all blocks side by side. Each block carries CRC-32s of
its stream and of its ids, and the shard one of its head; a damaged shard raises ``BadShard``.

Numbers: state x in [2**16, 2**32), 16-bit words, frequencies that sum to 2**16.

Shard layout (little-endian): magic, head length, CRC-32 of the head, head, streams of all blocks.
Head (zlib): counts; doc ids (int64, with a null flag each); tokens per document (uint32); symbols (uint32) and frequencies less 1
(uint16) of the table; then for each block its tokens, words, stream CRC-32 and ids CRC-32 (uint32), and for each of its checkpoints
the word offset and the states (uint32).

Documents: a null or empty text is the end id alone. Null doc_ids come first; rows of one doc_id are ordered by text, and rows that
are wholly equal are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, common

MAGIC = b"RANS0001"
SCALE_BITS = 16
SCALE = 1 << SCALE_BITS
LOW = np.uint64(1 << 16)
LANES, STEPS, BLOCK, SHARD = 32, 256, 32 * 1024, 1 << 20
TOKENIZER, END_ID = "word_bpe_49k.json", 2

SHARDS = "bucket int, shard int, start_in_bucket long, n_docs long, n_tokens long, data binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class BadShard(ValueError):
    pass


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Positive counts of at most 2**16 symbols scaled to frequencies of 1 or more that sum to 2**16."""
    f = np.maximum(1, counts.astype(np.float64) * SCALE / counts.sum()).astype(np.int64)
    over = int(f.sum()) - SCALE
    if over < 0:
        f[np.argmax(f)] -= over
    order = np.argsort(-f, kind="stable")
    while over > 0:  # take from the most frequent, at most half of each at a time
        spare = f[order] // 2
        take = np.minimum(spare, np.maximum(0, over - np.concatenate(([0], np.cumsum(spare)[:-1]))))
        f[order] -= take
        over -= int(take.sum())
    return f


def _code_blocks(symbols: np.ndarray, f: np.ndarray, start: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """symbols (blocks x steps x lanes, as places in the table): streams and checkpoints of the blocks."""
    blocks, steps, lanes = symbols.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    words = np.empty((steps, blocks, lanes), np.uint16)
    out = np.empty((steps, blocks, lanes), bool)
    saved = np.empty((-(-steps // STEPS), blocks, lanes), np.uint32)
    sixteen = np.uint64(16)
    for t in range(steps - 1, -1, -1):
        s = symbols[:, t]
        fs = f[s]
        emit = x >= fs << sixteen
        words[t] = x & np.uint64(0xFFFF)
        out[t] = emit
        x = np.where(emit, x >> sixteen, x)
        q = x // fs
        x = (q << sixteen) + (x - q * fs) + start[s]
        if t % STEPS == 0:
            saved[t // STEPS] = x
    streams, checkpoints = [], []
    per_step = out.sum(axis=2)
    for b in range(blocks):
        streams.append(words[:, b][out[:, b]].astype("<u2").tobytes())
        at = np.concatenate(([0], np.cumsum(per_step[:, b])))[0:steps:STEPS]
        checkpoints.append(b"".join(struct.pack("<I", at[k]) + saved[k, b].astype("<u4").tobytes() for k in range(len(at))))
    return streams, checkpoints


def symbol_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that occur, ascending, each id's place among them, and their counts: counted by id where ids are 16-bit, else sorted."""
    if ids.dtype.itemsize > 2:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    kinds = np.flatnonzero(counts)
    places = np.zeros(len(counts), np.int32)
    places[kinds] = np.arange(len(kinds))
    return kinds.astype(ids.dtype), places[ids], counts[kinds]


def encode_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The documents' ids (end to end, below 2**32, of at most 2**16 kinds) as a shard."""
    kinds, place, counts = symbol_table(ids)
    if len(kinds) > SCALE:
        raise ValueError("more than 65536 symbols in one shard")
    f = frequencies(counts) if len(kinds) else np.zeros(0, np.int64)
    start = np.concatenate(([0], np.cumsum(f)))[:-1].astype(np.uint64)
    fu, common_symbol = f.astype(np.uint64), int(np.argmax(f)) if len(f) else 0
    n_whole = len(ids) // BLOCK
    parts: list[tuple[int, np.ndarray]] = []
    if n_whole:
        parts.append((BLOCK, place[: n_whole * BLOCK].reshape(n_whole, BLOCK // LANES, LANES)))
    rest = place[n_whole * BLOCK :]
    if len(rest):
        steps = -(-len(rest) // LANES)
        parts.append((len(rest), np.concatenate([rest, np.full(steps * LANES - len(rest), common_symbol, rest.dtype)]).reshape(1, steps, LANES)))
    streams, index, at = [], [], 0
    for tokens, symbols in parts:
        for stream, points in zip(*_code_blocks(symbols, fu, start), strict=True):
            own = ids[at : at + tokens].astype("<u4")
            index.append(struct.pack("<IIII", tokens, len(stream) // 2, zlib.crc32(stream), zlib.crc32(own)) + points)
            streams.append(stream)
            at += tokens
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = zlib.compress(b"".join([
        struct.pack("<QQII", len(doc_ids), len(ids), len(kinds), len(streams)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.array(lengths, "<u4").tobytes(),
        kinds.astype("<u4").tobytes(), (f - 1).astype("<u2").tobytes(), *index,
    ]), 1)
    return b"".join([MAGIC, struct.pack("<II", len(head), zlib.crc32(head)), head, *streams])


def decode_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, tokens per document and all ids (uint32) of a shard."""
    if data[:8] != MAGIC:
        raise BadShard("magic")
    n_head, crc = struct.unpack_from("<II", data, 8)
    packed = data[16 : 16 + n_head]
    if zlib.crc32(packed) != crc:
        raise BadShard("head")
    head = zlib.decompress(packed)
    n_docs, n_ids, n_kinds, n_blocks = struct.unpack_from("<QQII", head)
    at = 24

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(head, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, nulls, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    kinds, f = take("<u4", n_kinds), take("<u2", n_kinds).astype(np.uint64) + np.uint64(1)
    start = np.concatenate(([0], np.cumsum(f)))[:-1].astype(np.uint64)
    slots = np.repeat(np.arange(n_kinds), f.astype(np.int64))
    # Stretches between checkpoints: their states, place in all words, steps, and the place of their symbols.
    states, places, lengths_of, targets, checks = [], [], [], [], []
    body, word_at, out_at = 16 + n_head, 0, 0
    for _ in range(n_blocks):
        tokens, n_words, stream_crc, ids_crc = take("<u4", 4).tolist()
        stream = memoryview(data)[body + 2 * word_at : body + 2 * (word_at + n_words)]
        if zlib.crc32(stream) != stream_crc:
            raise BadShard("stream")
        steps = -(-tokens // LANES)
        for k in range(0, steps, STEPS):
            states_at = take("<u4", 1 + LANES)
            places.append(word_at + int(states_at[0]))
            states.append(states_at[1:])
            lengths_of.append(min(STEPS, steps - k))
            targets.append(out_at + k * LANES)
        checks.append((out_at, tokens, ids_crc))
        word_at += n_words
        out_at += steps * LANES
    if not n_blocks:
        return [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], lengths, np.zeros(0, np.uint32)
    words = np.frombuffer(data, "<u2", word_at, body).astype(np.uint64)
    words = np.append(words, np.uint64(0))
    order = np.argsort(-np.array(lengths_of), kind="stable")
    x = np.array(states, np.uint64)[order]
    at_word, left, target = np.array(places)[order], np.array(lengths_of)[order], np.array(targets)[order]
    out = np.empty(out_at, np.int64)
    lane = np.arange(LANES)
    mask, sixteen = np.uint64(SCALE - 1), np.uint64(16)
    for t in range(int(left[0])):
        n = int(np.searchsorted(-left, -t, side="left"))  # stretches that still have steps
        now = x[:n]
        slot = now & mask
        s = slots[slot.astype(np.int64)]
        out[(target[:n, None] + t * LANES + lane)] = s
        now = f[s] * (now >> sixteen) + slot - start[s]
        need = now < LOW
        rank = np.cumsum(need, axis=1)
        from_words = words[np.minimum(at_word[:n, None] + rank - 1, len(words) - 1)]
        x[:n] = np.where(need, now << sixteen | from_words, now)
        at_word[:n] += rank[:, -1]
    parts = []
    for a, tokens, ids_crc in checks:
        ids = kinds[out[a : a + tokens]].astype("<u4")
        if zlib.crc32(ids) != ids_crc:
            raise BadShard("ids")
        parts.append(ids)
    ids = np.concatenate(parts)
    if len(ids) != n_ids or int(lengths.sum()) != n_ids:
        raise BadShard("counts")
    return [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], lengths, ids


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encodes every text, appends the end id and writes the ids as shards, in ascending doc_id order over buckets (ranges of doc_id) and the shards in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bucket = chunks.tokenizer_table(tokenizer), TaskContext.get().partitionId()
        shard, before = 0, 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, doc_ids, lengths, parts
            n = sum(lengths)
            row = (bucket, shard, before, len(doc_ids), n, encode_shard(doc_ids, lengths, np.concatenate(parts)))
            shard, before, doc_ids, lengths, parts = shard + 1, before + n, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.binary()], strict=True)], names=[c.split()[0] for c in SHARDS.split(", ")])

        held = 0
        for batch in chunks.gathered(batches):
            for part, data, offsets in chunks.pieces_of(batch, chunks.GATHERED):
                ids, at = table.encode_texts(data, offsets)
                n = len(at) - 1
                closed = np.insert(ids, at[1:], end_id)  # after each document's ids
                ends = at[1:] + np.arange(1, n + 1)
                last = 0
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    doc_ids.append(doc_id)
                    lengths.append(int(ends[i] - (ends[i - 1] if i else 0)))
                    held += lengths[-1]
                    if held >= SHARD:
                        parts.append(closed[last : ends[i]])
                        last, held = ends[i], 0
                        yield flush()
                if last < len(closed):
                    parts.append(closed[last:])
        if doc_ids:
            yield flush()

    common.texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARDS).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian uint32) of every document, decoded from the files."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids binary", lambda own: own.tobytes(), pa.binary())


def _read(spark, path: str, schema: str, last, kind: pa.DataType) -> DataFrame:
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = {r["bucket"]: r["n"] for r in shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()}  # one number for each written partition
    base, before = {}, 0
    for b in sorted(totals):
        base[b] = before
        before += totals[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, start, data in zip(batch.column("bucket").to_pylist(), batch.column("start_in_bucket").to_pylist(), batch.column("data"), strict=True):
                doc_ids, lengths, ids = decode_shard(data.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                each = [last(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + start + base[bucket], pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(each, kind)], names=[c.split()[0] for c in schema.split(", ")])

    return shards.select("bucket", "start_in_bucket", "data").mapInArrow(run, schema)


def op1_rans_token_files(spark, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "rans")
    write_token_files(common.documents(spark, sf_dir), path)
    return _read(spark, path, READ, zlib.crc32, pa.int64())
