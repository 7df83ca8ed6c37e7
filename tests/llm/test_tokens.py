"""Ops 1, 5 and 6 against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillgraph.llm import binslack, chunks, common, pieces, rans


def hf(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (5, 3), (1000, 50), (rans.BLOCK, 1), (rans.BLOCK + 17, 49_000), (3 * rans.BLOCK, 7)])
def test_rans_round_trip(n, kinds):
    ids = np.minimum((np.random.default_rng(n).pareto(0.8, n) * 3).astype(np.int64), kinds - 1).astype(np.uint16)
    data = rans.encode_shard([None, 5], [n // 2, n - n // 2], ids)
    doc_ids, lengths, got = rans.decode_shard(data)
    assert doc_ids == [None, 5] and lengths.tolist() == [n // 2, n - n // 2] and (got == ids).all()
    if n:
        for at in (0, 20, len(data) - 1):
            with pytest.raises((rans.BadShard, zlib.error)):
                rans.decode_shard(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


@pytest.mark.parametrize("dtype", [np.uint16, np.uint32])
def test_symbols_are_counted(dtype, monkeypatch):
    ids = np.array([7, 0, 65535, 7, 300, 0, 7], dtype)
    sorts = []
    monkeypatch.setattr(np, "unique", lambda *a, real=np.unique, **k: sorts.append(1) or real(*a, **k))
    kinds, place, counts = rans.symbol_table(ids)
    assert kinds.tolist() == [0, 7, 300, 65535] and counts.tolist() == [2, 3, 1, 1] and (kinds[place] == ids).all()
    assert len(sorts) == (dtype == np.uint32)  # ids of 16 bits aren't sorted
    assert [len(x) for x in rans.symbol_table(ids[:0])] == [0, 0, 0]


def test_batches_are_gathered():
    batches = [pa.record_batch({"doc_id": [i, None], "text": ["a" * (20 * i), None]}) for i in range(9)]
    for most in (1, 200, 10_000):
        got = list(chunks.gathered(iter(batches), most))
        assert [r for b in got for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
        assert all(b.nbytes <= max(most, 400) for b in got) and len(got) == {1: 9, 10_000: 1}.get(most, len(got))
    assert list(chunks.gathered(iter([]))) == []


def test_a_chunk_of_several_batches_is_segmented_once(monkeypatch):
    monkeypatch.setattr(chunks, "KEEP", 0)
    asked = []
    table = chunks.ChunkTable(lambda found: asked.extend(found) or [b"\1\0"] * len(found), lambda text: [1])
    batches = [pa.record_batch({"text": ["one two"]}) for _ in range(5)]
    for batch in chunks.gathered(iter(batches)):
        for _, data, offsets in chunks.pieces_of(batch, chunks.GATHERED):
            ids, _ = table.encode_texts(data, offsets)
            assert len(ids) == 10
    assert sorted(asked) == [b" two", b"one"]


def test_op1(spark, odd_docs, no_docs, sf):
    enc = hf(rans.TOKENIZER)
    for docs in (odd_docs, no_docs, common.documents(spark, sf)):
        path = common.new_path(spark, "t")
        rans.write_token_files(docs, path)
        got = rans.read_token_files(spark, path).collect()
        want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        start, expected = 0, []
        for d, text in want:
            ids = [*enc(text), rans.END_ID]
            expected.append((d, start, len(ids), np.array(ids, "<u4").tobytes()))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda x: x[1]) == expected


def test_op5(spark, odd_docs, no_docs, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    for docs in (odd_docs, no_docs, common.documents(spark, sf)):
        expected = []
        for r in docs.collect():
            ids = sp.encode(r["text"] or "")
            expected.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest()))
        assert Counter(map(tuple, pieces.digests(docs).collect())) == Counter(expected)
    both = pieces.decode_pieces(pieces.encode_pieces(odd_docs))
    assert Counter(r["decoded"] for r in both.collect()) == Counter(sp.decode(sp.encode(r["text"] or "")) if r["text"] else "" for r in odd_docs.collect())


def test_plan_uses_every_length():
    rng = random.Random(3)
    for n in (0, 1, 7, 400):
        counts = dict(Counter(min(64, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(n)))
        p = binslack.plan(counts, 64)
        used = Counter()
        for times, use in p.windows:
            assert sum(k * v for k, v in use.items()) <= 64
            for k, v in use.items():
                used[k] += times * v
        assert used == Counter(counts)


def test_fill_is_the_best_sum():
    rng = random.Random(5)
    for _ in range(60):
        left = {k: rng.randint(1, 3) for k in sorted(rng.sample(range(1, 30), 5), reverse=True)}
        seed = next(iter(left))
        sums = {seed}
        for k, c in left.items():
            for _ in range(c - (k == seed)):
                sums |= {s + k for s in sums if s + k <= 32}
        use = binslack.fill(seed, left, 32)
        total = sum(k * v for k, v in use.items())
        assert all(v <= left[k] for k, v in use.items()) and use[seed] >= 1
        assert binslack.padding(total, 32) == min(binslack.padding(s, 32) for s in sums)


def test_op6(spark, odd_docs, no_docs, sf):
    enc = hf(binslack.TOKENIZER)
    assert binslack.pack_documents(no_docs).count() == 0
    for docs in (odd_docs, common.documents(spark, sf)):
        rows = binslack.pack_documents(docs).collect()
        want = Counter()
        for r in docs.collect():
            ids = [*enc(r["text"]), binslack.END_ID]
            want.update((r["doc_id"], s, min(1024, len(ids) - s), crc(ids[s : s + 1024]), len(ids)) for s in range(0, len(ids), 1024))
        assert Counter(tuple(r)[:5] for r in rows) == want
        by: dict = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_go_end_to_end(name, monkeypatch):
    """New chunks are tokenized as one text, and each gets the ids that it has alone."""
    calls = []

    class Spy:
        from_file = classmethod(lambda cls, path: cls(Tokenizer.from_file(path)))

        def __init__(self, t):
            self.__dict__["t"] = t

        def __setattr__(self, key, value):
            setattr(self.t, key, value)

        def encode(self, text, **how):
            calls.append(text)
            return self.t.encode(text, **how)

    monkeypatch.setattr("tokenizers.Tokenizer", Spy)
    monkeypatch.setattr(chunks, "_tables", {})
    alone, rng = hf(name), random.Random(3)
    alphabet = [*"abzA'9 0\t\n.,-ßÉİı́̈中한ᄀ가ᅡ🙂\x00", "'s", "  ", "\r\n", "<|endoftext|>", "</w>", "n\u0308", "\u200d"]
    found = ["".join(rng.choices(alphabet, k=rng.randrange(1, 9))).encode() for _ in range(3000)]
    assert [np.frombuffer(x, "<u2").tolist() for x in chunks.tokenizer_table(name).encode(found)] == [alone(c.decode()) for c in found]
    fitting = sum(c[0] in b"\t\n\v\f\r " and c[-1] not in b"\t\n\v\f\r " for c in found)
    assert fitting > 200 and sum(isinstance(x, str) for x in calls) == -(-fitting // 512)
