"""Op 3 (BK-trees) and op 9 (column-wise BWT) against brute force."""

import hashlib
import random
import re
import tempfile

import numpy as np
import pytest
import xxhash

from quillgraph.llm import bcr, bktree, common
from quillgraph.llm.components import components


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_bktree_finds_all_within_radius():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(8)})
    tree = bktree.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.near(v, 3)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 3]


@pytest.mark.parametrize("cap", [2, 1024])
def test_links_have_all_components(spark, cap):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}) for b in base for _ in range(40)})
    signed = [int(np.array([v], np.uint64).view(np.int64)[0]) for v in values]
    df = spark.createDataFrame([(x,) for x in signed], "f long")
    stars = {r["a"]: r["b"] for r in components(bktree.links(df, cap=cap)).collect()}
    rows = [(x, v) for x, v in zip(signed, values, strict=True)]
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (x, v) in enumerate(rows):
        for y, w in rows[:i]:
            if (v ^ w).bit_count() <= 3:
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    assert {x: stars.get(x, x) for x in signed} == {x: root(x) for x in signed}


def test_long_chain(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 901), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components(df).collect()} == {(i, 0) for i in range(1, n + 1)} | {(901, 900)}


def test_op3(spark, odd_docs, no_docs, sf):
    assert bktree.near_duplicates(no_docs).count() == 0
    for docs in (odd_docs, common.documents(spark, sf)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted(map(tuple, bktree.near_duplicates(docs).collect()), key=str) == plain_components(rows)
    kept = bktree.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and None in ids


def test_keep_one_keeps_one_row_of_each_class(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(1, a), (1, a), (2, b), (3, b), (3, c), (None, a), (None, d), (None, d), (None, e), (4, e), (5, None), (6, "")]
    for parts in (1, 3):
        kept = bktree.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (2, b), (3, c), (None, d), (4, e), (5, None)], key=str)


@pytest.mark.parametrize("block", [3, 7, 1 << 17])
def test_bwt_and_common_prefixes(block):
    rng = random.Random(0)
    for alphabet in (b"a", b"ab", b"\0\xf4z"):
        for _ in range(20):
            strings = list({bytes(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 12]))) for _ in range(rng.randint(1, 9))})
            with tempfile.TemporaryDirectory() as folder:
                lcp, owner, size = bcr.Collection(strings, folder, block).build()
            got = [strings[o][len(strings[o]) - n :] for o, n in zip(owner, size, strict=True)]
            assert got == sorted(got) and sorted(zip(owner.tolist(), size.tolist(), strict=True)) == sorted((i, n) for i, s in enumerate(strings) for n in range(len(s) + 1))
            for i in range(1, len(got)):
                n = next((k for k, (x, y) in enumerate(zip(got[i - 1], got[i], strict=False)) if x != y), min(len(got[i - 1]), len(got[i])))
                assert lcp[i] == n


def plain_removal(rows, length=100):
    """rows in order of doc_id."""
    seen, out = set(), []
    for d, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(w)
        mask = np.cumsum(gone)[: len(raw)] > 0
        spans = int((mask & ~np.concatenate(([False], mask[:-1]))).sum()) if len(raw) else 0
        out.append((d, len(raw), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def test_op9(spark, odd_docs, no_docs, sf):
    assert bcr.substring_dedup(no_docs).count() == 0
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(40))
    hard = [(i, " ".join(word() for _ in range(60)) + (passage[rng.randrange(60) :] if i % 3 else "") + ("ab" * 90 if i % 7 == 0 else "") + " ".join(word() for _ in range(20))) for i in range(60)]
    hard += [(100, "a" * 99), (101, "a" * 99), (102, "a" * 100), (103, "a" * 101), (104, hard[1][1]), (105, hard[1][1][:300] + "#" + hard[1][1][301:])]
    for docs in (spark.createDataFrame(hard, "doc_id long, text string").repartition(5), common.documents(spark, sf)):
        rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        assert sorted(map(tuple, bcr.substring_dedup(docs).collect())) == plain_removal(rows)
    # Keys of more than two different segments are dealt by windows.
    assert sorted(map(tuple, bcr.substring_dedup(spark.createDataFrame(hard, "doc_id long, text string"), hot=2).collect())) == plain_removal(hard)
    got = {r["doc_id"]: r["n_removed"] for r in bcr.substring_dedup(odd_docs).collect()}
    assert got[3] == got[4] == got[None] == 0 and got[2] == len(next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 2))
    left = bcr.remove_repeats(odd_docs)
    assert left.columns == odd_docs.columns and 2 not in [r["doc_id"] for r in left.collect()]


def test_op9_texts_that_share_a_doc_id(spark):
    rng = random.Random(9)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(3))
    rows = [(1, a), (5, b + a[:150]), (5, c), (5, c), (7, c[50:300] + b), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in bcr.substring_dedup(docs).collect() if r["doc_id"] is not None)
    assert got == [(1, 400, 0), (5, 400, 0), (5, 400, 0), (5, 550, 150), (7, 650, 650)]
    left = sorted(((r["doc_id"], r["text"]) for r in bcr.remove_repeats(docs).collect()), key=str)
    assert left == sorted([(1, a), (5, b), (5, c), (5, c), (None, a)], key=str)


def test_stages_without_rows(no_docs):
    for stage in (bcr.remove_repeats, bktree.keep_one):
        left = stage(no_docs)
        assert left.schema == no_docs.schema and left.count() == 0


def test_whole_characters():
    raw = "aéé b".encode()
    assert bcr._left_of(raw, [(2, 4)]) == "a b"
    assert bcr._left_of(raw, [(0, 1), (5, 6)]) == "éé" + "b"
