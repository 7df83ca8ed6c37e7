"""Ops 11, 12 and 13 against plain versions."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import common, entries, merkle, sparseprod, sumsquares

from test_tokens import crc, hf

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=10):
    rows = [(d, plain_terms(t)) for d, t in docs]
    rows = [(d, Counter(ts), len(ts)) for d, ts in rows if ts]
    n_docs, n_terms, df = len(rows), sum(n for _, _, n in rows), Counter(t for _, c, _ in rows for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for d, tf, n in rows:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in plain_terms(text) if t in tf)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "The FOX, the fox and the dog", "x"), (1, "The FOX, the fox and the dog", "y"), (1, "tale", None), (2, None, None), (3, "?!", None), (None, "日本語 Ünïcode satz", None), (5, "", None), (6, "nowhere", None)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def test_op11(spark, odd_docs, no_docs, asked, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for docs in (odd_docs, no_docs, common.documents(spark, sf)):
        for items in (asked, bench):
            want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
            assert Counter(map(tuple, sparseprod.search(docs, items).collect())) == want
    assert sparseprod.search(odd_docs, asked.limit(0)).collect() == []
    few = sparseprod.search(odd_docs, asked, k=1, block_items=1).collect()  # blocks of about one item
    assert Counter(map(tuple, few)) == plain_search([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [(r["item_id"], r["text"]) for r in asked.collect()], 1)


def test_terms_of_cut_texts():
    text = "Ab9 Ü-é_x" * 500 + " " + "y" * 3000
    whole = [t for run in sparseprod.term_runs(text.encode(), 100) for t in run]
    assert [t.decode() for t in whole] == plain_terms(text)


def test_product_is_the_matrix_product():
    rng = np.random.default_rng(5)
    dense = rng.integers(0, 3, (6, 9)) * rng.integers(1 << 40, 1 << 45, (6, 9))  # term rows, whose sums pass what doubles hold
    term, doc = np.nonzero(dense)
    bounds, out = np.searchsorted(term, np.arange(7)), np.empty(9, np.int64)
    times = rng.integers(0, 4, 6)
    sparseprod.multiply((np.flatnonzero(times), times[times > 0]), bounds, doc, dense[term, doc], out)
    assert (out == times @ dense).all()


def test_sum_of_squares_rule():
    """Each placing leaves the least sum of squares that any place would."""
    rng, now = random.Random(2), sumsquares.Sequences(24)
    for _ in range(400):
        length, gaps = rng.randint(1, 24), now.gaps.copy()

        def squares(gap, gaps=gaps, length=length):
            after = gaps.copy()
            if gap < 24:
                after[gap] -= 1
            after[gap - length] += 1
            return int((after[1:24] ** 2).sum())

        best = min(squares(g) for g in range(length, 25) if g == 24 or gaps[g])
        now.place(length, 1)
        assert int((now.gaps[1:24] ** 2).sum()) == best


@pytest.mark.parametrize("times, steps", [(1, 1 << 18), (3, 50), (10**6, 2000)])
def test_sum_of_squares_plan(times, steps):
    rng = random.Random(9)
    counts = Counter(min(512, max(1, int(rng.lognormvariate(4, 1)))) for _ in range(3000))
    counts = {k: n * times + rng.randrange(times) for k, n in counts.items()}
    p = sumsquares.plan(counts, 512, steps)
    used = Counter()
    for n, use in p.windows:
        assert sum(k * v for k, v in use.items()) <= 512
        for k, v in use.items():
            used[k] += n * v
    assert used == Counter(counts)
    least = sum(k * n for k, n in counts.items()) / 512
    assert sum(n for n, _ in p.windows) <= 1.02 * least + 5
    assert sumsquares.plan({}, 512).windows == []


def test_sum_of_squares_lots_depend_on_a_length_alone(monkeypatch):
    """Small and large inputs go by one rule: what else is packed doesn't change the lots of a length."""

    def lots(counts):
        placed: dict = {}
        place = sumsquares.Sequences.place
        with monkeypatch.context() as m:
            m.setattr(sumsquares.Sequences, "place", lambda self, length, lot: (placed.setdefault(length, []).append(lot), place(self, length, lot))[1])
            sumsquares.place_all(counts, 512, True)
        return placed

    small = {300: 5, 77: 64, 40: 64 * 64 + 3 * 64 + 1, 9: 200}
    alone, beside = lots(small), lots(small | {100: 10**10})
    assert alone == {k: beside[k] for k in small}
    assert alone[40] == [4096, 64, 64, 64, 1] and alone[300] == [1] * 5
    assert all(sum(v) == small[k] for k, v in alone.items())


def test_op12(spark, odd_docs, no_docs, sf):
    enc = hf(sumsquares.TOKENIZER)
    assert sumsquares.pack_documents(no_docs).count() == 0
    for docs in (odd_docs, common.documents(spark, sf)):
        rows = sumsquares.pack_documents(docs).collect()
        want = Counter()
        for r in docs.collect():
            ids = [*enc(r["text"]), sumsquares.END_ID]
            want.update((r["doc_id"], s // 2048, s, min(2048, len(ids) - s), crc(ids[s : s + 2048])) for s in range(0, len(ids), 2048))
        assert Counter(tuple(r)[:5] for r in rows) == want
        by: dict = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, group=16):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def rise(level):  # levels of a tree
        out = [level]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + group]) for i in range(0, len(out[-1]), group)])
        return out

    def proof(levels, at):
        for level in levels[:-1]:
            low = at // group * group
            yield level[low:at], level[at + 1 : low + group]
            at //= group

    by: dict = {}
    for r in rows:
        leaf = H(*(enc(r[c]) for c in merkle.FIELDS))
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        text = r["text"].translate(LOWER) if hit and r["text"] is not None else r["text"]
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, H(*(enc(r[c]) for c in merkle.FIELDS[:-1]), enc(text)), r["doc_id"]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: rise([x[2] for x in sorted(by[s])]) for s in names}
    top = rise([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for at, (_, _, leaf, node, doc_id) in enumerate(sorted(by[s])):
            path = [*proof(trees[s], at), *proof(top, i)]
            for left, right in path:
                node = H(*left, node, *right)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], H(*(x for p in path for side in p for x in side)), node, node == top[-1][0]))
    return Counter(out)


@pytest.fixture
def written(tmp_path):
    def write(docs):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_op13(spark, odd_docs, no_docs, written, sf):
    many = spark.range(700).selectExpr("id % 690 as doc_id", "if(id % 3 = 0, 'A Text', null) as text", "if(id % 100 = 0, null, if(id < 600, 'hot', concat('s', id))) as source", "'en' as lang", "id as n_chars", "'x' as leaf", "1 as idx")
    one = many.limit(1)
    for docs in (odd_docs, many, one):
        got = merkle.op13_merkle_lookup_proofs(spark, written(docs)).collect()
        assert Counter(map(tuple, got)) == plain_manifest(docs.collect())
    assert merkle.op13_merkle_lookup_proofs(spark, written(no_docs)).collect() == []
    got = merkle.op13_merkle_lookup_proofs(spark, sf).collect()
    assert Counter(map(tuple, got)) == plain_manifest(common.documents(spark, sf).collect())
    assert {r["verified"] for r in got} == {True, False}


def test_op13_without_broadcasts(spark, written, monkeypatch):
    """Levels and shares beyond the bounds of a broadcast are joined by shuffle, with the same rows."""
    docs = spark.range(500).selectExpr("id as doc_id", "'T' as text", "if(id < 200, 'hot', concat('s', id % 80)) as source", "'en' as lang", "id as n_chars")
    for name in ("BROADCAST_NODES", "BROADCAST_SHARES"):
        monkeypatch.setattr(merkle, name, 40)
    assert Counter(map(tuple, merkle.op13_merkle_lookup_proofs(spark, written(docs)).collect())) == plain_manifest(docs.collect())


def test_proofs_of_small_groups(spark):
    leaves = spark.createDataFrame([(i % 3, i, H(str(i))) for i in range(100)], "source int, doc_id long, leaf string").selectExpr("cast(source as string) source", "doc_id", "leaf")
    proven, levels, tops, root = merkle.manifest(leaves, 2)
    assert len(levels) == 7 and len(tops) == 3
    assert proven.filter(merkle.fold(proven["leaf"], proven["proof"]) == root).count() == 100


@pytest.mark.parametrize("name", ["op11_sparse_product_search", "op13_merkle_lookup_proofs"])
def test_sql_gives_the_rows(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {f.rsplit('/', 1)[1][:-8]} as select * from read_parquet('{f}')")
    found = c.execute(entries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = entries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(found.fetchall())
