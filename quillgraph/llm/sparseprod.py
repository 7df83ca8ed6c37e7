"""Ranked lexical search as a blocked sparse matrix product.

One factor has a row per item and the multiplicity of each term in it, the other a row per term and each document's int64 impact
of that term; their product holds all scores. Documents are read once: each becomes a sparse row of the counts of the items'
terms, and the rows of all documents are a table. A task turns the rows of a block of documents into term rows of impacts, and
Gustavson's scheme merges, for each item, the term rows its multiplicities name into one dense row of the block's documents. From
that row the k best go into the task's reduction; the k best of all tasks are found by windows over (item, bucket), then item.

Items come in blocks of about ``BLOCK_BYTES`` of text, one product each, so neither the vocabulary nor the multiplicities that
go to the tasks grow with the number of items. Scores of a block of documents fill one int64 a document, whatever its size.

A document without a term (null, empty, only signs) has no score and isn't counted. Null doc_ids count as documents and come last
among equal scores. A repeated doc_id is a document for each of its rows. An item is an (item_id, text): repeated rows of it are
answered once, two texts of one item_id apart. No documents, no items, or items without terms: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks, common

K = 10
#: UTF-8 bytes of item texts in a block, about; items in a block, at most about.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 20_000
#: Bytes of a text that are cut into terms at once, about.
CUT_BYTES = 1 << 20
#: Documents for each bucket of the first reduction, squared.
PER_BUCKET = 10_000
ROWS = "doc_id long, n long, terms array<int>, tf array<int>"

_LOWER = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(128)).lower() + bytes(range(128, 256)))


def term_runs(data: bytes, most: int = CUT_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in order, as UTF-8, in lists: letters, digits and all beyond ASCII belong to terms, A-Z lower-cased."""
    low, a = data.translate(_LOWER), 0
    while a < len(low):
        b = len(low) if a + most >= len(low) else low.find(b" ", a + most)
        b = len(low) if b < 0 else b
        yield low[a:b].split()
        a = b


def terms_of(text: str | None) -> list[bytes]:
    return [t for run in term_runs((text or "").encode()) for t in run]


def count_terms(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Per document the number of its terms and its sparse row: the numbered terms it holds, ascending, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(number)  # bounded by a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, width = shared.value.get, max(1, len(shared.value))
        for batch in batches:
            for part, data, offsets in chunks.pieces_of(batch):
                raw, rows = data.tobytes(), part.num_rows
                n, keys = np.zeros(rows, np.int64), [np.zeros(0, np.int64)]
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    for words in term_runs(raw[a:b]):
                        n[row] += len(words)
                        ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                        keys.append(ids[ids >= 0] + row * width)
                held, tf = np.unique(np.concatenate(keys), return_counts=True)
                ends = pa.array(np.searchsorted(held, np.arange(rows + 1) * width).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (held % width, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tf"])

    return common.texts(docs).mapInArrow(run, ROWS)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of occurrences: their term's weight, their count, the terms of their document; n_docs and n_terms of the corpus."""
    m = 25 + 75 * n * n_docs // max(1, n_terms)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def multiply(item: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, docs: np.ndarray, impact: np.ndarray, out: np.ndarray) -> None:
    """out: the item's row of the product. Row t of the right factor is docs[bounds[t]:bounds[t + 1]] with these impacts."""
    out.fill(0)
    for t, times in zip(*item, strict=True):
        a, b = bounds[t], bounds[t + 1]
        if a < b:  # a document is in a term's row once at most
            out[docs[a:b]] += times * impact[a:b]


def best(score: np.ndarray, doc_id: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best above 0: by score, nulls last among equals, then doc_id."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((doc_id[at], null[at], -score[at]))[:k]]


def product(rows: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best documents of each item among those of each task: item_no, doc_id, score."""
    shared = rows.sparkSession.sparkContext.broadcast((items, weight))  # bounded by a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        none = np.zeros(0, np.int64)
        top = [(none, none, none.astype(bool))] * len(items)
        for batch in batches:
            ids = batch.column("doc_id")
            null, doc_id = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
            terms, counts = batch.column("terms"), batch.column("tf")
            each = np.diff(terms.offsets.to_numpy())
            doc = np.repeat(np.arange(len(each)), each)
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in (terms, counts))
            impact = impacts(weight[term], tf, np.repeat(batch.column("n").to_numpy(), each), n_docs, n_terms)
            order = np.argsort(term, kind="stable")
            bounds = np.searchsorted(term[order], np.arange(len(weight) + 1))
            doc, impact, score = doc[order], impact[order], np.empty(len(each), np.int64)
            for i, item in enumerate(items):
                multiply(item, bounds, doc, impact, score)
                at = best(score, doc_id, null, k)
                if len(at):
                    all_of = [np.concatenate(x) for x in zip(top[i], (score[at], doc_id[at], null[at]), strict=True)]
                    keep = best(*all_of, k)
                    top[i] = tuple(x[keep] for x in all_of)
        held = [i for i, t in enumerate(top) if len(t[0])]
        if held:
            score, doc_id, null = (np.concatenate([top[i][c] for i in held]) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, [len(top[i][0]) for i in held]).astype(np.int32)), pa.array(doc_id, mask=null), pa.array(score)], names=["item_no", "doc_id", "score"])

    return rows.mapInArrow(run, "item_no int, doc_id long, score long")


def search_block(docs: DataFrame, block: list[tuple], id_type: str, k: int) -> DataFrame:
    """The answers to the items of one block."""
    spark = docs.sparkSession
    texts = [terms_of(text) for _, text in block]
    vocabulary = sorted({t for words in texts for t in words})
    number = {t: i for i, t in enumerate(vocabulary)}
    items = []
    for words in texts:
        held = sorted(Counter(number[t] for t in words).items())
        items.append((np.array([t for t, _ in held], np.int64), np.array([c for _, c in held], np.int64)))
    rows = common.stash(count_terms(docs, number), "term-counts")
    total = rows.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():  # one row a term of the block
        df[r["t"]] = r["n"]
    found = product(rows, items, weights(total["docs"], df), total["docs"], total["terms"], k)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    buckets = isqrt(total["docs"] // PER_BUCKET) + 1
    part = Window.partitionBy("item_no", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).orderBy(*order)
    whole = Window.partitionBy("item_no").orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item_no int, item_id {id_type}")
    return ranked.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score")  # names: BLOCK_ITEMS at most, about


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k highest-scoring of all docs (doc_id, text) for each of items (item_id, text)."""
    spark, id_type = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    asked = common.stash(items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct(), "items")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["bytes"] // block_bytes))
    out = [spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")] if not size["n"] else []
    for b in range(blocks if size["n"] else 0):
        block = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toLocalIterator()]
        if block:
            out.append(search_block(docs, block, id_type, k))
    return reduce(DataFrame.unionAll, out)


def op11_sparse_product_search(spark, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ts from documents where text is not null),
corpus as (select count(*) as nd, sum(len(ts))::bigint as nt from docs where len(ts) > 0),
tfs as (select r, doc_id, len(ts)::bigint as n, t, count(*)::bigint as tf from (select r, doc_id, ts, unnest(ts) as t from docs) group by all),
dfs as (select t, count(*) as df from tfs group by t),
impact as (select r, doc_id, t, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt))) as x from tfs join dfs using (t), corpus),
asked as (select distinct item_id, text from benchmark where text is not null),
mult as (select item_id, text, t, count(*) as q from (select item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as t from asked) group by all),
scored as (select item_id, text, r, doc_id, sum(q * x)::bigint as score from mult join impact using (t) group by item_id, text, r, doc_id),
ranked as (select item_id, row_number() over (partition by item_id, text order by score desc, doc_id asc nulls last)::int as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
