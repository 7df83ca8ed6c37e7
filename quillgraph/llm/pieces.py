"""SentencePiece encoding and decoding by a distinct-chunk table.

The model's pieces are checked not to cross white-space markers; then each distinct marked word of a batch is segmented once
and its ids are laid out by position (see chunks). A null or empty text has no ids; null doc_ids are kept; rows are
independent of each other, so repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks, common

MODEL = "piece_bpe_32k.model"


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks.piece_table(model)
        for batch in batches:
            for part, data, offsets in chunks.pieces_of(batch):
                ids, at = chunks.marked_words(table, data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return common.texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids and the decoded text; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = chunks.piece_table(model).sp
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array([sp.decode(x) if x else "" for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Number of ids, a digest of them and a digest of the text decoded from them, made in one pass so that ids needn't leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks.piece_table(model)
        for batch in batches:
            for part, data, offsets in chunks.pieces_of(batch):
                ids, at = chunks.marked_words(table, data, offsets)
                each = [ids[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in each]
                decoded = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in table.sp.decode(each)] if each else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(sha, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_sentencepiece_chunks(spark, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
