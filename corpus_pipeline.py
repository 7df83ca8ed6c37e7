"""A training corpus from documents: language, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. No stage changes
doc_id, lang or source. The result has one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bcr, binslack, bktree, common, langid, secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, or whose language no model tells from the others (posterior under one half)."""
    return langid.keep_identified(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the smallest doc_id stays."""
    return bktree.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text under a 100-byte string that starts earlier is removed; documents left without text go."""
    return bcr.remove_repeats(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secrets.mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of a document."""
    return binslack.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secret_spans), ("packing", packing)]

#: SQL can't express the language model, components, or packing: tests hold run()'s rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before = docs
        with common.scratch(spark):  # a stage's own tables go once its result is written, and then the stage's before it
            docs = common.keep(common.stash(stage(spark, before, sf_dir), name))
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
