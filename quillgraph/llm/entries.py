"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bcr, binslack, bktree, crf, gif, langid, mcd, merkle, pieces, rans, secrets, sparseprod, sumsquares


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rans_token_files": rans.op1_rans_token_files,
        "op2_gif_media": gif.op2_gif_media,
        "op3_simhash_bktree": bktree.op3_simhash_bktree,
        "op4_secret_scans": secrets.op4_secret_scans,
        "op5_sentencepiece_chunks": pieces.op5_sentencepiece_chunks,
        "op6_bin_slack_packing": binslack.op6_bin_slack_packing,
        "op7_mcd_quality": mcd.op7_mcd_quality,
        "op8_crf_toxicity": crf.op8_crf_toxicity,
        "op9_bcr_substring_dedup": bcr.op9_bcr_substring_dedup,
        "op10_language_id": langid.op10_language_id,
        "op11_sparse_product_search": sparseprod.op11_sparse_product_search,
        "op12_sum_of_squares_packing": sumsquares.op12_sum_of_squares_packing,
        "op13_merkle_lookup_proofs": merkle.op13_merkle_lookup_proofs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in {"pipeline": corpus_pipeline.ORACLE_SQL, "op11_sparse_product_search": sparseprod.SQL, "op13_merkle_lookup_proofs": merkle.SQL}.items() if v}
