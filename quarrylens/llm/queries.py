"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.llm import bpe, html_extract, line_dedup, mixing, mpeg_audio, mtree, quality, secrets, simhash, token_counts
from quarrylens.llm.common import read


def line_dedup_query(spark, d):
    """doc_id, the text that is left, how many lines went."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, removed_col="lines_removed")


QUERIES = {
    "op1_top_k_search": lambda spark, d: mtree.top_k(read(spark, d, "embeddings"), F.col("id") % 50 == 0),
    "op2_simhash_near_dedup": lambda spark, d: simhash.near_duplicates(read(spark, d, "documents")),
    "op3_bpe": lambda spark, d: bpe.encode_digests(read(spark, d, "documents")),
    "op4_mixing": lambda spark, d: mixing.mix(read(spark, d, "documents")),
    "op5_token_counts": lambda spark, d: token_counts.token_counts(read(spark, d, "documents")),
    "op6_line_dedup": line_dedup_query,
    "op7_html_extraction": lambda spark, d: html_extract.extract(read(spark, d, "pages")),
    "op8_media_columns": lambda spark, d: mpeg_audio.text_media(read(spark, d, "documents")),
    "op9_secret_scans": lambda spark, d: secrets.find_secrets(read(spark, d, "documents")),
    "op10_quality_classifier": lambda spark, d: quality.classify(read(spark, d, "documents"), read(spark, d, "labels")),
}

ORACLES = {"op1_top_k_search": mtree.ORACLE, "op4_mixing": mixing.ORACLE}
