"""A corpus pipeline: quality, repeated lines, near duplicates, mix, tokens. Each stage takes what its predecessor kept.

All stages but the last return the columns of ``documents``. The quality stage drops documents whose perplexity is above their language's
threshold; line dedup takes repeated passages out of texts; near-dedup keeps the document of the least id of each component;
mixing repeats or drops documents to meet the sources' targets; the last stage encodes every text and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import bpe, line_dedup, mixing, quality, simhash
from quarrylens.llm.common import read, stored

#: Near duplicates: words a shingle, and the least similarity of their sets.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_dedup.dedup_lines(docs), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, similarity=SIMILARITY, width=SHINGLE_WORDS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(mixing.mixed_documents(docs), docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a row for each time a document is in the mix."""
    return bpe.encode_digests(docs)


def _recounted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The count of characters follows the text."""
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("BPE", bpe_stage),
]

#: The classifier and the fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
