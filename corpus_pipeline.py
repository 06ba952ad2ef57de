"""Five stages from raw documents to token ids; each one's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import bpe, decontaminate, jaccard, quality, toxicity
from loomwright.llm.common import stage, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = quality.QualityParameters()
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), p), p)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.ToxicityParameters()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the text decoded from them."""
    tokens = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, text_digest=True, tables=bpe.SMALL_TABLES)
    return tokens.select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_good_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL can express neither the trained stages nor the encoding; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of the documents that all stages keep.

    Null texts count as empty; rows with null doc_ids go through every stage
    as documents of their own; of repeated doc_ids one row is left after the
    join, that of the least text. Other columns, whatever their names, pass
    through all stages but the last. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
