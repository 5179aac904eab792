"""A corpus pipeline of four stages, each a Spark job over what its predecessor kept.

    toxicity      documents that the classifier rejects go
    near_dedup    one document of each group of near-duplicates stays
    mix           sources are mixed to target weights; documents may repeat or go
    tokens        byte-level BPE ids of every document

``run`` writes each stage's rows as Parquet in the shared folder and reads them again, so a
lost executor costs no more than the stage at work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksrisk.llm import byte_bpe, minhash, mixing, toxicity
from worksrisk.llm.common import table
from worksrisk.session import Staging


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from ``labels`` and ``documents`` of ``sf_dir``; held-out labels are not read."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "documents"),
                                 table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more; the smallest doc_id stays."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn; no document is taken more than three times."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every row; the digest is of decoded ids.

    Workers that have served the other stages remember fewer pieces than by default.
    """
    encoded = byte_bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        remember=80_000)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokens", encode),
]

#: A trained classifier and BPE are not in SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = stage.table(name, function(spark, docs, sf_dir))
        if i:
            stage.drop(STAGES[i - 1][0])
    return docs
