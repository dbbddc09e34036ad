"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, tokens.

``STAGES`` lists (name, function); every function takes (spark, documents so far, folder of
the tables) and returns a DataFrame, which is written and read again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.llm import byte_bpe, decontamination, near_dup, pii, toxicity
from sunledger.llm.common import crc_fold, table
from sunledger.session import settle

TOXIC_FROM = 0.3

#: SQL cannot state the learned stages; tests compare the stages with brute force
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``; labels of the held-out fold stay unseen."""
    train = F.coalesce(crc_fold("doc_id", 4) != 2, F.lit(False))
    voters, model = toxicity.learn(docs, table(spark, sf_dir, "labels"), train)
    return toxicity.drop_toxic(docs, voters, model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redact_documents(docs, pii.fit(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(docs.select("doc_id", "text"), path).select("doc_id", "ids")
    return byte_bpe.digests(byte_bpe.decode(ids, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
