"""The registered queries of the operators on text corpora, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.llm import (byte_bpe, conversation_trie, decontamination, merkle, near_dup, pii,
                           quality, repeats, sharding, token_counts, topk, toxicity, url_filters)
from sunledger.llm.common import crc_fold, table
from sunledger.llm.oracle import LLM_ORACLE

N_SHARDS, TOKEN_LIMIT, CUT = 24, 1024, 0.3


def _held_out(parts: int, part: int):
    return F.coalesce(crc_fold("doc_id", parts) == part, F.lit(False))


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), "doc_id", "text",
                                 sharding.topology(N_SHARDS))
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32",
                         F.lit("key").alias("law"), "shard", F.col("slot").cast("long"),
                         "grown_shard")


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _held_out(5, 0))
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    return quality.score(docs, model, ["doc_id", "held_out"]).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int"))


def op3_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op4_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size("_hit").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_hit") > 0).alias("contaminated"))


def op5_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit(docs))


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                        public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = byte_bpe.encode(docs, path).select("doc_id", "ids")
    return byte_bpe.digests(byte_bpe.decode(ids, path))


def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _held_out(4, 2))
    voters, model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    return toxicity.score(docs, voters, model, ["doc_id", "held_out"]).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int"))


def op11_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.judge(pages, "url", ["page_id"], rules=url_filters.URL_RULES)
    return judged.withColumn("terms", F.array_join("terms", ","))


def op12_slot_pivot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def leaf(n_chars):
        return merkle.digest(*[merkle.field(c) for c in (
            F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))])

    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
                      leaf(F.col("n_chars").cast("decimal(20,0)") + 1))
    rows = merkle.manifest(docs, "doc_id", "lang", leaf(F.col("n_chars")), changed=tampered)
    return merkle.check_proofs(rows).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        "verified")


def op13_prefix_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    convs, turns = conversation_trie.rebuilt(
        table(spark, sf_dir, "conversations"), conv - conv % 5,
        F.crc32(conv.cast("string").cast("binary")) % 9, 8)
    return conversation_trie.prefix_trie(convs, turns)


LLM_QUERIES = {f.__name__: f for f in (
    op1_hash_tree_sharding, op2_pu_quality, op3_norm_bucket_topk, op4_aho_corasick,
    op5_semi_markov_pii, op6_prefix_token_counts, op7_dart_minhash, op8_byte_bpe,
    op9_run_length_index, op10_weak_toxicity, op11_url_vocabulary, op12_slot_pivot_manifest,
    op13_prefix_slots)}

__all__ = ["LLM_ORACLE", "LLM_QUERIES"]
