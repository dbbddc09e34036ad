"""Every registered corpus query and every stage of the pipeline, on the smallest tables."""

import base64
import hashlib
import re

import duckdb
import pytest
import public_tokenizers
import tiktoken

import corpus_pipeline
from sunledger.llm.queries import LLM_ORACLE, LLM_QUERIES
from sunledger.session import settle

#: columns and types of the queries that have no SQL twin
CONTRACTS = {
    "op1_hash_tree_sharding": "doc_id long, size long, text_crc32 long, law string, shard int, "
                              "slot long, grown_shard int",
    "op2_pu_quality": "doc_id long, held_out boolean, score double, predicted int",
    "op5_semi_markov_pii": "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                           "base_sha256 string, spans string",
    "op6_prefix_token_counts": "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    "op7_dart_minhash": "doc_id long, class_id long",
    "op8_byte_bpe": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op10_weak_toxicity": "doc_id long, held_out boolean, score double, predicted int",
}
KINDS = {"long": "bigint"}


def texts(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


def tokenizer():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_every_query_has_a_contract_or_a_twin():
    assert set(CONTRACTS) | set(LLM_ORACLE) == set(LLM_QUERIES)


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_query_returns_one_row_per_document(spark, sf, name):
    found = settle(LLM_QUERIES[name](spark, sf))
    types = dict(found.dtypes)
    for column, kind in (c.split() for c in CONTRACTS[name].split(", ")):
        assert types[column] == KINDS.get(kind, kind), column
    assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == sorted(texts(sf))
    if "score" in types:
        assert found.where("score between 0 and 1 and predicted = int(score >= 0.3)"
                           ).count() == found.count()
    if name == "op8_byte_bpe":
        lib, given = tokenizer(), texts(sf)
        for r in found.collect():
            ids = lib.encode_ordinary(given[r["doc_id"]] or "")
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(
                (given[r["doc_id"]] or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents before the first stage and after each."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], sf)))
    return out


def test_stages_keep_the_columns_and_only_given_documents(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == before.columns
        assert {r[0] for r in after.select("doc_id").collect()} <= {
            r[0] for r in before.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_dedup", "decontamination", "pii", "byte_bpe"]


def test_toxic_documents_go_and_clean_ones_stay(spark, sf, stages):
    kept = {r[0] for r in stages[1].select("doc_id").collect()}
    marks = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [r["doc_id"] in kept for r in marks if r["toxic"] == 0]
    assert sum(clean) / len(clean) > 0.9
    assert kept != set(texts(sf))


def test_one_document_of_each_set_of_equal_texts_stays(stages):
    before, after = ({r["text"] for r in s.where("text is not null and length(text) > 0").collect()}
                     for s in stages[1:3])
    left = stages[2].where("length(text) > 0").select("text")
    assert left.count() == left.distinct().count() and after <= before


def test_contaminated_documents_go(sf, stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def windows(text, whole):
        w = word.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        n = min(10, len(w)) if whole else 10
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    items = [t for t, in duckdb.sql(f"select text from '{sf}/benchmark.parquet'").fetchall()]
    held = set().union(*[windows(t, True) for t in items])
    assert min(map(len, held)) == 10  # no short items here
    want = {r["doc_id"] for r in stages[2].collect() if not windows(r["text"], False) & held}
    assert {r["doc_id"] for r in stages[3].collect()} == want


def test_personal_data_is_replaced(stages):
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    before, after = ({r["doc_id"]: r["text"] or "" for r in s.collect()} for s in stages[3:5])
    assert set(before) == set(after) and any(mail.search(t) for t in before.values())
    assert not any(mail.search(t) for t in after.values())
    assert sum(before[d] == after[d] for d in before) > len(before) / 2


def test_tokens_are_those_of_the_redacted_texts(stages):
    lib = tokenizer()
    want = {r["doc_id"]: hashlib.sha256(",".join(map(str, lib.encode_ordinary(
        r["text"] or ""))).encode()).hexdigest() for r in stages[4].collect()}
    assert {r["doc_id"]: r["ids_sha256"] for r in stages[5].collect()} == want
