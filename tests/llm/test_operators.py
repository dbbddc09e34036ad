"""The corpus operators against brute force on small tables, and their edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sunledger.llm import (byte_bpe, decontamination, near_dup, pii, quality, repeats, sharding,
                           token_counts, topk, toxicity)

DOCS = "doc_id long, text string, score double, key string, digest string, `_n_words` int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
                    for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    """Ids with texts: NULLs, empty, very long, equal, near-equal and repeated rows."""
    rng = random.Random(4)
    plain = [sentence(rng, 60) for _ in range(12)]
    near = plain[0].split(" ")
    near[30] = "changed"
    passage = sentence(rng, 50)
    body = [*plain, plain[1], plain[1], " ".join(near), passage + " " + plain[2],
            plain[3] + " " + passage, None, "", "   ", "one two", "ÉÉ é ß 日本 🙂 x" * 3,
            sentence(rng, 20_000)]
    rows = list(enumerate(body)) + [(None, plain[4]), (None, None), (7, plain[7])]
    return [(i, t, 0.5, "k", None, 1) for i, t in rows]


@pytest.fixture()
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCS).repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_shards_follow_the_law_and_slots_have_no_gaps(docs, empty, texts):
    tree = sharding.topology(24)
    rows = sharding.shard_rows(docs, "doc_id", "text", tree).collect()
    assert len(rows) == len(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
                      for _, t, *_ in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == expected
    assert sharding.shard_rows(empty, "doc_id", "text", tree).count() == 0


def test_shards_take_rows_by_weight_and_only_changed_branches_move(spark):
    keys = spark.range(6000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.topology(16)
    heavy = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    rows = keys.select(sharding.place(F.col("k"), tree).alias("a"),
                       sharding.place(F.col("k"), heavy).alias("b")).collect()
    share = collections.Counter(r["b"] for r in rows)
    assert abs(share[5] / 6000 - 3 / 18) < 0.03
    where = {s.shard: (s.region, s.rack) for s in tree}
    for r in rows:
        if r["a"] != r["b"]:
            assert where[r["b"]][0] == where[5][0]  # into the branch that grew
            if where[r["a"]][0] == where[5][0]:
                assert where[r["b"]] == where[5]
            if where[r["a"]] == where[5]:
                assert r["b"] == 5


def test_quality_is_learned_without_marks_of_zero(spark, empty):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 40) if i % 4 else " ".join(
        w.upper() + "!!" for w in sentence(rng, 40).split())) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, "x") for i, _ in rows if i % 4 and i % 3],
                                   "doc_id long, quality int, text string")
    model = quality.learn(docs, labels, F.col("doc_id") % 5 != 0)
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, model, ["doc_id"]).collect()}
    held = [i for i, _ in rows if i % 5 == 0]
    assert np.mean([(scored[i] >= 0.3) == bool(i % 4) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in scored.values()) and len(scored) == 402
    assert quality.learn(docs, labels.where("false"), F.lit(True)) is None
    assert quality.score(empty, None, ["doc_id"]).count() == 0


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    raw = [(i, [float(x) for x in rng.normal(size=8) * (1 + 4 * (i % 7 == 0))]) for i in range(300)]
    raw += [(i, raw[20][1]) for i in range(300, 330)]
    extra = [(400, None), (401, [1.0, None]), (440, [float("nan")] * 8), (None, [1.0] * 8),
             (460, [float("inf")] * 8), (480, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in raw + extra],
                                  "vec_id long, embedding array<float>, rank int, score int")
    got = [tuple(r) for r in topk.search(frame).orderBy("query_id", "rank").collect()]
    live = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int))
            for i, v in [*raw, extra[-1]]]
    want = []
    for i, v in live:
        if i % 20 == 0:
            best = sorted((-int(v @ u), j) for j, u in live if j != i)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(frame.where("vec_id = 20")).count() == 0
    assert topk.search(frame.where("false")).count() == 0


def test_pruning_by_coordinates_keeps_all_above_the_floor():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-60, 60, (500, 16))
    block = topk.Block(np.arange(500), vectors)
    for q in rng.integers(-60, 60, (40, 16)):
        scores = vectors @ q
        floor = float(np.sort(scores)[-6])
        ids, _ = block.search(q, -1, floor, 20)
        assert sorted(ids) == sorted(np.flatnonzero(scores >= floor))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, body in items:
        own = WORD.findall(lower(body))
        for i in range(max(1, len(own) - 9) if own else 0):
            w = own[i:i + 10]
            for j in range(len(words) - len(w) + 1):
                if words[j:j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    found.add(str(item))
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_contamination_equals_brute_force(spark, docs, empty, texts, part_bytes):
    items = [(3, " ".join(texts[5][1].split(" ")[10:30]).upper()), (11, texts[6][1][:90]),
             (2, "one  TWO"), (5, None), (6, "..."), (11, texts[6][1][:90])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, x int")
    found = decontamination.find_contamination(docs, bench, part_bytes=part_bytes)
    got = sorted((str(r["doc_id"]), str(r["text"]), r["_n_words"], list(r["_hit"]),
                  list(r["_items"])) for r in found.collect())
    assert got == sorted((str(i), str(t), *contamination(t, items)) for i, t, *_ in texts)
    spans = decontamination.contamination_spans(found).where("doc_id = 5").first()["spans"]
    words = texts[5][1].split(" ")
    start = len(" ".join(words[:10])) + 1
    assert [tuple(s) for s in spans] == [(start, start + len(" ".join(words[10:30])))]
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert decontamination.find_contamination(docs, bench.where("false")).where(
        F.size("_hit") > 0).count() == 0


RULES = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(8)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "1", "22", "255", "256", "4111 1111 1111 1111",
            "10.0.0.1", "+1 (555) 123-4567", "x@y.z", "é", "\n", "%", "_", "00000", "(", ")"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_random_field_keeps_base_spans_and_adds_what_they_miss(spark, empty):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        tail = [f"mail a{i}@mail.example.com now", f"host 10.1.{i % 250}.7 up",
                f"call +1 (555) 123-{1000 + i}", "pay 4451718024887799 due",
                f"order 12345{i} of {i}.5"][i % 5]
        rows.append((i, f"{sentence(rng, 8)} {tail} {sentence(rng, 5)}", 3))
    rows += [(500, "pay 4451718024887799 27.65.9 ok", 0), (501, None, 0), (502, "", 0),
             (503, "9" * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    weights = pii.fit(docs)
    got = {r["doc_id"]: r for r in pii.find_pii(docs, weights).collect()}
    for i, text, _ in rows:
        base = plain_spans(text or "")
        assert got[i]["base_sha256"] == hashlib.sha256(pii.listing(base).encode()).hexdigest()
        assert set(pii.listing(base).split(",")) - {""} <= set(got[i]["spans"].split(","))
        added = [tuple(map(int, x.split(":")[1:])) for x in got[i]["spans"].split(",") if x]
        outer = [s for s in added if s not in [(a, b) for _, a, b in base]]
        assert all(b <= x or a >= y for a, b in outer for _, x, y in base)
    # the field alone, without the rules, finds what the rules mark
    alone = [set(plain_spans(t)) <= set(pii.decode(t, weights, 0.0)) for i, t, _ in rows[:150]]
    assert np.mean(alone) > 0.9
    assert sum(len(r["spans"].split(",")) for i, r in got.items() if i % 5 == 4 and i < 150) == 30
    clean = {r["doc_id"]: r for r in pii.redact_documents(docs, weights).collect()}
    assert "[EMAIL]" in clean[0]["text"] and clean[501]["text"] is None
    assert clean[0]["n_chars"] == len(clean[0]["text"])
    assert pii.find_pii(empty, np.zeros_like(weights)).count() == 0
    assert not pii.fit(empty).any()


def test_token_counts_of_all_prefixes(docs, empty, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    count = lambda s: len(own.encode(s or "", add_special_tokens=False).ids)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"])
                              for r in token_counts.count_tokens(docs, path).collect())
    assert got == collections.Counter((i, len((t or "").encode()), count(t)) for i, t, *_ in texts)
    rng, model = random.Random(6), token_counts.PrefixModel(path, memo=50)
    bits = ["a", " ", "  ", "\n", "'s", "'", "é", "1", "23", "!", "<|endoftext|>", "the", "\t",
            "'re", "日本", "🙂", "---", "ation"]
    for _ in range(400):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert list(model.prefixes(s)) == [count(s[:i]) for i in range(len(s) + 1)]
    short = docs.where(F.length("text") < 60)
    for r in token_counts.truncate(short, path, 3).collect():
        assert r["n_tokens"] == count(r["kept"]) <= 3
    assert token_counts.count_tokens(empty, path).count() == 0


def shingles(t):
    w = WORD.findall(t.lower())
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else {}


def near_classes(rows):
    bags = [shingles(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            both = sum(min(n, b.get(k, 0)) for k, n in a.items()) if a and b else 0
            union = (sum(a.values()) + sum(b.values()) - both) if a and b else 1
            if both / union >= 0.8 or (rows[i][1] is not None and rows[i][1] == rows[j][1]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def test_near_duplicates_equal_brute_force(spark, docs, empty, texts):
    rng = random.Random(9)
    base = sentence(rng, 80).split(" ")
    rows = [(i, t) for i, t, *_ in texts if i is not None and (i, t) != (7, texts[7][1])]
    for n in range(30):  # a chain and a cloud of near copies around one text
        copy = list(base)
        for k in rng.sample(range(80), 1 + n % 4):
            copy[k] = f"w{rng.random()}"
        rows.append((100 + n, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame).collect()}
    want = near_classes(rows)
    groups = collections.defaultdict(list)
    for (i, _), c in zip(rows, want):
        groups[c].append(i)
    assert got == {i: min(g) for g in groups.values() for i in g}
    kept = sorted(r["doc_id"] for r in near_dup.keep_one(frame).collect())
    assert kept == sorted(min(g) for g in groups.values())
    assert near_dup.near_duplicates(docs).count() == len(texts)
    assert near_dup.near_duplicates(empty).count() == near_dup.keep_one(empty).count() == 0


def test_rarest_shingles_find_every_similar_pair(spark):
    rng = random.Random(21)
    rows = []
    for c in range(3):  # clouds whose texts meet each other at about 0.8
        base = sentence(rng, 60 + 5 * c).split(" ")
        for n in range(25):
            copy = list(base)
            for k in rng.sample(range(len(base)), rng.choice((0, 1, 1, 2))):
                copy[k] = rng.choice(("one", "two", f"w{rng.random()}"))
            rows.append(" ".join(copy + base[:20] * (n % 3 == 0)))
    rows = sorted(set(rows))
    bags = [shingles(t) for t in rows]
    both = lambda a, b: sum((a & b).values())
    want = {(i, j) for j in range(len(rows)) for i in range(j)
            if i % 7 != j % 7 and 9 * both(bags[i], bags[j]) >= 4 * (
                sum(bags[i].values()) + sum(bags[j].values()))}
    texts = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(rows)],
                                  "digest string, text string")
    divided = spark.createDataFrame([(f"{i:03d}", f"{i % 7}") for i in range(len(rows))],
                                    "digest string, label string")
    got = {(int(r["a"]), int(r["b"])) for r in near_dup._prefix_pairs(divided, texts).collect()}
    assert want and want <= got
    assert len(got) < len(rows) ** 2 / 4


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = random.Random(2)
    words = sentence(rng, 200).split(" ")
    other = [w if i % 40 else "x" for i, w in enumerate(words)]
    h, o = near_dup.shingle_hashes(pa.array([" ".join(words), " ".join(other)]))
    sig = near_dup.dart_signatures(h, o, 2, 3000)
    true = near_dup.similarity(h[o == 0], h[o == 1])
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_encoding_equals_the_library_and_decoding_inverts_it(docs, empty, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(docs, path, n_head=200), path).collect()
    assert len(out) == len(texts)
    for r in out:
        assert list(r["ids"]) == lib.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(empty, path, n_head=10).count() == 0


def test_words_of_any_length_are_merged_like_the_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens={})
    rng = random.Random(6)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 9, 30, 300])))
             for alphabet in ("ab", "abcdefgh", "éàü", "日本語", " ", "!-", "0123") for _ in range(25)]
    for word in words:
        for merge in (byte_bpe.merge_word, byte_bpe.merge_long):
            assert merge(word.encode(), ranks) == lib._encode_single_piece(word.encode()), word
    long = "".join(rng.choice("abcde") for _ in range(100_000))
    texts = [long, long[:1000] + " " + long[1000:2000], "a" * 50_000, "\u2028\x1c\x85 x\n\n  y"]
    docs = spark.createDataFrame([(i, t, i, "r") for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids int, read string")
    got = byte_bpe.decode(byte_bpe.encode(docs, path, n_head=5), path)
    assert got.columns == ["doc_id", "text", "read", "ids", "decoded"]
    for r in got.collect():
        assert bytes(r["decoded"]).decode() == r["text"] == lib.decode(list(r["ids"]))
        if r["doc_id"] != 0:  # the library takes the square of the length for one word
            assert list(r["ids"]) == lib.encode_ordinary(r["text"])


def test_words_beyond_the_memo_are_folded_by_spark(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    memo = {"a": [1], " b": [2, 3]}
    assert byte_bpe.known_runs(["a", "qzxv", " b", " b", "qzxv", "wwq"], memo, ranks) == (
        [[1], [2, 3, 2, 3], [], []], [0, 0, 1], ["qzxv", "wwq"])
    assert byte_bpe.known_runs([], memo, ranks) == ([[]], [], [])
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens={})
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeé日") for _ in range(rng.choice([2, 9, 30, 80, 120])))
                      for _ in range(k)) for k in (0, 1, 1, 40, 300)] + [None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    encoded = byte_bpe.encode(docs, path, n_head=1)
    assert "aggregate" in encoded._jdf.queryExecution().optimizedPlan().toString()
    for r in encoded.collect():
        assert list(r["ids"]) == lib.encode_ordinary(r["text"] or "")


def test_higher_order_fold_equals_the_merges(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    by_bytes = {p.encode("latin-1"): r for p, r in ranks.items()}
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéß日 ") for _ in range(rng.randint(1, 25))) for _ in range(300)]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    folded = byte_bpe.with_scalar(
        frame, byte_bpe.stored_literals(spark, ranks), "ids",
        lambda held: byte_bpe.fold_merges(byte_bpe.as_bytes(F.col("w")), held["ranks"], len(ranks)))
    for r in folded.collect():
        assert list(r["ids"]) == byte_bpe.merge_word(r["w"].encode(), by_bytes)


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_equal_brute_force(docs, empty, texts, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(repeats, "STRETCH", 3000)
    raw = [(i, (t or "").encode()) for i, t, *_ in texts]
    seen = collections.Counter(t[k:k + 200] for _, t in raw for k in range(len(t) - 199))
    want = []
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((str(i), len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    got = [(str(r["doc_id"]), *list(r)[1:]) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert repeats.remove_repeats(empty).count() == 0


def test_run_index_gives_the_longest_match_elsewhere():
    rng = random.Random(3)
    for _ in range(60):
        own = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 25)))
               for _ in range(rng.randint(1, 5))]
        index = repeats.RunIndex(own)
        found = index.matches()
        spots = [(i, p) for i, t in enumerate(own) for p in range(len(t))]

        def common(a, b):
            x, y = own[a[0]][a[1]:], own[b[0]][b[1]:]
            return next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
        for s in spots:
            best = max((common(s, t) for t in spots if t != s), default=0)
            assert found[index.starts[s[0]] + s[1]] == best
        assert len(index.run_heads) <= len(index.symbols)


def test_toxicity_learns_a_lexicon_and_scores(spark, empty):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        words = sentence(rng, 30).split(" ")
        if i % 8 == 0:
            for w in rng.sample(["grumpf", "zorkel", "idiot", "scum", "blarg"], 3):
                words.insert(rng.randrange(30), w)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0), "x") for i, _ in rows if i % 3],
                                   "doc_id long, toxic int, text string")
    voters, model = toxicity.learn(docs, labels, F.col("doc_id") % 5 != 0)
    assert {"grumpf", "zorkel", "blarg"} <= set(voters.words)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(
        docs, voters, model, ["doc_id"]).collect()}
    assert all((scored[i] >= 0.3) == (i % 8 == 0) for i, _ in rows)
    assert scored[900] < 0.3 and len(scored) == 602
    assert toxicity.drop_toxic(docs, voters, model, 0.3).count() == 602 - 75
    nothing, none = toxicity.learn(empty, labels, F.lit(True))
    assert toxicity.score(empty, nothing, none, ["doc_id"]).count() == 0


def test_toxicity_is_fitted_on_every_pattern(spark, monkeypatch):
    """A fit that reads the most frequent patterns alone never sees the toxic ones."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", 2, raising=False)
    monkeypatch.setattr(toxicity, "TASK_PATTERNS", 50, raising=False)
    rng = random.Random(11)
    bad = ["grumpf", "zorkel", "blarg", "snarv", "quibz", "vlont", "drask", "plimf"]
    rows = [(i, sentence(rng, 20)) for i in range(500)]
    rows += [(500 + i, sentence(rng, 10) + " " + " ".join(rng.sample(bad, 3 + i % 4)))
             for i in range(120)]
    rows += [(700 + i, sentence(rng, 10) + " " + rng.choice(bad)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(500 <= i < 620)) for i, _ in rows],
                                   "doc_id long, toxic int")
    voters, model = toxicity.learn(docs, labels, F.lit(True))
    assert set(bad) <= set(voters.words)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(
        docs, voters, model, ["doc_id"]).collect()}
    assert all((scored[i] >= 0.3) == (500 <= i < 620) for i in scored)

    # the same as a fit of all patterns on one machine
    kinds = collections.Counter(
        (tuple(f), tuple(v)) for f, v in (voters.hits(t) for _, t in rows))
    assert len(kinds) > 50
    x = np.array([voters.vector(list(f), list(v)) for f, v in kinds])
    by_votes = collections.Counter()
    for (_, v), n in kinds.items():
        by_votes[v] += n
    labeller = toxicity.LabelModel(np.array(list(by_votes), np.int8),
                                   np.array(list(by_votes.values()), float))
    target = labeller.posterior(np.array([v for _, v in kinds], np.int8))
    share = np.sqrt(np.array(list(kinds.values()), float))
    share /= share.sum()
    near = toxicity.linear.fit(
        x, lambda m: share * (toxicity.linear.sigmoid(m) - target), rounds=4000)
    assert np.abs(near.scores(x) - model.scores(x)).max() < 0.02


def test_every_word_is_tested_and_every_attack_is_read(spark):
    """Common words that mark nothing do not crowd out rarer ones that do; long words count."""
    long = "z" * 5000
    rows = [(i, f"plain {'stuvwxyz'[i % 8]} text") for i in range(300)]
    rows += [(300 + i, f"plain often{'abc'[i % 3]} " + (f"rare {long}" if i % 2 else "rare"))
             for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i, _ in rows], "doc_id long, toxic int")
    words = toxicity.lexicon(docs, labels, F.lit(True), "doc_id", "text", "toxic")
    assert words[0] == "rare" and {"oftena", "oftenb", "oftenc"} <= set(words)
    assert len(words) == 5 and max(map(len, words)) == 33
    voters = toxicity.Voters(words)
    assert len(voters.hits(f"{long} rare")[0]) == 2 and not voters.hits(long[1:])[0]
    attack = toxicity.SHARDS + 4
    said = {"You are kind. You are an idiot.": 1, "They are rare": 1, "You are kind": 0,
            f"he is {long}": 1, "": 0, None: 0, "idiot": 0}
    assert {t: voters.hits(t)[1][attack] for t in said} == said


def test_evidence_equals_the_formula(spark):
    table = [(3, 0), (5, 2), (40, 100), (7, 1)]
    n_a, n_b = 40.0, 100.0
    got = spark.createDataFrame(table, "a int, b int").select(
        toxicity.evidence(F.col("a"), F.col("b"), n_a, n_b).alias("s")).collect()

    def part(k, n, p):
        return (k * np.log(p) if k else 0) + ((n - k) * np.log(1 - p) if n > k else 0)
    for (a, b), r in zip(table, got):
        p = (a + b) / (n_a + n_b)
        want = 0 if p == 1 else 2 * (part(a, n_a, a / n_a) + part(b, n_b, b / n_b)
                                     - part(a, n_a, p) - part(b, n_b, p))
        assert abs(r["s"] - want) < 1e-6


def test_stages_that_drop_rows_keep_clashing_columns_and_break_ties_by_value(spark):
    text = "one two three four five six seven eight nine ten eleven"
    schema = "_digest string, doc_id long, text string, _n int, _hit map<string,int>, c0 string"
    rows = [("mine", 1, text, n, {"k": n}, "x") for n in (3, 1, 2)]
    rows += [("other", 2, text + " twelve", 9, None, None), ("none", 3, None, 5, {}, ""),
             ("else", 4, "nothing of the kind", 6, {"a": 0}, "y")]
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, schema).repartition(parts)
        kept = near_dup.keep_one(frame)
        assert kept.columns == frame.columns
        assert sorted((r["_digest"], r["doc_id"], r["_n"], r["c0"]) for r in kept.collect()) == [
            ("else", 4, 6, "y"), ("mine", 1, 1, "x"), ("none", 3, 5, "")]
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    clean = decontamination.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns and clean.schema == frame.schema
    assert sorted((r["_digest"], r["_n"], r["_hit"]) for r in clean.collect()) == [
        ("else", 6, {"a": 0}), ("none", 5, {})]


def test_near_duplicates_report_nothing_that_depends_on_the_pairs_tried(spark):
    """Every text of a cloud is linked to all others; a count of the tried links would differ."""
    base = sentence(random.Random(12), 160).split(" ")
    rows = [(n, " ".join([*base[:2 * n], f"w{n}", *base[2 * n + 1:]])) for n in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    h, o = near_dup.shingle_hashes(pa.array([t for _, t in rows]))
    assert all(near_dup.similarity(h[o == a], h[o == b]) >= near_dup.THRESHOLD
               for a in range(12) for b in range(a))
    found = near_dup.near_duplicates(frame)
    assert found.distinct().count() == 12 and found.drop("doc_id").distinct().count() == 1
