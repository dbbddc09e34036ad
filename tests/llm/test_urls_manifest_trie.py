"""URL filters, the Merkle manifest and the conversation trie against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunledger.llm import conversation_trie, merkle, ordering, url_filters


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- positions --------------------------------------------------------------------------------

def test_positions_are_gapless_in_groups_of_any_size_and_of_equal_rows(spark):
    rows = [("big", 5, i % 3) for i in range(500)] + [(None, None, 0)] * 7 + [("x", 2, 1)]
    frame = spark.createDataFrame(rows, "g string, v int, _rows int").repartition(5)
    got = collections.defaultdict(list)
    for r in ordering.ranked(frame, ["g"], ["v"], "pos").collect():
        got[r["g"]].append(r["pos"])
    assert {k: sorted(v) for k, v in got.items()} == {
        "big": list(range(500)), None: list(range(7)), "x": [0]}
    assert ordering.ranked(frame.where("false"), ["g"], ["v"]).count() == 0


# --- URL filters ------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme casino", "http://", "://x", "HTTP://WWW.Casino.ORG", "http://casinos.net/",
    "http://a.example.org/es/1", "http://example.org/es/casino", "http://notexample.org/es/1",
    "http://org", "http://org/", "http://b.org:80/", "http://x.net?casino", "http://x.net#free-win",
    "http://x.net/free/free", "http://cheap-pills.net/", "http://x.net/sexy", "http://x.net/ésex",
    "http://x.net/sex_sex", "http://x.net/" + "free/" * 30_000, "a://b://c/d?e://f", "http://x.com/de/",
    "http://x.com/DE/", "http://spam.example.org/en/1", "http://spam.com/fr/", "http://x.com/fr",
]


def url_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    lowered = "".join(c.lower() if c.isascii() else c for c in raw)
    return lowered, re.match(r"[^?#]*", rest[len(raw):])[0]


def judged(url):
    host, path = url_parts(url)
    fits = [r for r in url_filters.URL_RULES
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    low = "".join(c.lower() if c.isascii() else c for c in url or "")
    found = {t: len(re.findall(rf"(?<![^\W_]){t}(?![^\W_])", low))
             for t in (*url_filters.STRICT, *url_filters.SOFT)}
    found = {t: n for t, n in found.items() if n}
    strict = [t for t in found if t in url_filters.STRICT]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    verdict = rule.verdict if rule else (
        "block" if strict or len(found) >= 2 else "allow")
    return (host, path, rule and rule.text, verdict, sum(found[t] for t in strict),
            sum(n for t, n in found.items() if t not in strict), sorted(found))


def test_urls_are_judged_as_by_patterns(spark):
    rows = [(i, u, "k", "h") for i, u in enumerate(URLS)] + [(None, URLS[5], None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, weight string, host string")
    got = url_filters.judge(pages, "url", ["page_id", "url", "host"], rules=url_filters.URL_RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "n_strict",
                           "n_soft", "weight", "terms"]
    seen = got.collect()
    assert len(seen) == len(rows)
    for r in seen:
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["n_strict"], r["n_soft"],
                r["terms"]) == judged(r["url"]), r["url"]
    assert url_filters.judge(pages.where("false"), "url", ["page_id"]).count() == 0


def test_own_vocabulary_weighs_distinct_terms(spark):
    words = url_filters.Vocabulary(["bad"], {"so": 1.5, "la": 0.5, "ti": 0.4, "bad": 0.1, "": 9},
                                   limit=2)
    pages = spark.createDataFrame([(i, f"http://h/{u}") for i, u in enumerate(
        ["so/la", "so/so", "la.ti", "bad", "badly", "so.ti"])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in
           url_filters.judge(pages, "url", ["page_id"], words).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


# --- the manifest -----------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, idx int, path string, digest string"


def brute_manifest(rows, fanout):
    """``(id, leaf, subroot, root, siblings)`` of rows ``(id, leaf, group)``, level by level."""
    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
            for leaf, node in enumerate(at):
                run, own = divmod(node, fanout)
                paths[leaf] += [d for k, d in enumerate(runs[run]) if k != own]
                at[leaf] = run
            nodes = [sha("".join(run)) for run in runs]
        return nodes[0], paths
    groups = collections.defaultdict(list)
    for key, leaf, group in rows:
        groups[group].append((key is not None, key or 0, leaf, key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: climb([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    root, above = climb([built[g][0] for g in names])
    out = []
    for g, up in zip(names, above):
        subroot, paths = built[g]
        out += [(r[3], r[2], subroot, root, sha("".join(p + up)))
                for r, p in zip(sorted(groups[g], key=lambda r: r[:3]), paths)]
    return out


@pytest.mark.parametrize("fanout, sizes", [
    (2, {"en": 37, "de": 1, None: 5, "": 16, "é": 17, "zz": 2}), (3, {"a": 28, "b": 9}), (2, {"a": 1}),
    (20, {"a": 41})])
def test_manifest_equals_brute_force(spark, fanout, sizes):
    rng = random.Random(fanout)
    rows = [(rng.randrange(10_000), rng.choice(["t", "", None, "ü" * 50_000]) if i % 9 == 0
             else f"text {i}", g, 1, "p", "d") for g, n in sizes.items() for i in range(n)]
    rows[-1] = (None, *rows[-1][1:])
    if len(rows) > 9:
        rows[5], rows[7] = rows[4], (rows[6][0], "other", *rows[6][2:])
    docs = spark.createDataFrame(rows, DOCS).repartition(3)

    def leaf(text):
        return merkle.digest(merkle.field(F.col("doc_id")), merkle.field(text))
    changed = F.when(F.col("doc_id") % 3 == 0, leaf(F.concat(F.col("text"), F.lit("!"))))
    got = merkle.check_proofs(merkle.manifest(
        docs, "doc_id", "lang", leaf(F.col("text")), fanout, changed)).collect()

    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = brute_manifest([(r[0], sha(value(r[0]) + value(r[1])), r[2]) for r in rows], fanout)
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted([(r["key"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"])
                   for r in got], key=order) == sorted(want, key=order)
    for r in got:
        same = r["changed"] is None or r["changed"] == r["leaf"]
        assert r["verified"] == same and (r["folded_root"] == r["root"]) == same


def test_manifest_of_nothing_is_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    rows = merkle.check_proofs(merkle.manifest(empty, "doc_id", "lang", F.sha2("text", 256)))
    assert rows.count() == 0 and "proof_sha256" in rows.columns
    with pytest.raises(ValueError, match="fanout"):
        merkle.grow(empty, "lang", 1, fanout=1)


# --- the trie ---------------------------------------------------------------------------------

def test_slot_table_is_minimal_perfect_and_refuses_foreign_keys():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    keys[:1000, 0], keys[1000:2000, 1] = 7, 9  # lanes that agree
    a, b = conversation_trie.distinct_keys(np.r_[keys[:, 0], keys[:50, 0]],
                                           np.r_[keys[:, 1], keys[:50, 1]])
    table = conversation_trie.SlotTable(a, b)
    slots = table.find(a, b)
    assert sorted(slots) == list(range(len(a))) == list(range(len(table)))
    assert (table.find(a, b + np.uint64(1)) == -1).all() and (table.find(b, a) == -1).all()
    assert len(conversation_trie.SlotTable(a[:0], b[:0]).find(a, b)) == len(a)
    with pytest.raises(ValueError, match="distinct"):
        conversation_trie.SlotTable(np.r_[a[:1], a[:1]], np.r_[b[:1], b[:1]])


def brute_trie(rows, h):
    """Rows of the contract's query over ``(conv_id, turn, role, text)``."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = sha(f"{len(role.encode())}:{role}{text}")
            own[c].append(((turn is not None, turn or 0, role, key), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {c: tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h(c)] + turns[c][h(c):]) for c in turns}
    nodes = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), -99 if not p else min(nodes[p[:-1]]), len(m), children[p], leaves[p],
                   saved[p], sha(",".join(map(str, sorted(c for c in m if built[c] == p)))))
                  for p, m in nodes.items())


def crc_h(c):
    return zlib.crc32(str(c).encode()) % 9


def trie(spark, rows, **options):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({"key": F.lit(1), "depth": F.lit("x")}).repartition(3)
    conv = F.col("conv")
    convs, turns = conversation_trie.rebuilt(
        frame, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8)
    found = conversation_trie.prefix_trie(convs, turns, **options).collect()
    return sorted(tuple(-99 if v is None and k == "parent_conv_id" else v
                        for k, v in r.asDict().items()) for r in found)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(-12, 60), 103, 104, 10**12 + 1]:
        if c in (20, 30):
            continue  # families without the conversation they are named after
        n = rng.choice([1, 2, 3, 9, 40 if c % 10 == 0 else 5])
        rows += [(c, t, rng.choice(["user", "assistant"]), f"hi {rng.randrange(2)}" if t < 3
                  else rng.choice(["", None, "é" * 30, f"t{rng.randrange(3)}"])) for t in range(n)]
    rows += [(7, None, None, None), (7, None, None, None), (7, 3, "user", "tie"), (None, 0, "u", "x"),
             (200, 0, "user", "y" * 200_000), (201, None, None, "only")]
    # one conversation with a third of the rows, all of them equal
    return rows + [(55, None, "user", "again")] * 250


@pytest.mark.parametrize("options", [{}, {"segment": 4, "shard_rows": 30},
                                     {"segment": 1, "shard_rows": 100}])
def test_trie_equals_brute_force(spark, conversations, options):
    assert trie(spark, conversations, **options) == brute_trie(conversations, crc_h)


def test_trie_of_nothing_and_of_one(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []
    one = [(3, 0, "user", "a")]
    assert trie(spark, one) == brute_trie(one, crc_h)


def test_ids_of_a_node_are_hashed_piece_by_piece(spark, monkeypatch):
    rows = [(1, 2, i) for i in range(-500, 3000)] + [(1, 3, 5), (-4, 2, 9), (-4, 2, 10)]
    monkeypatch.setattr(conversation_trie, "PIECE", 64)
    frame = spark.createDataFrame(rows, "a long, b long, conv long").repartition(7)
    got = {(r["a"], r["b"]): r["ends_sha256"] for r in conversation_trie.hash_ids(frame).collect()}
    assert got == {(1, 2): sha(",".join(map(str, range(-500, 3000)))), (1, 3): sha("5"),
                   (-4, 2): sha("9,10")}
