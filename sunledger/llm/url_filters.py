"""URL filters: a weighted vocabulary found by one Aho-Corasick automaton, and host rules.

A URL is scanned once.  A term counts where it stands between characters that are neither
letters nor digits.  A strict term weighs as much as the limit, a soft one less, and weights
count once per distinct term: one strict term or several distinct soft ones reject a URL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sunledger.llm.common import SLICE_BYTES, slices

#: weight at which a URL is rejected; a strict term alone reaches it
LIMIT = 2

#: fixed values: terms that reject alone
STRICT = (
    "adult", "camgirls", "casino", "erotic", "escort", "gambling", "hentai", "malware",
    "nsfw", "phishing", "pharma", "porn", "porno", "pornography", "sex", "spam", "viagra",
    "warez", "xxx")
#: fixed values: terms of which two different ones reject
SOFT = (
    "ads", "bet", "bets", "betting", "bonus", "cams", "cash", "cheap", "click", "coupon",
    "crack", "dating", "deal", "deals", "discount", "download", "farm", "free", "jackpot",
    "keygen", "loan", "loans", "lottery", "lucky", "nude", "payday", "pill", "pills", "poker",
    "promo", "replica", "rx", "slots", "torrent", "track", "tracker", "tracking", "win", "winner")


@dataclass(frozen=True)
class Vocabulary:
    """Terms (lower case) with their weights; a term of both kinds is strict."""

    strict: Sequence[str] = STRICT
    soft: Sequence[str] | Mapping[str, float] = SOFT
    limit: float = LIMIT
    weights: dict[str, float] = field(init=False)

    def __post_init__(self):
        soft = self.soft if isinstance(self.soft, Mapping) else dict.fromkeys(self.soft, 1)
        merged = {**soft, **dict.fromkeys(self.strict, self.limit)}
        object.__setattr__(self, "weights", {t: w for t, w in merged.items() if t})

    def automaton(self) -> ahocorasick.Automaton:
        built = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            built.add_word(term, (term, weight))
        built.make_automaton()
        return built


@dataclass(frozen=True)
class Rule:
    """Allow or block a host, with its subdomains, below a path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        named = (host == F.lit(self.host)) | F.endswith(host, F.lit(f".{self.host}"))
        return named & F.startswith(path, F.lit(self.path))


#: fixed values: the rules of the registered query
URL_RULES = (
    Rule("allow", "org"), Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both are empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lower_ascii(host), F.regexp_extract(after, r"^[^?#]*", 0)


def count_terms(text: str | None, machine: ahocorasick.Automaton,
                limit: float) -> tuple[int, int, float, list[str]]:
    """Strict and soft occurrences, weight of the distinct terms, and the terms sorted."""
    strict = soft = 0
    found: dict[str, float] = {}
    if text and len(machine):
        for end, (term, weight) in machine.iter(text):
            start = end - len(term) + 1
            if (start and text[start - 1].isalnum()) or text[end + 1:end + 2].isalnum():
                continue
            found[term] = weight
            if weight >= limit:
                strict += 1
            else:
                soft += 1
    return strict, soft, float(sum(found.values())), sorted(found)


def judge(pages: DataFrame, url: str, keep: Sequence[str], vocabulary: Vocabulary | None = None,
          rules: Sequence[Rule] = ()) -> DataFrame:
    """``keep`` columns with host, path, rule, verdict, and what the vocabulary found.

    The longest fitting rule decides (of equally long ones a blocking one, then the first by
    its text); without a rule a URL is blocked if its distinct terms reach the limit.  Terms
    are looked for in the whole URL, A-Z in lower case.  NULL and empty URLs have no host, no
    path and no terms and are allowed.  Repeated rows stay; kept columns may be named like the
    results, which then replace them.  Rules stand in the plan: keep them to some thousands.
    """
    words = vocabulary or Vocabulary()
    names = ["host", "path", "rule", "verdict", "n_strict", "n_soft", "weight", "terms"]
    kept = [c for c in keep if c not in names]
    host, path = host_and_path(F.col(url))
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    fitting = [F.when(r.fits(F.col("host"), F.col("path")), F.struct(
        F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    # the scan reads one column of its own, so that no kept column is mistaken for it
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)],
                        lower_ascii(F.col(url)).alias("url"), host.alias("host"),
                        path.alias("path"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "url"]
    schema = ", ".join([*fields, "n_strict long", "n_soft long", "weight double",
                        "terms array<string>"])
    limit = words.limit

    def scan(batches):
        machine = words.automaton()
        for batch in batches:
            for piece in slices(batch, "url", SLICE_BYTES):
                found = [count_terms(u, machine, limit) for u in piece["url"].to_pylist()]
                columns = [piece[c] for c in piece.schema.names if c != "url"]
                n_strict, n_soft, weight, terms = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_strict, pa.int64()), pa.array(n_soft, pa.int64()),
                     pa.array(weight, pa.float64()), pa.array(terms, pa.list_(pa.string()))],
                    [*[c for c in piece.schema.names if c != "url"], *names[4:]])

    counted = rows.mapInArrow(scan, schema)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    by_terms = F.when(F.col("weight") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return (counted.withColumn("_rule", F.coalesce(*fitting, none))
            .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "host", "path",
                    F.col("_rule.rule").alias("rule"),
                    F.coalesce("_rule.verdict", by_terms).alias("verdict"), *names[4:]))
