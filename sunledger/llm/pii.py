"""Personal data: base rules, and a semi-Markov conditional random field over spans.

The random field scores whole candidate segments (at most ``MAX_TOKENS`` tokens that hold a
digit or an at-sign) by features of the entire span and its surroundings; dynamic
programming over segment ends chooses boundaries and types together.  It is trained by
conditional likelihood on a bounded sample of text regions, labelled by the base rules.  Its
spans are added to those of the rules where they do not overlap one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sunledger.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
#: fixed values: the base rules
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

MAX_TOKENS = 24
#: regions the field is trained on at most, and how far a decoded span must win
TRAIN_REGIONS, MARGIN = 1000, 2.0
REGION_CHARS = 160

_ANCHOR = re.compile(r"[0-9@]\S*")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield 0, start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the rules by start, then kind, in code points; failing matches are dropped."""
    spans = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            spans += [(1, m.start(), m.end()) for m in _IP.finditer(text)
                      if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                             for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
        if "+" in text:
            spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text)
                      if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs, merged where they are close."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 64 and not text[start - 1].isspace():
            start -= 1
        stop = m.end()
        while start < stop:  # very long words are cut into stretches
            end = min(stop, start + REGION_CHARS)
            if out and start - out[-1][1] <= 2 and end - out[-1][0] <= REGION_CHARS:
                out[-1][1] = max(out[-1][1], end)
            else:
                start = max(start, out[-1][1]) if out else start
                if start < end:
                    out.append([start, end])
            start = end
    return [(a, b) for a, b in out]


def _digit_bucket(n: int) -> int:
    return int(np.searchsorted([1, 4, 7, 10, 14, 16, 17, 20], n, side="right"))


N_FEATURES = 32


def span_features(text: str, start: int, end: int) -> np.ndarray:
    """Features of the whole span and the characters around it."""
    span, f = text[start:end], np.zeros(N_FEATURES)
    digits = "".join(c for c in span if "0" <= c <= "9")
    parts = span.split(".")
    before, after = text[start - 1:start], text[end:end + 1]
    head, _, tail = span.partition("@")
    f[0] = 1
    f[1] = bool(head) and span.count("@") == 1 and bool(re.fullmatch(r"[\w.%+-]+", head, re.A)) \
        and bool(_DOMAIN.fullmatch("@" + tail))
    f[2] = "@" in span
    f[3 + _digit_bucket(len(digits))] = 1
    f[12] = all(c in "0123456789 -" for c in span)
    f[13] = f[12] and 14 <= len(digits) <= 19 and luhn(digits)
    f[14] = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    f[15] = len(parts) == 4 and all(p.isdigit() for p in parts) and not f[14]
    f[16] = span[0] == "+"
    f[17] = span[0] == "+" and all(c in "0123456789 ().-" for c in span[1:])
    f[18] = f[17] and 10 <= len(digits) <= 15
    f[19] = before.isalnum()
    f[20] = after.isalnum()
    f[21] = before != "" and before in ".@+-_%"
    f[22] = after != "" and after in "@-_"
    f[23] = after == "." and text[end + 1:end + 2].isalnum()
    f[24] = any(c.isalpha() for c in span)
    f[25] = " " in span
    f[26] = not span[-1].isalnum()
    f[27] = before == " " and text[start - 2:start - 1].isdigit()
    f[28] = after == " " and text[end + 1:end + 2].isdigit()
    f[29] = "(" in span
    f[30] = len(span) > 24
    f[31] = any(c.isalpha() for c in span) and any(c.isupper() for c in span)
    return f


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Token edges of a region, and candidate segments as pairs of edge numbers."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    edges = [start, *[b for _, b in tokens]]
    out = []
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] == "+"):
            continue
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            if text[tokens[j][0]].isalnum() and j - i < MAX_TOKENS:
                span = text[a:tokens[j][1]]
                if "\n" in span:
                    break
                if "@" in span or sum("0" <= c <= "9" for c in span) >= 4:
                    out.append((i, j + 1))
    return edges, out


def _lse(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(np.sum(np.exp(np.array(values) - top))))


def _lattice(n: int, segs: list[tuple[int, int]], scores: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward sums over all segmentations; outside tokens score 0."""
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for s, (i, j) in enumerate(segs):
        ends.setdefault(j, []).append(s)
        starts.setdefault(i, []).append(s)
    fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        fwd[j] = _lse([fwd[j - 1], *[fwd[segs[s][0]] + v for s in ends.get(j, ())
                                     for v in scores[s]]])
    for i in range(n - 1, -1, -1):
        bwd[i] = _lse([bwd[i + 1], *[bwd[segs[s][1]] + v for s in starts.get(i, ())
                                     for v in scores[s]]])
    return fwd, bwd, float(fwd[n])


def train(texts: list[str], rounds: int = 30, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights per kind by gradient ascent (AdaGrad) on the conditional likelihood."""
    cases = []
    for text in texts:
        for a, b in regions(text):
            edges, segs = candidates(text, a, b)
            if not segs:
                continue
            where = {(edges[i], edges[j]): s for s, (i, j) in enumerate(segs)}
            gold, busy = {}, -1
            for kind, x, y in base_spans(text):
                if (x, y) in where and x >= busy:
                    gold[where[x, y]], busy = kind, y
            phi = np.array([span_features(text, edges[i], edges[j]) for i, j in segs])
            cases.append((len(edges) - 1, segs, phi, gold))
    w, seen = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-6)
    if not any(gold for *_, gold in cases):
        return w
    for _ in range(rounds):
        grad = -ridge * w * len(cases)
        for n, segs, phi, gold in cases:
            scores = phi @ w.T
            fwd, bwd, z = _lattice(n, segs, scores)
            i, j = np.array(segs).T
            expected = np.exp(np.minimum(0.0, fwd[i][:, None] + scores + bwd[j][:, None] - z))
            for s, kind in gold.items():
                expected[s, kind] -= 1
            grad -= expected.T @ phi
        seen += grad ** 2
        w += rate * grad / np.sqrt(seen)
    return w


def decode(text: str, w: np.ndarray, margin: float = MARGIN) -> list[Span]:
    """Best segmentation of every region; spans that win by more than ``margin``."""
    out: list[Span] = []
    for a, b in regions(text):
        edges, segs = candidates(text, a, b)
        if not segs:
            continue
        scores = np.array([span_features(text, edges[i], edges[j]) for i, j in segs]) @ w.T
        kinds, tops = scores.argmax(1), scores.max(1)
        n = len(edges) - 1
        best, back = [0.0] * (n + 1), [-1] * (n + 1)
        ends: dict[int, list[int]] = {}
        for s, (_, j) in enumerate(segs):
            ends.setdefault(j, []).append(s)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for s in ends.get(j, ()):
                value = best[segs[s][0]] + tops[s]
                if value > best[j]:
                    best[j], back[j] = value, s
        j = n
        while j > 0:
            if back[j] < 0:
                j -= 1
                continue
            s = back[j]
            if tops[s] > margin:
                out.append((int(kinds[s]), edges[segs[s][0]], edges[segs[s][1]]))
            j = segs[s][0]
    return out


def all_spans(text: str, w: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those the field adds, both in order."""
    base = base_spans(text)
    added = [s for s in (decode(text, w) if w.any() and _ANCHOR.search(text) else [])
             if all(s[2] <= x or s[1] >= y for _, x, y in base)]
    return base, sorted(base + added, key=lambda s: (s[1], s[0], s[2]))


def listing(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listing(spans).encode()).hexdigest()


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one."""
    if not spans or text is None:
        return text
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def fit(docs: DataFrame, text: str = "text", n_regions: int = TRAIN_REGIONS) -> np.ndarray:
    """Train on at most ``n_regions`` regions, chosen by hash over all documents.

    Without any base span in them the weights stay zero and nothing is added.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text", 8 << 20):
                found = [t[max(0, a - 40):b + 40] for t in piece["_text"].to_pylist()
                         for a, b in regions(t or "")]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["r"])
    sample = (docs.select(F.col(text).alias("_text")).where(F.col("_text").rlike("[0-9@]"))
              .mapInArrow(run, "r string")
              .orderBy(F.xxhash64("r"), "r").limit(n_regions))
    return train([r["r"] for r in sample.collect()])


def find_pii(docs: DataFrame, weights: np.ndarray, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Key, counts of base spans per kind, digest of the base spans, list of all spans.

    One row per row: NULL counts as the empty text, which has no spans; repeated rows and NULL
    keys are kept; other columns are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text", 8 << 20):
                found = [all_spans(t or "", weights) for t in piece["_text"].to_pylist()]
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64())
                          for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [piece[key], *counts, pa.array([digest(b) for b, _ in found], pa.string()),
                     pa.array([listing(s) for _, s in found], pa.string())],
                    names=[key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(docs[key], docs[text].alias("_text")).mapInArrow(
        run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {counts}, "
             "base_sha256 string, spans string")


def redact_documents(docs: DataFrame, weights: np.ndarray, text: str = "text",
                     length: str | None = "n_chars") -> DataFrame:
    """The documents with all spans replaced by their kind; all columns and rows stay.

    A column named ``length`` is set to the new number of code points; NULL texts stay NULL.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, 8 << 20):
                clean = [redact(t, all_spans(t or "", weights)[1])
                         for t in piece[text].to_pylist()]
                columns = [pa.array(clean, pa.string()) if n == text else c
                           for n, c in zip(piece.schema.names, piece.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names)
    out = docs.mapInArrow(run, docs.schema)
    if length and length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(
            F.char_length(text)).cast(kind))
    return out
