"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Texts are normalised to words (ASCII letters in lower case, digits, non-ASCII characters)
joined by single blanks.  Every window of ten words of an item - or the whole item, if
shorter - is a pattern ``" w1 ... w10 "``; the automaton finds all of them, overlaps
included, in one scan of a document, and word positions map hits back to the original.

Benchmark texts of up to ``PART_BYTES`` make one automaton that is broadcast; a larger
benchmark is dealt into parts of that size, each scanned in turn, with the same result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from sunledger.llm.common import LOWER, WORD, slices

WINDOW = 10
PART_BYTES = 32 << 20

_FLAT = bytes(int(LOWER[i]) if WORD[i] else 32 for i in range(256))
_BUILT: dict[str, ahocorasick.Automaton] = {}


def normalised(text: str | None) -> str:
    """Blank-framed words as one Latin-1 reading of their UTF-8 bytes; empty if no words."""
    words = (text or "").encode().translate(_FLAT).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[str, list[str]]:
    """Pattern -> ids of the items that contain it."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        words = normalised(text).split(" ")[1:-1]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(f" {' '.join(words[i:i + window])} ", set()).add(item)
    return {k: sorted(v) for k, v in found.items()}


def automaton(found: dict[str, list[str]]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for pattern, ids in found.items():
        built.add_word(pattern, (len(pattern), ids))
    if found:
        built.make_automaton()
    return built


def _shared(name: str, sent: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a broadcast, built once in every worker process."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = automaton(sent.value)
    return _BUILT[name]


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, which words are hit, and the items found."""
    flat = normalised(text)
    n_words = max(0, flat.count(" ") - 1)
    ids: set[str] = set()
    spans = []
    if n_words and len(machine):
        for end, (length, items) in machine.iter(flat):
            spans.append((end - length + 1, end))
            ids.update(items)
    if not spans:
        return n_words, np.zeros(0, bool), ids
    blanks = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
    edges = np.searchsorted(blanks, np.array(spans))
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, edges[:, 0], 1)
    np.add.at(steps, edges[:, 1], -1)
    return n_words, np.cumsum(steps)[:n_words] > 0, ids


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code-point span of every word in the original text."""
    spans, start = [], None
    for i, ch in enumerate(text):
        if ord(ch) > 127 or ch.isalnum():
            start = i if start is None else start
        elif start is not None:
            spans.append((start, i))
            start = None
    return spans if start is None else [*spans, (start, len(text))]


def original_spans(text: str | None, hit: np.ndarray) -> list[dict]:
    """Code-point spans of the maximal runs of hit words in the original text."""
    if not hit.any():
        return []
    where = word_spans(text)
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [{"start": where[a][0], "end": where[b - 1][1]}
            for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]


def benchmark_parts(benchmark: DataFrame, item_id: str, text: str,
                    part_bytes: int) -> Iterator[dict[str, list[str]]]:
    """Patterns of the benchmark in parts of at most ``part_bytes`` (or one item)."""
    sized = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"),
                             F.col(text).cast("string").alias("t"))
    total = sized.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n_parts = -(-total // part_bytes) or 1
    for part in range(n_parts):
        rows = sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_parts)) == part).collect()
        yield patterns([(r["i"], r["t"]) for r in rows])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text",
                       part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents with ``_n_words``, ``_hit`` (numbers of the words hit) and ``_items``.

    All rows and columns are kept, but a caller's columns of these three names are replaced;
    ``drop_contaminated`` keeps those too.  A NULL or empty text has no words; repeated rows are
    scanned alike; items without words match nothing, a NULL item id counts as ''.  Words
    inside several windows count once; an item counts once however often it occurs.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.drop("_n_words", "_hit", "_items")
    added = "_n_words long, _hit array<int>, _items array<string>"
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    frame, first = docs, True
    for found in benchmark_parts(benchmark, item_id, item_text, part_bytes):
        sent = sc.broadcast(found)
        frame = frame.mapInArrow(_scanner(sent, text, first), ", ".join([*kept, added]))
        first = False
    return frame


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                      **options) -> DataFrame:
    """The documents without any word hit; columns keep their names and values."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    found = find_contamination(docs.toDF(*own), benchmark, own[docs.columns.index(text)],
                               **options)
    return found.where(F.size("_hit") == 0).select(own).toDF(*docs.columns)


def _scanner(sent: Broadcast, text: str, first: bool):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _shared(name, sent)
        for batch in batches:
            for piece in slices(batch, text, 8 << 20):
                n_words, hits, items = [], [], []
                before = None if first else piece.select(["_hit", "_items"]).to_pylist()
                for i, body in enumerate(piece[text].to_pylist()):
                    n, hit, ids = scan(body, machine)
                    where = np.flatnonzero(hit)
                    if before:
                        where = np.union1d(where, np.array(before[i]["_hit"], dtype=np.int64))
                        ids = ids | set(before[i]["_items"])
                    n_words.append(n)
                    hits.append(where)
                    items.append(sorted(ids))
                columns = [c for name, c in zip(piece.schema.names, piece.columns)
                           if name not in ("_n_words", "_hit", "_items")]
                names = [n for n in piece.schema.names if n not in ("_n_words", "_hit", "_items")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                     pa.array(items, pa.list_(pa.string()))],
                    names=[*names, "_n_words", "_hit", "_items"])
    return run


def contamination_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows with hits, with ``spans``: the hit passages as code-point spans of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for body, where in zip(batch[text].to_pylist(), batch["_hit"].to_pylist()):
                hit = np.zeros(where[-1] + 1, bool)
                hit[where] = True
                spans.append(original_spans(body, hit))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield batch.append_column("spans", pa.array(spans, kind))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields]
                       + ["spans array<struct<start:int,end:int>>"])
    return found.where(F.size("_hit") > 0).mapInArrow(run, schema)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
