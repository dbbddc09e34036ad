"""Removal of long byte strings that occur more than once, by a run-length text index.

Every 200-byte window is dealt by its anchor, the 32-byte string of smallest hash in it, so
equal windows meet.  Neighbouring windows with one anchor form a segment.  Segments with an
anchor that occurs once are unique, and equal segments of one anchor are repeats as they
stand.  What is left - different segments around a repeated anchor, a highly repetitive
collection - is indexed: a run-compressed Burrows-Wheeler transform with the suffix and its
common prefix sampled at the run ends.  Matching statistics stream from the samples: between
two samples the match of a position is that of the position before it, less one.  Windows
whose match elsewhere is long enough are marked.

Only anchors, digests and positions are shuffled for all texts; text travels once for the
documents with a repeated anchor.  Anchors with very many different segments are dealt
further, by the digest of each window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sunledger.llm.common import mix, slices, string_bytes
from sunledger.session import settle

WINDOW, ANCHOR = 200, 32
#: bytes of segments in one index, and different segments of an anchor that share an index
INDEX_BYTES, HOT_SEGMENTS = 1 << 20, 4096
STRETCH = 1 << 20
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x5851F42D4C957F2D)


def anchor_hashes(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """Hash of the ``size`` bytes from every position (size is a power of two)."""
    with np.errstate(over="ignore"):
        h, step, width = _BYTE[data], _STEP, 1
        while width < size:
            h = h[:len(h) - width] * step + h[width:]
            step, width = np.uint64(int(step) * int(step) & (2 ** 64 - 1)), width * 2
        return mix(h)


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of every segment of one text.

    Ties and the bits that rank anchors depend on the window alone, so equal windows choose
    the same anchor in any text.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_windows = len(data) - WINDOW + 1
    for begin in range(0, max(0, n_windows), STRETCH):
        stop = min(n_windows, begin + STRETCH)
        h = anchor_hashes(data[begin:stop + WINDOW - 1])
        # always the same number of hash bits, whatever the length of the stretch
        ranked = (h >> np.uint64(24)) << np.uint64(24)
        m = _window_argmin(ranked, WINDOW - ANCHOR + 1)
        new = np.flatnonzero(np.diff(m)) + 1
        first = np.concatenate(([0], new))
        last = np.concatenate((new, [len(m)])) - 1
        found.append((h[m[first]], first + begin, last + begin))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _window_argmin(ranked: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in every window; the first of equal ones."""
    low = ranked | np.arange(len(ranked), dtype=np.uint64)  # positions fit in 24 bits
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    return (low & np.uint64(0xFFFFFF)).astype(np.int64)


class RunIndex:
    """Run-length Burrows-Wheeler index of a collection of byte strings.

    Every string ends in a terminator of its own, smaller than all bytes and ordered by the
    number of the string.
    """

    def __init__(self, texts: list[bytes]) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.lengths = lengths
        symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        terminators = self.starts + lengths
        symbols[terminators] = 0
        self.symbols, n = symbols, len(symbols)
        order, _ = self._suffixes()
        before = symbols[order - 1]
        # the symbol before a string's first byte is its own terminator: a run of its own
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.run_heads = np.flatnonzero(head)
        self.run_symbols = before[self.run_heads]
        # samples: suffix at each run head and at the row above it, with their common prefix
        self.sample_at = order[self.run_heads]
        above = np.where(self.run_heads > 0, order[self.run_heads - 1], -1)
        self.sample_match = self._common(self.sample_at, above)
        # and for the row below each run end
        ends = np.append(self.run_heads[1:], n) - 1
        self.end_at = order[ends]
        below = np.where(ends + 1 < n, order[np.minimum(ends + 1, n - 1)], -1)
        self.end_match = self._common(self.end_at, below)

    def _suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by prefix doubling; a terminator makes a suffix unique."""
        n = len(self.symbols)
        # seven symbols of nine bits make the first key; nothing after a terminator counts
        key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(7):
            symbol = np.zeros(n, np.int64)
            symbol[:max(0, n - k)] = self.symbols[k:]
            key = (key << 9) | np.where(open_, symbol, 0)
            open_ &= symbol != 0
        order = np.lexsort((np.arange(n), key))
        # suffixes that reach their terminator are told apart by the number of the string
        new = ~open_[order]
        new[0] = True
        new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        top, width = int(rank.max()) + 1, 7
        while top < n:
            behind = np.zeros(n, np.int64)
            behind[:max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 1) + behind
            order = np.argsort(key)
            new[1:] = key[order][1:] != key[order][:-1]
            rank[order] = np.cumsum(new) - 1
            top, width = int(rank.max()) + 1, width * 2
            new[0] = True
        return order, rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of pairs of suffixes, up to the end of their strings."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        x, y, n = a[live], b[live], len(self.symbols)
        while len(live):
            inside = (x < n) & (y < n)
            same = np.zeros(len(live), bool)
            same[inside] = (self.symbols[x[inside]] == self.symbols[y[inside]]) \
                & (self.symbols[x[inside]] != 0)
            live, x, y = live[same], x[same] + 1, y[same] + 1
            out[live] += 1
        return out

    def matches(self) -> np.ndarray:
        """Length of the longest match elsewhere of every position (matching statistics)."""
        longest = np.zeros(len(self.symbols), np.int64)
        for at, match in ((self.sample_at, self.sample_match), (self.end_at, self.end_match)):
            order = np.argsort(at)
            at, match = at[order], match[order]
            here = np.arange(len(self.symbols))
            s = np.searchsorted(at, here, side="right") - 1
            value = np.where(s >= 0, match[s] - (here - at[s]), 0)
            longest = np.maximum(longest, value)
        return longest

    def repeated(self, window: int = WINDOW) -> list[np.ndarray]:
        """For every string, which window starts match elsewhere over the whole window."""
        long = self.matches() >= window
        return [long[s:s + max(0, n - window + 1)] for s, n in zip(self.starts, self.lengths)]


def _profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, digest, size, digest of the bytes and segments of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text", 4 << 20):
                data, offsets = string_bytes(piece["_text"])
                anchors, marks, starts, ends, whole = [], [], [], [], []
                for r in range(piece.num_rows):
                    own = data[offsets[r]:offsets[r + 1]]
                    h, a, b = segments(own)
                    raw = own.tobytes()
                    anchors.append(h.view(np.int64))
                    starts.append(a)
                    ends.append(b)
                    marks.append([xxhash.xxh3_64_intdigest(raw[x:y]) - (1 << 63)
                                  for x, y in zip(a.tolist(), (b + WINDOW).tolist())])
                    whole.append(hashlib.sha256(raw).hexdigest())
                longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [piece["_key"], piece["_digest"], pa.array(np.diff(offsets), pa.int64()),
                     pa.array(whole, pa.string()), pa.array(anchors, longs),
                     pa.array(marks, longs), pa.array(starts, ints), pa.array(ends, ints)],
                    names=["key", "digest", "n_bytes", "sha256", "anchor", "mark", "a", "b"])
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("_key"), F.unhex(F.md5(body.cast("binary"))).alias("_digest"),
                       body.alias("_text")).mapInArrow(
        run, f"key {docs.schema[key].dataType.simpleString()}, digest binary, n_bytes long, "
             "sha256 string, anchor array<long>, mark array<long>, a array<int>, b array<int>")


def _cut_segments(texts: DataFrame) -> DataFrame:
    """The bytes of the segments listed in ``want``: anchor, digest, start, bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                out: list[list] = [[], [], [], []]
                for text, digest, want in zip(piece["text"].to_pylist(), piece["digest"].to_pylist(),
                                              piece["want"].to_pylist()):
                    raw = text.encode()
                    for w in want:
                        for column, value in zip(out, (w["anchor"], digest, w["a"],
                                                       raw[w["a"]:w["b"] + WINDOW])):
                            column.append(value)
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                                 names=["anchor", "digest", "a", "body"])
    return texts.select("text", "digest", "want").mapInArrow(
        run, "anchor long, digest binary, a int, body binary")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))


def _index(found: DataFrame) -> DataFrame:
    """Repeated window starts (``lo`` to ``hi``, inclusive) of the segments, anchor by anchor."""
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        flags = RunIndex([r[3] for r in rows]).repeated() if rows else []
        out = [(r[1], r[2] + x, r[2] + y - 1) for r, f in zip(rows, flags) for x, y in _runs(f)]
        return pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], k) for i, k in
             enumerate((pa.binary(), pa.int32(), pa.int32()))], names=["digest", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("anchor", "digest", "a", "body")]):
                if size > INDEX_BYTES and row[0] != last:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[0]
        yield flush(rows)
    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        run, "digest binary, lo int, hi int")


def _by_window(found: DataFrame) -> DataFrame:
    """The same for anchors with very many segments: windows meet by their own digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, a, body in zip(*[batch[c].to_pylist() for c in ("digest", "a", "body")]):
                n = len(body) - WINDOW + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(body[i:i + WINDOW]) for i in range(n)],
                              pa.binary()), pa.array([digest] * n, pa.binary()),
                     pa.array(range(a, a + n), pa.int32())], names=["w", "digest", "lo"])
    windows = found.mapInArrow(run, "w binary, digest binary, lo int")
    often = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return windows.join(often.select("w"), "w").select("digest", "lo", F.col("lo").alias("hi"))


def _remove(texts: DataFrame) -> DataFrame:
    """Bytes and spans removed and the digest of the rest, for texts with marked windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                out: list[tuple] = []
                for text, digest, marks in zip(piece["text"].to_pylist(),
                                               piece["digest"].to_pylist(),
                                               piece["marks"].to_pylist()):
                    raw = np.frombuffer(text.encode(), np.uint8)
                    steps = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(steps, [m["lo"] for m in marks], 1)
                    np.add.at(steps, [m["hi"] + WINDOW for m in marks], -1)
                    gone = np.cumsum(steps)[:-1] > 0
                    out.append((digest, int(gone.sum()), len(_runs(gone)),
                                hashlib.sha256(raw[~gone].tobytes()).hexdigest(),
                                raw[~gone].tobytes()))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                    names=["digest", "n_removed", "n_spans", "kept_sha256", "kept"])
    return texts.select("text", "digest", "marks").mapInArrow(
        run, "digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    NULL counts as the empty text.  A text of at least 200 bytes that occurs twice goes
    whole; a shorter one loses nothing.  Repeated rows are occurrences of their own, NULL keys
    are kept, other columns are left out.
    """
    profile = settle(_profile(docs, key, text))
    # one row per text; equal texts are merged before they are sent
    texts = settle(profile.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"),
        F.first(F.arrays_zip("anchor", "mark", "a", "b")).alias("s")))
    pieces = texts.select("digest", "copies", F.explode("s").alias("s")).select(
        "digest", "copies", "s.anchor", "s.mark", "s.a", "s.b")
    often = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(pieces.join(often.select("anchor"), "anchor"))

    # equal segments of one anchor repeat as they stand
    same = shared.groupBy("anchor", "mark").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col("copies") > 1, "digest", "a", "b")).alias("s"))
    same = settle(same)
    equal = shared.where("copies = 1").join(same.where("n > 1").select("anchor", "mark"),
                                            ["anchor", "mark"]).select(
        "digest", F.col("a").alias("lo"), F.col("b").alias("hi"))
    # anchors with several different segments, some of which occur once
    mixed = same.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"),
                                       F.min("n").alias("least")).where("kinds > 1 and least = 1")
    wanted = same.join(mixed.select("anchor", "kinds"), "anchor").select(
        "anchor", "kinds", "s.digest", "s.a", "s.b")
    lists = wanted.groupBy("digest").agg(F.collect_list(F.struct("anchor", "a", "b")).alias("want"))

    # text is needed of segments to index and of texts that lose a part
    touched = texts.select("digest", "copies").join(
        equal.select("digest").union(wanted.select("digest")).distinct(), "digest").join(
        lists, "digest", "left")
    body = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn(
        "digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    carried = settle(body.join(touched, "digest"))

    cut = settle(_cut_segments(carried.where("want is not null"))
                 .dropDuplicates(["anchor", "digest", "a"])
                 .join(mixed.select("anchor", "kinds"), "anchor"))
    indexed = _index(cut.where(F.col("kinds") <= HOT_SEGMENTS).drop("kinds"))
    hot = _by_window(cut.where(F.col("kinds") > HOT_SEGMENTS).drop("kinds"))
    marks = equal.union(indexed).union(hot).groupBy("digest").agg(
        F.collect_list(F.struct("lo", "hi")).alias("marks"))
    partly = _remove(carried.where("copies = 1").join(marks, "digest")).drop("kept")

    copied = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)).select(
        "digest", F.lit(True).alias("_whole"))
    return (profile.select("key", "digest", "n_bytes", "sha256")
            .join(copied, "digest", "left").join(partly, "digest", "left")
            .select(F.col("key").alias(key), "n_bytes",
                    F.when(F.col("_whole"), F.col("n_bytes")).otherwise(
                        F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(F.col("_whole"), 1).otherwise(
                        F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                    F.when(F.col("_whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(
                        F.coalesce("kept_sha256", "sha256")).alias("kept_sha256")))
