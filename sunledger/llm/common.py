"""Reading tables, cutting Arrow batches to a bounded size, and hashing words in bulk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of at most ``limit`` bytes of text, or of one row."""
    lengths = pc.fill_null(pc.binary_length(batch[text]), 0)
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    start, rows = 0, batch.num_rows
    while start < rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
              text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` to pieces of bounded text size of every Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, limit):
                yield fn(piece)
    return df.mapInArrow(run, schema)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array as one vector, and the offsets of its rows.

    NULL counts as the empty text.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return everything[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint8)
    lower = codes.copy()
    lower[65:91] += 32
    word = (codes >= 128) | ((lower >= 97) & (lower <= 122)) | ((codes >= 48) & (codes <= 57))
    with np.errstate(over="ignore"):
        weight = mix(lower.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return lower, word, weight


LOWER, WORD, _WEIGHT = _tables()
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte after it.

    A word is a run of ASCII letters, digits and non-ASCII characters inside one row.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (ASCII letters in lower case) and the row of each word.

    Long inputs are hashed in stretches that end between words.
    """
    starts, ends = word_bounds(data, offsets)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        part = data[base:ends[last - 1]]
        power, inverse = _powers(len(part))
        with np.errstate(over="ignore"):
            running = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_WEIGHT[part] * power, out=running[1:])
            lo, hi = starts[first:last] - base, ends[first:last] - base
            out[first:last] = mix((running[hi] - running[lo]) * inverse[lo] + hi.astype(np.uint64)
                                  - lo.astype(np.uint64))
        first = last
    return out, np.searchsorted(offsets, starts, side="right") - 1
