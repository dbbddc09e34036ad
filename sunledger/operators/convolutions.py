"""Windows described by dilated convolutions: features that see the order of the rows.

A kernel slides over the rows of a window, reading every ``dilation``-th row of some features;
of its outputs the largest and the share above zero are kept.  Seeded kernels are the same in
every session, so a stored model can cut windows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sunledger.operators.sequences import window_chunks

LENGTHS = (3, 5, 7, 9)
N_KERNELS, SEED = 100, 42
_CELLS = 1 << 20


@dataclass(frozen=True)
class Kernel:
    """``weights`` is (taps, features); ``padding`` zero rows stand before and after a window."""

    weights: np.ndarray
    dilation: int = 1
    offset: float = 0.0
    padding: int = 0

    def outputs(self, windows: np.ndarray) -> np.ndarray:
        """``(windows, positions)`` of ``(windows, size, features)``."""
        if self.padding:
            windows = np.pad(windows, ((0, 0), (self.padding, self.padding), (0, 0)))
        reach = (len(self.weights) - 1) * self.dilation
        n = windows.shape[1] - reach
        used = np.flatnonzero(self.weights.any(axis=0))
        out = np.full((len(windows), n), self.offset)
        for tap, weight in enumerate(self.weights):
            at = tap * self.dilation
            for f in used:
                out += weight[f] * windows[:, at:at + n, f]
        return out


def seeded_kernels(size: int, n_features: int, n_kernels: int = N_KERNELS,
                   seed: int = SEED) -> list[Kernel]:
    """Kernels of mean zero, each over a few features, with spread out dilations."""
    rng, out = np.random.default_rng([seed, size, n_features, n_kernels]), []
    lengths = [n for n in LENGTHS if n <= size] or [size]
    for _ in range(n_kernels):
        length = int(rng.choice(lengths))
        most = np.log2((size - 1) / (length - 1)) if length > 1 else 0.0
        dilation = int(2 ** rng.uniform(0, most))
        chosen = rng.permutation(n_features)[:int(2 ** rng.uniform(0, np.log2(n_features + 1)))]
        weights = np.zeros((length, n_features))
        draws = rng.normal(size=(length, len(chosen)))
        weights[:, chosen] = (draws - draws.mean(axis=0)) / np.sqrt(len(chosen))
        padding = (length - 1) * dilation // 2 if rng.random() < 0.5 else 0
        out.append(Kernel(weights, dilation, float(rng.uniform(-1, 1)), padding))
    return out


def pooled(windows: np.ndarray, kernels: Sequence[Kernel]) -> np.ndarray:
    """Largest output and share of outputs above zero, kernel by kernel."""
    columns = []
    for kernel in kernels:
        out = kernel.outputs(windows)
        columns += [out.max(axis=1), (out > 0).mean(axis=1)]
    return np.stack(columns, axis=1)


def pooled_names(n_kernels: int) -> list[str]:
    return [f"kernel_{i}_{kind}" for i in range(n_kernels) for kind in ("max", "above")]


def window_kernels(rows: DataFrame, names: Sequence[str], size: int, stride: int,
                   kernels: Sequence[Kernel] | None = None, label: str = "label",
                   rows_per_slice: int | None = None) -> DataFrame:
    """Windows of ``size`` rows every ``stride`` rows by the pooled outputs of kernels.

    ``label`` is the last row's; a run shorter than ``size`` has no window.  A kernel must fit
    into a padded window.
    """
    kernels = list(kernels if kernels is not None else seeded_kernels(size, len(names)))
    if any((len(k.weights) - 1) * k.dilation >= size + 2 * k.padding for k in kernels):
        raise ValueError("a kernel reaches over the window")
    width, out_names = len(names), pooled_names(len(kernels))
    step = max(1, _CELLS // (size * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = np.asarray(batch["block"][row].values, float).reshape(-1, width)
                marks = batch["labels"][row].values
                first, file = batch["first"][row].as_py(), batch["source_file"][row].as_py()
                cut = np.lib.stride_tricks.sliding_window_view(block, size, axis=0)[::stride]
                for at in range(0, len(cut), step):
                    some = cut[at:at + step].transpose(0, 2, 1)
                    number = np.arange(at, at + len(some))
                    found = pooled(some, kernels)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(some), pa.string()),
                         pa.array(first // stride + number),
                         marks.take(pa.array(number * stride + size - 1)),
                         pa.array(np.full(len(some), size, np.int32)),
                         *[pa.array(np.ascontiguousarray(c)) for c in found.T]],
                        names=["source_file", "window_id", "label", "n_rows", *out_names])

    kinds = "".join(f", {n} double" for n in out_names)
    chunks = window_chunks(rows, names, size, stride, label, rows_per_slice)
    return chunks.mapInArrow(
        run, f"source_file string, window_id long, label double, n_rows int{kinds}")
