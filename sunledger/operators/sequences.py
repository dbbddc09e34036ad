"""Scaling, time order inside runs, and sliding windows of rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from sunledger.functions.expressions import clean_number
from sunledger.operators.skew import BASE, HALO, SLICE, slice_rows, time_ordinal, with_position
from sunledger.sources.telemetry import time_order

#: least rows of a stretch of windows, and least multiple of the window size
CHUNK_ROWS, CHUNK_WINDOWS = 1024, 8


# --- scaler ------------------------------------------------------------------------------

def fit_scaler(features: DataFrame, files: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of ``mean_<f>`` and population ``std_<f>`` over all rows of the files."""
    names = [n for n in names if n in features.columns]
    chosen = features.join(files.select("source_file").distinct(), "source_file", "left_semi")
    clean = chosen.select(*[clean_number(n).cast("double").alias(n) for n in names])
    return clean.agg(*[F.avg(n).alias(f"mean_{n}") for n in names],
                     *[F.stddev_pop(n).alias(f"std_{n}") for n in names])


def scaler_table(scaler: DataFrame) -> DataFrame:
    """The one-row scaler as ``(feature, mean, std)``."""
    names = [c[5:] for c in scaler.columns if c.startswith("mean_")]
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"mean_{n}").alias("mean"),
                              F.col(f"std_{n}").alias("std")) for n in names])
    return scaler.select(F.explode(rows).alias("_r")).select("_r.*")


def apply_scaler(features: DataFrame, scaler: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(x - mean) / std`` with a zero deviation taken as 1."""
    names = [c[5:] for c in scaler.columns if c.startswith("mean_")]

    def scaled(name: str):
        spread = F.coalesce(F.nullif(F.col(f"std_{name}"), F.lit(0.0)), F.lit(1.0))
        value = clean_number(name).cast("double")
        return ((value - F.col(f"mean_{name}")) / spread).cast("float").alias(name)

    # one-row side
    return features.crossJoin(F.broadcast(scaler)).select(*keep, *[scaled(n) for n in names])


# --- windows -----------------------------------------------------------------------------

def sort_run(rows: DataFrame, rows_per_slice: int | None = None) -> DataFrame:
    """0-based time position ``rn`` of each row in its run; filter rows before calling."""
    placed = with_position(rows, ["source_file"], time_order(rows), time_ordinal("timestamp"),
                           "_pos", rows_per_slice)
    return placed.withColumn("rn", (F.col("_pos") - 1)).drop("_pos")


@dataclass(frozen=True)
class Pieces:
    """Rows aggregated into the pieces that windows are put together from.

    A run is cut wherever a window starts or ends, so two pieces a stride (one where ``stride``
    divides ``size``), and every window is whole pieces.  Each row is sent and aggregated once;
    a window is a frame of at most ``2 * size / stride + 1`` pieces inside the same partition.
    Windows that cross two slices of a long run are made where their last row lies.
    """

    table: DataFrame
    size: int
    stride: int

    @property
    def per_stride(self) -> int:
        return 2 if self.size % self.stride else 1

    @property
    def kinds(self) -> list[tuple[int, int, int]]:
        """Which of a stride's pieces, its rows, and how many of them a window has."""
        whole, rest = divmod(self.size, self.stride)
        both = [(0, rest, whole + 1), (1, self.stride - rest, whole)] if rest else [
            (0, self.stride, whole)]
        return [kind for kind in both if kind[2]]

    def windows(self, own: Sequence = (), **merged) -> DataFrame:
        """Complete windows; ``own`` are columns of the last piece, ``merged`` aggregates of all.

        ``_k`` numbers the pieces of a slice, so that positions stay small in long runs.
        """
        n_pieces = sum(kind[2] for kind in self.kinds)
        order = Window.partitionBy("source_file", SLICE).orderBy("_piece")
        frame = order.rowsBetween(1 - n_pieces, 0)
        numbered = self.table.withColumn("_k", F.row_number().over(order).cast("double"))
        # a window ends with the piece after a window start, or with a whole stride
        ends = ~F.col(HALO) & (F.col("_piece") % self.per_stride == 0)
        back = (n_pieces - 1) // self.per_stride
        return (numbered.select("*", F.sum("_n").over(frame).cast("int").alias("n_rows"),
                                *[c.over(frame).alias(name) for name, c in merged.items()])
                .where(ends & (F.col("n_rows") == self.size))
                .select("source_file",
                        F.expr(f"_piece div {self.per_stride} - {back}").alias("window_id"),
                        "n_rows", *own, *merged))


def window_pieces(rows: DataFrame, size: int, stride: int, *aggregates,
                  rows_per_slice: int | None = None) -> Pieces:
    """Cut runs into pieces; ``aggregates`` may read ``_rn`` and ``_step``, the row's position
    in its run and in its piece."""
    rest = size % stride
    per_stride = 2 if rest else 1
    sliced = slice_rows(rows, ["source_file"], time_ordinal("timestamp"), reach=size - 1,
                        rows_per_slice=rows_per_slice)
    at = F.col("_rn") % stride
    placed = (sliced.rows
              .withColumn("_rn", F.col(BASE) - 1 + F.row_number().over(
                  sliced.window(*time_order(rows))))
              .withColumn("_late", (at >= rest).cast("int") if rest else F.lit(0))
              .withColumn("_piece", F.expr(f"_rn div {stride} * {per_stride}") + F.col("_late"))
              .withColumn("_step", (at - F.col("_late") * rest).cast("double")))
    return Pieces(placed.groupBy("source_file", SLICE, "_piece").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(HALO, "_rn").alias(HALO), *aggregates),
        size, stride)


def sequence_windows(rows: DataFrame, size: int, stride: int, label: str = "label",
                     rows_per_slice: int | None = None) -> DataFrame:
    """Windows of ``size`` rows every ``stride`` rows; the label is the last row's."""
    pieces = window_pieces(
        rows.select("source_file", *time_order(rows), label), size, stride,
        F.min("timestamp").alias("_start"), F.max("timestamp").alias("_end"),
        F.max_by(label, "_rn").alias("label"), rows_per_slice=rows_per_slice)
    return pieces.windows(["label"], start_ts=F.min("_start"), end_ts=F.max("_end"))


def window_arrays(rows: DataFrame, names: Sequence[str], size: int, stride: int,
                  rows_per_slice: int | None = None) -> DataFrame:
    """The ``(size, features)`` block of every window as nested arrays."""
    point = F.struct("_rn", F.array(*[clean_number(n) for n in names]).alias("x"))
    pieces = window_pieces(
        rows.select("source_file", *time_order(rows), *names), size, stride,
        F.sort_array(F.collect_list(point)).alias("_points"), rows_per_slice=rows_per_slice)
    return pieces.windows(_blocks=F.collect_list("_points.x")).select(
        "source_file", "window_id", "n_rows", F.flatten("_blocks").alias("block"))


def _piece_stats(name: str) -> list:
    """What a piece keeps of a feature: moments around its own mean, so digits are not lost."""
    x, n = clean_number(name).cast("double"), F.count(F.lit(1))
    return [F.avg(x).alias(f"_mean_{name}"), (F.var_pop(x) * n).alias(f"_spread_{name}"),
            (F.covar_pop(x, F.col("_step")) * n).alias(f"_trend_{name}"),
            F.min(x).alias(f"_min_{name}"), F.max(x).alias(f"_max_{name}"),
            F.max_by(x, "_rn").alias(f"{name}_last")]


def _frame_stats(name: str, pieces: Pieces) -> dict:
    """Inside the pieces, and among the means of all equally long ones."""
    out = {f"_spread_in_{name}": F.sum(f"_spread_{name}"),
           f"_trend_in_{name}": F.sum(f"_trend_{name}"),
           f"{name}_min": F.min(f"_min_{name}"), f"{name}_max": F.max(f"_max_{name}")}
    for kind, _, _ in pieces.kinds:
        mean = F.when(F.col("_piece") % pieces.per_stride == kind, F.col(f"_mean_{name}"))
        out |= {f"_mean_{kind}_{name}": F.avg(mean), f"_var_{kind}_{name}": F.var_pop(mean),
                f"_cov_{kind}_{name}": F.covar_pop(mean, F.col("_k"))}
    return out


def _window_stats(name: str, pieces: Pieces) -> list:
    """Mean, deviation and slope: what varies inside pieces, among equally long pieces, and
    between the two lengths adds up."""
    size, zero = pieces.size, F.lit(0.0)
    rows_of = {kind: float(n * times) for kind, n, times in pieces.kinds}
    mean = sum((F.col(f"_mean_{kind}_{name}") * n for kind, n in rows_of.items()), zero) / size
    spread, trend = F.col(f"_spread_in_{name}"), F.col(f"_trend_in_{name}")
    for kind, n, times in pieces.kinds:
        off = F.col(f"_mean_{kind}_{name}") - mean
        # the middle row of all pieces of this length, counted from the window's middle row
        first = 0 if kind == 0 else size % pieces.stride
        late = first + (n - 1) / 2 + (times - 1) * pieces.stride / 2 - (size - 1) / 2
        spread += rows_of[kind] * (F.col(f"_var_{kind}_{name}") + off * off)
        trend += rows_of[kind] * (F.col(f"_cov_{kind}_{name}") * (
            pieces.stride / pieces.per_stride) + off * late)
    return [f"{name}_last", mean.alias(f"{name}_mean"),
            F.sqrt(spread / F.nullif(F.lit(size - 1.0), zero)).alias(f"{name}_std"),
            f"{name}_min", f"{name}_max",
            (trend / F.nullif(F.lit(size * (size * size - 1) / 12.0), zero)).alias(
                f"{name}_slope")]


def window_summary(rows: DataFrame, names: Sequence[str], size: int, stride: int,
                   label: str = "label", rows_per_slice: int | None = None) -> DataFrame:
    """Per window and feature: last, mean, std, min, max and slope over the rows."""
    pieces = window_pieces(
        rows.select("source_file", *time_order(rows), label, *names), size, stride,
        F.max_by(label, "_rn").alias("label"), *[c for n in names for c in _piece_stats(n)],
        rows_per_slice=rows_per_slice)
    merged = {key: c for n in names for key, c in _frame_stats(n, pieces).items()}
    return pieces.windows(["label", *[f"{n}_last" for n in names]], **merged).select(
        "source_file", "window_id", "n_rows", "label",
        *[c for n in names for c in _window_stats(n, pieces)])


def last_step(rows: DataFrame, names: Sequence[str], size: int, stride: int,
              label: str = "label", rows_per_slice: int | None = None) -> DataFrame:
    """Only the last row of every window: what a per-step classifier looks at.

    The last row of window ``w`` is row ``w * stride + size - 1``, so nothing is exploded.
    """
    done = F.col("rn") - (size - 1)
    ordered = sort_run(rows.select("source_file", *time_order(rows), label, *names),
                       rows_per_slice)
    return (ordered.where((done >= 0) & (done % stride == 0))
            .select("source_file", F.expr(f"(rn - {size - 1}) div {stride}").alias("window_id"),
                    F.col(label).alias("label"), *names))


def window_chunks(rows: DataFrame, names: Sequence[str], size: int, stride: int,
                  label: str = "label", rows_per_slice: int | None = None) -> DataFrame:
    """Stretches of a run that hold whole windows: ``first``, ``labels`` and ``block`` in order.

    A stretch has the rows of ``n`` window starts and the ``size - 1`` rows after the last of
    them; so a row is sent once, and twice only where two stretches meet, whatever ``size /
    stride`` is.  ``first`` is the position of the first row, a multiple of ``stride``.
    """
    length = stride * max(1, -(-max(CHUNK_ROWS, CHUNK_WINDOWS * size) // stride))
    point = F.struct("rn", F.col(label).cast("double").alias("y"),
                     F.array(*[clean_number(n).cast("double") for n in names]).alias("x"))
    ordered = sort_run(rows.select("source_file", *time_order(rows), label, *names),
                       rows_per_slice)
    # only the first size - 1 rows of a stretch belong to an earlier one too
    first = F.when(F.col("rn") < size - 1, F.lit(0).cast("long")).otherwise(
        F.expr(f"(rn - {size - 1}) div {length}"))
    placed = ordered.select("source_file", point.alias("_point"), F.explode(F.sequence(
        first, F.expr(f"rn div {length}"))).alias("_chunk"))
    points = (placed.groupBy("source_file", "_chunk")
              .agg(F.sort_array(F.collect_list("_point")).alias("_points")))
    return points.where(F.size("_points") >= size).select(
        "source_file", (F.col("_chunk") * length).alias("first"), F.col("_points.y").alias("labels"),
        F.flatten("_points.x").alias("block"))


def short_run_loss(rows: DataFrame, size: int) -> DataFrame:
    """Runs and rows that windows of ``size`` lose because a run is shorter."""
    runs = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("_n"))
    short = F.col("_n") < size
    lost = F.coalesce(F.sum(F.when(short, F.col("_n"))), F.lit(0))
    return runs.agg(
        F.count_if(short).alias("runs_lost"), F.count(F.lit(1)).alias("n_runs"),
        lost.alias("rows_lost"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows")
    ).withColumn("pct_rows_lost", F.lit(100.0) * F.col("rows_lost")
                 / F.greatest(F.col("n_rows"), F.lit(1)))


def val_fallback(windows: DataFrame) -> DataFrame:
    """Validate on the train windows when there are none; nothing without train or test."""
    sides = windows.agg(*[F.count_if(F.col("split") == s).alias(f"_{s}")
                          for s in ("train", "val", "test")])
    serves = (F.when((F.col("_val") == 0) & (F.col("split") == "train"),
                     F.array(F.lit("train"), F.lit("val")))
              .otherwise(F.array("split")))
    # one-row side
    return (windows.crossJoin(F.broadcast(sides))
            .where((F.col("_train") > 0) & (F.col("_test") > 0))
            .withColumn("split", F.explode(serves)).select(*windows.columns))
