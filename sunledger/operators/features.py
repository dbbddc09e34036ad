"""Row and rolling features of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sunledger.functions.expressions import clean_number, clip, cyclic, ratio
from sunledger.operators.skew import slice_rows, time_ordinal
from sunledger.sources.telemetry import file_order

POA_THRESHOLD = 10.0
LOOKBACK = 12

ENGINEERED = ("hour_sin", "hour_cos", "doy_sin", "doy_cos", "performance_ratio",
              "pr_deviation", "dc_ac_power_ratio", "power_step")


def daytime_filter(df: DataFrame, threshold: float = POA_THRESHOLD) -> DataFrame:
    """Keep rows strictly above the irradiance threshold; NULL and NaN are dropped."""
    known = F.nanvl("poa_global_wm2", F.lit(None).cast("float"))
    return df.where(known > F.lit(threshold))


def time_features(df: DataFrame) -> DataFrame:
    hour = F.hour("timestamp") + F.minute("timestamp") / F.lit(60.0)
    day = F.dayofyear("timestamp").cast("double")
    return df.withColumns({
        "hour_sin": cyclic(hour, 24.0, F.sin), "hour_cos": cyclic(hour, 24.0, F.cos),
        "doy_sin": cyclic(day, 365.0, F.sin), "doy_cos": cyclic(day, 365.0, F.cos)})


def performance_ratio(df: DataFrame, array_kwp: float | None) -> DataFrame:
    """AC output over irradiance-normalised capacity; without capacity over irradiance."""
    sun = (F.col("poa_global_wm2") / F.lit(1000.0)).cast("float")
    if array_kwp and array_kwp > 0:
        output = (F.col("ac_power_kw") / F.lit(float(array_kwp))).cast("float")
        low, high = -1, 2
    else:
        output, low, high = F.col("ac_power_kw"), -100, 100
    value = ratio(output, sun).cast("float")
    return df.withColumn("performance_ratio", clip(value, low, high, default=0))


def dc_ac_power_ratio(df: DataFrame) -> DataFrame:
    value = ratio(F.col("dc_power_kw"), F.col("ac_power_kw")).cast("float")
    return df.withColumn("dc_ac_power_ratio", clip(value, 0, 5, default=1))


def rolling_features(df: DataFrame, lookback: int = LOOKBACK,
                     rows_per_slice: int | None = None,
                     restart: Sequence[str] = ()) -> DataFrame:
    """``pr_deviation`` and ``power_step`` over the last ``lookback`` rows of each file.

    One shuffle on (file, slice) serves both; an oversized file is cut along its own
    order and each piece carries the preceding rows its first frames look back on.
    The state starts afresh wherever a column in ``restart`` differs.
    """
    order = file_order(df)
    ordinal = F.col("row_index") if order == ["row_index"] else time_ordinal("timestamp")
    sliced = slice_rows(df, ["source_file", *restart], ordinal, reach=lookback,
                        rows_per_slice=rows_per_slice)
    by_time = sliced.window(*order)
    frame = by_time.rowsBetween(-(lookback - 1), 0)
    pr = F.col("performance_ratio")

    rows = sliced.rows.withColumns({
        "_mean": F.avg(pr.cast("double")).over(frame),
        "_seen": F.count(pr).over(frame),
        "_step": F.abs(pr - F.lag(pr).over(by_time))})
    enough = F.col("_seen") >= F.lit(max(1, lookback // 4))
    rows = rows.withColumns({
        "pr_deviation": clip(ratio(pr.cast("double"), F.when(enough, F.col("_mean"))),
                             0, 3, default=1),
        "power_step": clip(F.max("_step").over(frame), 0, 2, default=0)})
    return sliced.drop_helpers(rows.drop("_mean", "_seen", "_step"))


def add_features(df: DataFrame, array_kwp: float | None, threshold: float = POA_THRESHOLD,
                 lookback: int = LOOKBACK, rows_per_slice: int | None = None,
                 restart: Sequence[str] = ()) -> DataFrame:
    """All engineered features over the daytime rows.  Filter years before calling."""
    day = daytime_filter(df, threshold)
    row_wise = dc_ac_power_ratio(performance_ratio(time_features(day), array_kwp))
    return rolling_features(row_wise, lookback, rows_per_slice, restart)


def feature_columns(df: DataFrame, names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Requested features that exist (in order, without repeats) and those that do not."""
    present = list(dict.fromkeys(n for n in names if n in df.columns))
    missing = sorted(set(names) - set(present))
    return present, missing


def clean_matrix(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Finite float features, missing ones dropped, next to the columns in ``keep``."""
    present, _ = feature_columns(df, names)
    return df.select(*keep, *[clean_number(n).alias(n) for n in present])
