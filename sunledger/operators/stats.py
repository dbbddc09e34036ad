"""Exploration: counts, distributions, correlations and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from sunledger.operators.skew import (
    HALO, counted, prefix_sum, slice_rows, slice_totals, time_ordinal)
from sunledger.session import settle
from sunledger.sources.telemetry import time_order

QUARTILES = (0.25, 0.5, 0.75)
#: accuracy of the rank sketch: ranks are off by at most 1 / SKETCH of the rows
SKETCH = 10_000


def fault_counts(rows: DataFrame) -> DataFrame:
    """Value counts of ``fault_active``, and of ``fault_type`` among faulted rows."""
    both = rows.groupBy("fault_active", "fault_type").agg(F.count(F.lit(1)).alias("n"))
    active = (both.where("fault_active is not null").groupBy(F.col("fault_active").cast("string").alias("value"))
              .agg(F.sum("n").alias("n")).withColumn("kind", F.lit("fault_active")))
    kinds = (both.where("fault_active and fault_type is not null").groupBy(F.col("fault_type").alias("value"))
             .agg(F.sum("n").alias("n")).withColumn("kind", F.lit("fault_type")))
    return (active.unionByName(kinds).select("kind", "value", "n")
            .orderBy("kind", F.desc("n"), "value"))


def fault_prevalence(rows: DataFrame) -> DataFrame:
    counts = rows.agg(F.count_if(~F.col("fault_active")).alias("healthy"),
                      F.count_if("fault_active").alias("faulted"))
    total = F.nullif(F.col("healthy") + F.col("faulted"), F.lit(0).cast("long"))
    return counts.withColumns({"healthy_pct": F.lit(100.0) * F.col("healthy") / total,
                               "faulted_pct": F.lit(100.0) * F.col("faulted") / total})


def year_fault_rate(rows: DataFrame) -> DataFrame:
    active = F.col("fault_active")
    return rows.groupBy("sim_year").agg(
        F.count_if(active).alias("faulted"), F.count(active).alias("n_rows"),
        (F.count_if(active) / F.count(active)).alias("fault_rate")).orderBy("sim_year")


def file_row_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))


def unpivot(df: DataFrame, names: Sequence[str], *keep) -> DataFrame:
    """``(keep..., feature, value)`` rows of the present, non-null features."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"),
                               F.col(n).cast("double").alias("value")) for n in names])
    return (df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")
            .where(F.col("value").isNotNull()))


def feature_stats(rows: DataFrame, names: Sequence[str],
                  at: Sequence[float] = ()) -> DataFrame:
    """count, mean, sample std, min and max as one row per feature, from one aggregate.

    With ``at``, also ``sketch``: a rank sketch's values at these fractions.
    """
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if at:
        wanted = F.array(*[F.lit(float(q)) for q in at])
        parts["sketch"] = lambda x: F.percentile_approx(x, wanted, SKETCH)
    one = rows.agg(*[F.struct(*[f(F.col(n).cast("double")).alias(k) for k, f in parts.items()])
                     .alias(n) for n in names])
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("_s")) for n in names])
    return one.select(F.explode(cells).alias("_f")).select("_f.feature", "_f._s.*")


def bracket_edges(fractions: Sequence[float]) -> list[float]:
    """Where to read a sketch so that two neighbours enclose each fraction's rank.

    The sketch's ranks are off by at most ``1 / SKETCH`` of the rows; twice that leaves room
    for both ranks between which a quantile is interpolated.
    """
    off = 2 / SKETCH
    return [edge for q in fractions for edge in (max(0.0, q - off), min(1.0, q + off))]


def bracket_values(rows: DataFrame, brackets: dict) -> DataFrame:
    """``(feature, fraction, value, _rows)`` of the values inside each bracket.

    ``brackets`` maps (feature, fraction) to its lowest and highest value.  All rows below a
    bracket are one row with a NULL value; rows above it are not looked at any further.
    """
    cells = []
    for (name, q), (low, high) in brackets.items():
        x = F.col(name).cast("double")
        inside = F.when(x >= F.lit(low), x)
        cells.append(F.when(x <= F.lit(high), F.struct(
            F.lit(name).alias("feature"), F.lit(float(q)).alias("fraction"),
            inside.alias("value"))))
    return (rows.select(F.explode(F.array_compact(F.array(*cells))).alias("_c")).select("_c.*")
            .groupBy("feature", "fraction", "value").agg(F.count(F.lit(1)).alias("_rows")))


def exact_quantiles(rows: DataFrame, names: Sequence[str], stats: DataFrame,
                    fractions: Sequence[float]) -> DataFrame:
    """Linear-interpolated exact quantiles: ``(feature, fraction, value)``.

    ``stats`` is the table of ``feature_stats`` at ``bracket_edges(fractions)``.  Between the
    two edges of a fraction lies at most a share of about ``6 / SKETCH`` of the feature's rows
    (and ties), however the values are spread; these alone are counted value by value.  A rank
    that its bracket does not hold would be looked for among all values.
    """
    known = {r["feature"]: r for r in stats.collect() if r["count"]}  # one row per feature
    spark, found = rows.sparkSession, []
    ranks = {(name, q): q * (known[name]["count"] - 1)
             for name in names if name in known for q in fractions}
    edges = {(name, q): tuple(known[name]["sketch"][2 * i:2 * i + 2])
             for name in names if name in known for i, q in enumerate(fractions)}
    whole = {key: (known[key[0]]["min"], known[key[0]]["max"]) for key in edges}
    for brackets in (edges, whole):
        open_keys = [key for key in ranks if key not in {(r["feature"], r["fraction"])
                                                         for r in found}]
        if open_keys:
            found += _values_at(rows, {key: brackets[key] for key in open_keys},
                                {key: ranks[key] for key in open_keys})
    return spark.createDataFrame([tuple(r) for r in found],
                                 "feature string, fraction double, value double")


def _values_at(rows: DataFrame, brackets: dict, ranks: dict) -> list:
    """Values at the ranks that lie in their brackets; one row per feature and fraction."""
    keys = ["feature", "fraction"]
    values = settle(bracket_values(rows, brackets))
    wanted = rows.sparkSession.createDataFrame(
        [(name, float(q), float(at)) for (name, q), at in ranks.items()],
        "feature string, fraction double, _at double")
    below = F.broadcast(wanted.join(values.where(F.col("value").isNull()).select(
        *keys, F.col("_rows").alias("_below")), keys, "left"))  # one row per feature and fraction
    running = (prefix_sum(values.where(F.col("value").isNotNull()), keys, ["value"],
                          F.col("value"), "_rows", "_seen")
               .join(below, keys)
               .withColumn("_seen", F.col("_seen") + F.coalesce("_below", F.lit(0))))
    seen, before = F.col("_seen"), F.col("_seen") - F.col("_rows")

    def value_at(rank):
        return F.min(F.when((before <= rank) & (rank < seen), F.col("value")))

    low, high = value_at(F.floor("_at")), value_at(F.ceil("_at"))
    weight = F.first(F.col("_at") - F.floor("_at"))
    return (running.groupBy(*keys).agg((low + (high - low) * weight).alias("value"))
            .where(F.col("value").isNotNull()).collect())


def feature_describe(rows: DataFrame, names: Sequence[str], digits: int = 4) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per feature, rounded."""
    basic, _ = counted(feature_stats(rows, names, bracket_edges(QUARTILES)))
    wide = exact_quantiles(rows, names, basic, QUARTILES).groupBy("feature").agg(*[
        F.max(F.when(F.col("fraction") == q, F.col("value"))).alias(f"q{int(q * 100)}")
        for q in QUARTILES])
    ordered = ("mean", "std", "min", "q25", "q50", "q75", "max")
    # one row per feature
    return basic.join(F.broadcast(wide), "feature", "left").select(
        "feature", "count", *[F.round(c, digits).alias(c) for c in ordered])


def feature_histogram(rows: DataFrame, names: Sequence[str], bins: int = 50) -> DataFrame:
    """Density histogram per feature and class, each over its own min to max."""
    long = unpivot(rows, names, "fault_active")
    keys = ["feature", "fault_active"]
    span = long.groupBy(*keys).agg(F.min("value").alias("_min"), F.max("value").alias("_max"),
                                   F.count(F.lit(1)).alias("_total"))
    flat = F.when(F.col("_min") == F.col("_max"), F.lit(0.5)).otherwise(F.lit(0.0))
    # two rows per feature
    span = F.broadcast(span.select(
        *keys, "_total", (F.col("_min") - flat).alias("_lo"), (F.col("_max") + flat).alias("_hi")
    ).withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))))
    at = F.least(F.floor((F.col("value") - F.col("_lo")) / F.col("_w")),
                 F.lit(bins - 1).cast("long")).cast("int")
    filled = (long.join(span, keys).select(*keys, at.alias("bin"))
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n")))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return grid.join(filled, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
        n.alias("n"), (n / (F.col("_total") * F.col("_w"))).alias("density"))


def correlation_matrix(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete), from one aggregate."""
    columns = [*names, "fault_active"]
    double = {c: (F.col(c).cast("int") if c == "fault_active" else F.col(c)).cast("double")
              for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[F.corr(double[a], double[b]).alias(f"c{i}")
                     for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("feature_a"), F.lit(right).alias("feature_b"),
                                  F.col(f"c{i}").alias("correlation")))
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


# --- series ------------------------------------------------------------------------------

def nth_row(rows: DataFrame, n: int = 101) -> DataFrame:
    """The n-th row in file and time order, by a top-n rather than a global numbering."""
    order = ["source_file", *time_order(rows)]
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("_rank", F.row_number().over(Window.orderBy(*order))).where(
        F.col("_rank") == n).drop("_rank")


def nth_row_day(rows: DataFrame, n: int = 101) -> DataFrame:
    """All rows of the day that holds the n-th row."""
    # one-row side
    day = nth_row(rows, n).select("sim_day")
    return rows.join(F.broadcast(day), "sim_day", "left_semi").select(*rows.columns)


def sample_series(rows: DataFrame, n: int = 101) -> DataFrame:
    """That day ordered by time: irradiance, AC power, performance ratio and fault flag."""
    return (nth_row_day(rows, n)
            .select("source_file", *time_order(rows), "poa_global_wm2", "ac_power_kw",
                    "performance_ratio", "fault_active")
            .orderBy(*time_order(rows)))


def fault_spans(rows: DataFrame, rows_per_slice: int | None = None) -> DataFrame:
    """Contiguous faulted stretches of each run."""
    order = time_order(rows)
    sliced = slice_rows(rows.select("source_file", *order, "fault_active"), ["source_file"],
                        time_ordinal("timestamp"), reach=1, rows_per_slice=rows_per_slice)
    previous = F.lag("fault_active").over(sliced.window(*order))
    changed = F.coalesce((F.col("fault_active") != previous).cast("int"), F.lit(0))
    marked = sliced.rows.withColumn("_turn", F.when(F.col(HALO), 0).otherwise(changed))
    islands = sliced.drop_helpers(slice_totals(sliced, marked, order, "_turn", "_island"))
    return (islands.where("fault_active").groupBy("source_file", "_island")
            .agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"),
                 F.count(F.lit(1)).alias("n_rows")).drop("_island"))


def head_tail_sample(rows: DataFrame, order: Sequence[str], n: int = 1000) -> DataFrame:
    """First and last ``n`` rows; a short table contributes rows to both parts."""
    head = rows.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
    tail = (rows.orderBy(*[F.desc(c) for c in order]).limit(n)
            .withColumn("part", F.lit("tail")))
    return head.unionByName(tail)


def constant_columns(rows: DataFrame, names: Sequence[str], order: Sequence[str] = (),
                     n: int | None = None) -> DataFrame:
    """Columns with at most one value; NULL counts as one.

    Every row counts unless ``n`` asks for the first and last ``n`` rows alone.  One aggregate of minima, maxima and NULL counts; maps
    have no order and are never reported.
    """
    sample = head_tail_sample(rows, order, n).drop("part") if n else rows
    names = [c for c in names if not isinstance(rows.schema[c].dataType, T.MapType)]
    flat = {c: F.when(F.count(c) == 0, True)
            .otherwise((F.count(c) == F.count(F.lit(1))) & F.min(c).eqNullSafe(F.max(c)))
            for c in names}
    one = sample.agg(*[value.alias(c) for c, value in flat.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("_flat"))
                      for c in names])
    return one.select(F.explode(cells).alias("_c")).where("_c._flat").select("_c.column")


def estimate_capacity(rows: DataFrame) -> DataFrame:
    return rows.agg((F.max("dc_power_kw").cast("double") * F.lit(1.05)).alias("array_kwp"))
