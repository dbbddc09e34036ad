"""Exact-quota sampling, class counts and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sunledger.functions.expressions import seeded_digest
from sunledger.operators.skew import broadcast_checked, counted, take_smallest_hash
from sunledger.sources.telemetry import row_key

SEED = 42


def thin_majority(df: DataFrame, thin_factor: int, seed: int = SEED,
                  rows_per_slice: int | None = None) -> DataFrame:
    """Per file, cut the larger ``fault_active`` side to ``max(1, n // thin_factor)`` rows.

    A tie thins the faulted side; the minority side is kept whole.
    """
    if thin_factor <= 1 or "fault_active" not in df.columns:
        return df
    sides = df.groupBy("source_file").agg(
        F.count_if("fault_active").alias("_true"),
        F.count_if(~F.col("fault_active")).alias("_false"))
    quota = F.greatest(F.lit(1), F.expr(f"n div {thin_factor}"))
    both = F.explode(F.array(
        F.struct(F.lit(True).alias("fault_active"), F.col("_true").alias("n"),
                 (F.col("_true") >= F.col("_false")).alias("larger")),
        F.struct(F.lit(False).alias("fault_active"), F.col("_false").alias("n"),
                 (F.col("_true") < F.col("_false")).alias("larger"))))
    quotas = (sides.select("source_file", both.alias("_side")).select("source_file", "_side.*")
              .where("n > 0")
              .withColumn("quota", F.when(F.col("larger"), quota).otherwise(F.col("n")))
              .drop("larger"))
    key = row_key(df)
    return take_smallest_hash(df, ["source_file", "fault_active"], seeded_digest(seed, *key),
                              quotas, key, rows_per_slice)


def stratified_quotas(counts: DataFrame, label: str, cap: int) -> DataFrame:
    """Largest-remainder shares of ``cap``; ``counts`` has (label, n), one row per class."""
    total = counts.agg(F.sum("n").alias("_total"))
    shares = (counts.crossJoin(F.broadcast(total))
              .withColumn("_floor", F.expr(f"(cast({cap} as decimal(19, 0)) * n) div _total"))
              .withColumn("_left", F.expr(f"(cast({cap} as decimal(19, 0)) * n) % _total")))
    # one row per class
    everything = Window.partitionBy().rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.desc("_left"), label)
    spare = F.lit(cap) - F.sum("_floor").over(everything)
    extra = F.when(F.row_number().over(order) <= spare, 1).otherwise(0)
    return shares.withColumn("quota", F.col("_floor") + extra).select(label, "n", "quota")


def stratified_subsample(df: DataFrame, cap: int, label: str | None, seed: int = SEED,
                         rows_per_slice: int | None = None) -> DataFrame:
    """At most ``cap`` rows in class proportion; plain random where that is impossible."""
    key = row_key(df)
    digest = seeded_digest(seed, *key)
    if label and label in df.columns:
        counts, n_classes = counted(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
        total, rarest = counts.agg(F.sum("n"), F.min("n")).first()
        if not total or total <= cap:
            return df
        if rarest >= 2 and n_classes <= cap and n_classes <= total - cap:
            quotas = stratified_quotas(counts, label, cap)
            return take_smallest_hash(df, [label], digest, quotas, key, rows_per_slice)
    else:
        total = df.count()
        if total <= cap:
            return df
    whole = df.withColumn("_all", F.lit(1))
    quotas = df.sparkSession.createDataFrame([(1, total, cap)], "_all int, n long, quota long")
    return take_smallest_hash(whole, ["_all"], digest, quotas, key, rows_per_slice).drop("_all")


def load_split(features: DataFrame, files: DataFrame, cap: int | None = None,
               thin_factor: int = 1, seed: int = SEED,
               rows_per_slice: int | None = None) -> DataFrame:
    """Feature rows of the given files, thinned per file, then capped by fault type."""
    kept = features.join(broadcast_checked(files.select("source_file").distinct()),
                         "source_file", "left_semi").select(*features.columns)
    thinned = thin_majority(kept, thin_factor, seed, rows_per_slice)
    if not cap:
        return thinned
    return stratified_subsample(thinned, cap, "fault_type", seed, rows_per_slice)


# --- labels ----------------------------------------------------------------------------

def faulted_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("fault_active"))


def discover_fault_types(rows: DataFrame) -> DataFrame:
    return (faulted_only(rows).where(F.col("fault_type").isNotNull())
            .select("fault_type").distinct())


def label_table(rows: DataFrame) -> DataFrame:
    """``(fault_type, label)``: sorted fault types of faulted rows, numbered from 0."""
    # one row per class
    order = Window.orderBy("fault_type")
    return discover_fault_types(rows).withColumn("label", F.dense_rank().over(order) - 1)


def detection_labels(spark) -> DataFrame:
    return spark.createDataFrame([(0,), (1,)], "label int")


def encode_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with a known fault type, plus its number."""
    return rows.join(broadcast_checked(labels), "fault_type")


def decode_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(broadcast_checked(labels), "label")


def known_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(broadcast_checked(labels), "fault_type", "left_semi")


def unseen_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows per fault type that the label table does not know."""
    return (rows.join(broadcast_checked(labels), "fault_type", "left_anti")
            .groupBy("fault_type").agg(F.count(F.lit(1)).alias("n_dropped")))


def missing_classes(labels: DataFrame, rows: DataFrame) -> DataFrame:
    present = rows.select("fault_type").distinct()
    return labels.join(present, "fault_type", "left_anti").select("fault_type")


def class_counts(rows: DataFrame, target: str, labels: DataFrame | None = None) -> DataFrame:
    """``(label, n)``; a class without rows is absent."""
    if target == "fault_active":
        keyed = rows.select(F.col("fault_active").cast("int").alias("label"))
        return keyed.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        raise ValueError("labels is required when target is 'fault_type'")
    # counted by name first, so the label join sees one row per class
    by_name = (faulted_only(rows).groupBy("fault_type").agg(F.count(F.lit(1)).alias("n")))
    return encode_labels(by_name, labels).select("label", "n")


def _weights(counts: DataFrame, labels: DataFrame, weight: Column) -> DataFrame:
    classes = labels.select("label").distinct()
    filled = (classes.join(counts, "label", "left")
              .withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))
    totals = filled.agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_k"))
    return (filled.crossJoin(F.broadcast(totals)).withColumn("weight", weight)
            .select("label", "n", "weight"))


def balanced_weights(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """``total / (k * n)``; a class without rows gets 1."""
    weight = F.col("_total") / F.nullif(F.col("_k") * F.col("n"), F.lit(0).cast("long"))
    return _weights(counts, labels, F.coalesce(weight, F.lit(1.0)))


def sequence_weights(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """``total / (k * max(n, 1))``."""
    return _weights(counts, labels,
                    F.col("_total") / (F.col("_k") * F.greatest(F.col("n"), F.lit(1))))
