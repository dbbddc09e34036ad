"""Model quality from a prediction table ``(model, y_true, y_pred, prob)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sunledger.operators.skew import broadcast_checked, prefix_sum
from sunledger.session import settle


def _safe(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0).cast("double")), F.lit(0.0))


def pair_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Counts of actual by predicted over the labels present per model, zeros kept."""
    pairs = pair_counts(predictions)
    present = (pairs.select("model", F.explode(F.array("y_true", "y_pred")).alias("label"))
               .distinct())
    # labels x labels per model: the class vocabulary, not data rows
    grid = (present.withColumnRenamed("label", "y_true")
            .join(present.withColumnRenamed("label", "y_pred"), "model"))
    return (grid.join(pairs, ["model", "y_true", "y_pred"], "left")
            .select("model", "y_true", "y_pred", F.coalesce("n", F.lit(0).cast("long")).alias("n")))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def classification_report(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class of the full vocabulary, then accuracy, macro and weighted averages.

    ``classes`` has (label, class_name).  0/0 counts as 0.  Everything after the first
    aggregate works on class counts.
    """
    pairs = settle(pair_counts(predictions))  # read by every part of the report
    sides = pairs.select("model", "n", F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.lit(1).alias("actual"), F.lit(0).alias("said")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("actual"), F.lit(1).alias("said"))
    )).alias("_s"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("_ok"))
    tally = sides.groupBy("model", F.col("_s.label").alias("label")).agg(
        F.sum(F.col("n") * F.col("_s.actual")).alias("support"),
        F.sum(F.col("n") * F.col("_s.said")).alias("_said"),
        F.sum(F.col("n") * F.col("_s.actual") * F.col("_ok")).alias("_hit"))
    grid = tally.select("model").distinct().crossJoin(broadcast_checked(classes))
    filled = (grid.join(tally, ["model", "label"], "left")
              .na.fill(0, ["support", "_said", "_hit"]))
    hit, said, support = (F.col(c).cast("double") for c in ("_hit", "_said", "support"))
    rated = filled.withColumns({"precision": _safe(hit, said), "recall": _safe(hit, support)})
    p, r = F.col("precision"), F.col("recall")
    rated = rated.withColumn("f1", _safe(F.lit(2.0) * p * r, p + r))
    columns = ["model", "class_name", "precision", "recall", "f1", "support"]

    rates = ("precision", "recall", "f1")
    macro = rated.groupBy("model").agg(*[F.avg(c).alias(c) for c in rates],
                                       F.sum("support").alias("support"))
    weighted = rated.groupBy("model").agg(
        *[_safe(F.sum(F.col(c) * support), F.sum(support)).alias(c) for c in rates],
        F.sum("support").alias("support"))
    overall = pairs.groupBy("model").agg(
        (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
         / F.sum("n")).alias("precision"), F.sum("n").alias("support"))
    overall = overall.withColumns({"recall": F.col("precision"), "f1": F.col("precision")})
    out = rated.select(*columns)
    for name, part in (("accuracy", overall), ("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(part.withColumn("class_name", F.lit(name)).select(*columns))
    return out


def ranked_auc(scored: DataFrame, group: Sequence[str],
               rows_per_slice: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per group from ``(group, score, positive)``.

    Rows are first reduced to distinct scores; ties count half.  NULL when a group holds
    only one class.
    """
    group = list(group)
    # group sizes and running totals both read it
    by_score = settle(scored.groupBy(*group, "score").agg(
        F.count_if("positive").alias("_pos"), F.count_if(~F.col("positive")).alias("_neg")))
    running = prefix_sum(by_score, group, ["score"], F.col("score"), "_neg", "_below",
                         rows_per_slice)
    below = F.col("_below") - F.col("_neg") + F.col("_neg") / F.lit(2.0)
    sums = running.groupBy(*group).agg(
        F.sum(F.col("_pos") * below).alias("_wins"), F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"))
    both = F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return sums.select(*group, (F.col("_wins") / both).alias("auc"), "n_pos", "n_neg")


def roc_auc_binary(predictions: DataFrame, rows_per_slice: int | None = None) -> DataFrame:
    scored = predictions.select("model", F.element_at("prob", 2).alias("score"),
                                (F.col("y_true") == 1).alias("positive"))
    return ranked_auc(scored, ["model"], rows_per_slice).select("model", "auc")


def roc_auc_ovr_weighted(predictions: DataFrame,
                         rows_per_slice: int | None = None) -> DataFrame:
    """One-vs-rest AUC weighted by prevalence; NULL if any class is undefined."""
    long = predictions.select("model", "y_true", F.posexplode("prob").alias("label", "score"))
    scored = long.select("model", "label", "score",
                         (F.col("y_true") == F.col("label")).alias("positive"))
    per_class = ranked_auc(scored, ["model", "label"], rows_per_slice)
    undefined = F.count_if(F.col("auc").isNull())
    weighted = F.sum(F.col("auc") * F.col("n_pos")) / F.nullif(F.sum("n_pos"), F.lit(0).cast("long"))
    return per_class.groupBy("model").agg(F.when(undefined == 0, weighted).alias("auc"))


def merge_reports(report: DataFrame, classes: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per class with F1, precision and recall of every model side by side."""
    only = report.join(broadcast_checked(classes.select("class_name")), "class_name", "left_semi")
    pivoted = (only.groupBy(F.col("class_name").alias("fault_type")).pivot("model", list(models))
               .agg(F.first("f1").alias("f1"), F.first("precision").alias("precision"),
                    F.first("recall").alias("recall")))
    return pivoted


def rank_models(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("auc"), "model")


def feature_group(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach each feature's category; unlisted features count as SCADA."""
    return (scores.join(broadcast_checked(groups), "feature", "left")
            .withColumn("feature_group", F.coalesce("feature_group", F.lit("scada"))))


def top_features(scores: DataFrame, score: str, n: int | None = 20) -> DataFrame:
    """Strongest features first; ``n=None`` ranks all of them."""
    ranked = scores.orderBy(F.desc(score), "feature")
    return ranked if n is None else ranked.limit(n)


def importance_top(importances: DataFrame, groups: DataFrame,
                   n: int | None = None) -> DataFrame:
    return top_features(feature_group(importances, groups), "importance", n)


def attribution_summary(attribution: DataFrame, n: int | None = None) -> DataFrame:
    """Mean absolute attribution and the sign of the mean, strongest features first."""
    summary = attribution.groupBy("feature").agg(
        F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean_signed"))
    signed = summary.withColumn(
        "direction", F.when(F.col("mean_signed") >= 0, "fault").otherwise("healthy"))
    return top_features(signed, "mean_abs", n)
