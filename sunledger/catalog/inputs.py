"""What the registered queries start from: tables derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.operators.features import add_features, daytime_filter
from sunledger.operators.registry import assign_splits, file_registry, file_sites
from sunledger.operators.sampling import encode_labels, faulted_only, label_table
from sunledger.operators.stats import unpivot
from sunledger.session import configure, settle
from sunledger.sources.telemetry import DC_GAIN, telemetry

KWP = 490.0
WINDOW, STRIDE = 12, 5
THIN = 4
CAP = 5000
MAX_RUNS = 8
FILES_PER_BATCH = 4
SCADA_COLUMNS = ("poa_global_wm2", "ac_power_kw", "dc_power_kw", "ambient_temp_c",
                 "cell_temp_c", "wind_speed_ms")


def rows(spark: SparkSession, sf_dir: str, extended: bool = False) -> DataFrame:
    return telemetry(configure(spark), sf_dir, extended)


def features(spark: SparkSession, sf_dir: str, extended: bool = False) -> DataFrame:
    return add_features(rows(spark, sf_dir, extended), KWP)


def settled_features(spark: SparkSession, sf_dir: str, extended: bool = False) -> DataFrame:
    """Features on storage, for jobs that read them more than once."""
    return settle(features(spark, sf_dir, extended))


def plain_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_registry(rows(spark, sf_dir))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(plain_registry(spark, sf_dir))


def schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the file that decides the schema: first by name, fault-free first."""
    table = rows(spark, sf_dir, extended=True)
    name = F.col("source_file")
    first = (table.select("source_file").distinct()
             .orderBy(name.contains("fault"), name).limit(1))
    return table.join(F.broadcast(first), "source_file", "left_semi").select(*table.columns)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_sites(rows(spark, sf_dir))


def partial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label table that lacks some row-level types: those named in ``_af`` files."""
    files = plain_registry(spark, sf_dir).where(F.col("source_file").contains("_af"))
    return files.select(F.col("file_fault_type").alias("fault_type")).distinct()


def named_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site list that is exact for some coordinates and 0.04 degrees off for others."""
    found = sites(spark, sf_dir).select("loc_id").distinct()
    lat = F.split_part("loc_id", F.lit("_"), F.lit(1)).cast("double")
    lon = F.split_part("loc_id", F.lit("_"), F.lit(2)).cast("double")
    near = found.where(lat < 37.0).select(
        F.round(lat + F.when(lat > 34.0, F.lit(0.04)).otherwise(F.lit(0.0)), 2).alias("site_lat"),
        F.round(lon, 2).alias("site_lon"), F.concat(F.lit("site "), "loc_id").alias("site_name"))
    return near.select(F.col("site_name").alias("site_no"), "site_lat", "site_lon", "site_name")


# --- prediction tables ---------------------------------------------------------------------

def _power_ratio():
    dc, ac = F.col("dc_power_kw").cast("double"), F.col("ac_power_kw").cast("double")
    return F.coalesce(dc / F.nullif(ac, F.lit(0.0)), F.lit(1.0))


def detection_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores for ``fault_active`` over all daytime rows."""
    day = daytime_filter(rows(spark, sf_dir))
    ratio_score = F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), (_power_ratio() - F.lit(0.9)) / F.lit(0.8)))
    sun_score = F.col("poa_global_wm2").cast("double") / F.lit(1000.0)
    models = F.explode(F.array(
        F.struct(F.lit("ratio").alias("model"), ratio_score.alias("p")),
        F.struct(F.lit("sun").alias("model"), sun_score.alias("p"))))
    return (day.select(F.col("event_id").alias("row_id"), "fault_active", models.alias("_m"))
            .select("row_id", "_m.model", F.col("fault_active").cast("int").alias("y_true"),
                    (F.col("_m.p") >= 0.5).cast("int").alias("y_pred"),
                    F.array(F.lit(1.0) - F.col("_m.p"), F.col("_m.p")).alias("prob")))


def classification_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores for ``fault_type`` over all faulted daytime rows."""
    table = daytime_filter(rows(spark, sf_dir))
    coded = encode_labels(faulted_only(table), label_table(table))
    kinds = sorted(DC_GAIN)
    out = []
    for model, shift in (("near", F.lit(0.0)),
                         ("drift", F.col("poa_global_wm2").cast("double") / F.lit(5000.0))):
        raw = [F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * F.abs(
            _power_ratio() + shift - F.lit(DC_GAIN[k]))) for k in kinds]
        out.append(F.struct(F.lit(model).alias("model"), F.array(*raw).alias("raw")))
    spread = coded.select(F.col("event_id").alias("row_id"), F.col("label").alias("y_true"),
                          F.explode(F.array(*out)).alias("_m"))
    total = F.element_at("raw", 1)
    for i in range(2, len(kinds) + 1):
        total = total + F.element_at("raw", i)
    return (spread.select("row_id", "_m.model", "y_true", "_m.raw")
            .withColumn("_total", total)
            .select("row_id", "model", "y_true",
                    (F.array_position("raw", F.array_max("raw")) - 1).cast("int").alias("y_pred"),
                    F.array(*[F.element_at("raw", i) / F.col("_total")
                              for i in range(1, len(kinds) + 1)]).alias("prob")))


def detection_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "Healthy"), (1, "Faulted")], "label int, class_name string")


def fault_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fault vocabulary plus one class that never occurs."""
    table = daytime_filter(rows(spark, sf_dir))
    absent = spark.createDataFrame([(9, "offline")], "label int, class_name string")
    return label_table(table).select("label", F.col("fault_type").alias("class_name")).union(absent)


def attribution(spark: SparkSession, sf_dir: str, names) -> DataFrame:
    """A long attribution table: the distance of each feature from one half."""
    long = unpivot(features(spark, sf_dir), names, "event_id")
    return long.select(F.col("event_id").alias("sample_id"), "feature",
                       (F.col("value") - F.lit(0.5)).alias("value"))
