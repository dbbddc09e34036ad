"""Which telemetry columns may be features: default-deny classification."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sunledger.operators.features import ENGINEERED

# fixed values: column names and prefixes of the run-file schema
META = ("timestamp", "sim_day", "sim_year", "latitude", "longitude", "tilt_deg",
        "azimuth_deg", "dc_ac_ratio", "run_id")
LABEL_PREFIX = "fault_"
COMBO_PREFIX = "combo_"
STRESS_PREFIX = "stress_"
TRUE_SUFFIX = "_true"
NOISE = ("noise_applied", "is_dropout", "timestamp_true")
SCADA = ("poa_global_wm2", "ghi_wm2", "dni_wm2", "dhi_wm2", "ambient_temp_c", "cell_temp_c",
         "wind_speed_ms", "precipitation_mm", "dc_power_kw", "ac_power_kw",
         "solar_elevation_deg", "aoi_deg") + ENGINEERED
IV_CURVE = ("voc_v", "jsc_a_m2", "ff", "vmpp_v", "jmpp_a_m2", "efficiency_pct")
THEORETICAL = ("detailed_balance_efficiency_pct",)
SIMULATOR = ("soiling_factor", "aoi_correction_factor", "spectral_factor", "shading_factor",
             "inverter_efficiency", "inverter_loss_kw", "inverter_derating_factor",
             "snow_loss_factor", "mismatch_loss_factor", "dc_wiring_loss_factor",
             "ac_wiring_loss_factor", "availability_factor", "lid_factor", "bifacial_gain",
             "aging_factor", "vulnerability")

FEATURE_CATEGORIES = ("scada", "iv_curve", "stress")
MODES = {"scada": ("scada",), "scada+stress": ("scada", "stress"),
         "scada+iv_curve": ("scada", "iv_curve"), "scada+device": ("scada", "iv_curve"),
         "full": ("scada", "stress", "iv_curve")}
#: names of the sets the ablation study compares
ABLATION_SETS = {"SCADA only": "scada", "SCADA + stress": "scada+stress",
                 "SCADA + IV curve": "scada+iv_curve", "Full": "full"}


def category(name: Column, constant: Column) -> Column:
    """One category per column name; ``constant`` marks columns without variation."""
    return (F.when(name.isin(*META), "meta")
            .when(name.startswith(LABEL_PREFIX), "label")
            .when(name.startswith(COMBO_PREFIX), "combo")
            .when(name.isin(*NOISE) | name.endswith(TRUE_SUFFIX), "noise")
            .when(name.isin(*THEORETICAL), "theoretical")
            .when(name.isin(*SIMULATOR), "simulator_internal")
            .when(constant, "constant")
            .when(name.startswith(STRESS_PREFIX), "stress")
            .when(name.isin(*SCADA), "scada")
            .when(name.isin(*IV_CURVE), "iv_curve")
            .otherwise("uncategorized"))


def classify_columns(rows: DataFrame, constants: DataFrame) -> DataFrame:
    """``(column, category, included)`` for every column of ``rows``.

    ``constants`` has the names of columns without variation.
    """
    # one row per column of the schema
    names = F.explode(F.array(*[F.lit(c) for c in rows.columns])).alias("column")
    table = rows.sparkSession.range(1).select(names)
    flat = F.broadcast(constants.select("column", F.lit(True).alias("_constant")))
    kind = category(F.col("column"), F.coalesce("_constant", F.lit(False)))
    return (table.join(flat, "column", "left").withColumn("category", kind)
            .select("column", "category",
                    F.col("category").isin(*FEATURE_CATEGORIES).alias("included")))


def load_columns(classified: DataFrame) -> DataFrame:
    """Columns a scan needs: features, metadata and labels."""
    return classified.where(F.col("included") | F.col("category").isin("meta", "label")).select(
        "column")


def feature_groups(classified: DataFrame) -> DataFrame:
    return (classified.where("included")
            .select(F.col("column").alias("feature"), F.col("category").alias("feature_group")))


def category_lists(classified: DataFrame) -> dict[str, list[str]]:
    """Column names by category, sorted (one row per schema column)."""
    lists: dict[str, list[str]] = {}
    for row in classified.orderBy("column").collect():
        lists.setdefault(row["category"], []).append(row["column"])
    return lists


def feature_set(lists: dict[str, list[str]], mode: str = "full") -> list[str]:
    """Ordered feature names of a mode; an unknown mode means the full set."""
    names = list(lists.get("scada", ())) + list(ENGINEERED)
    for kind in MODES.get(mode, MODES["full"])[1:]:
        names += lists.get(kind, ())
    return list(dict.fromkeys(names))


def feature_set_table(rows: DataFrame, constants: DataFrame,
                      modes: Iterable[str] = tuple(MODES)) -> DataFrame:
    """``(mode, feature, position)`` of the named feature sets."""
    lists = category_lists(classify_columns(rows, constants))
    table = [(m, f, i) for m in modes for i, f in enumerate(feature_set(lists, m))]
    return rows.sparkSession.createDataFrame(table, "mode string, feature string, position int")


def column_sets(left: Sequence[str], right: Sequence[str], spark) -> DataFrame:
    """Union, intersection and difference of two name lists as one row of arrays."""
    a, b = (F.array(*[F.lit(c) for c in names]) for names in (left, right))
    return spark.range(1).select(F.array_union(a, b).alias("either"),
                                 F.array_intersect(a, b).alias("both"),
                                 F.array_except(a, b).alias("left_only"))
