"""Reading a batch of run files, and the same schema derived from the ``events`` table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: fixed values: the scenario part of an adapted file name, by ``user_id % 6``
SCENARIO_SUFFIX = (
    "_baseline_noisy.parquet", "_fault_click_af1_noisy.parquet",
    "_fault_error_aging2_noisy.parquet", "_fault_signup_noisy.parquet",
    "_fault_purchase_af3_noisy.parquet", "_combo_x_noisy.parquet",
)
#: fixed values: DC/AC gain by event type, the planted signal
DC_GAIN = {"error": 1.6, "click": 1.3, "purchase": 1.15, "signup": 1.05}

EVENTS = ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
          "props string")


def telemetry(spark: SparkSession, sf_dir: str, extended: bool = False) -> DataFrame:
    """The run-file schema over the driver's ``events`` table (one user = one run file)."""
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    k = F.col("_k")
    suffix = F.element_at(F.array(*[F.lit(s) for s in SCENARIO_SUFFIX]),
                          (F.col("user_id") % 6 + 1).cast("int"))
    gain = F.lit(1.0)
    for kind, factor in DC_GAIN.items():
        gain = F.when(F.col("event_type") == kind, F.lit(factor)).otherwise(gain)

    columns = [
        F.col("event_id"),
        F.col("user_id").alias("unit_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 5, "0"), suffix)
        .alias("source_file"),
        (F.lit(1) + F.floor((F.dayofmonth("ts") - 1) / 10.0).cast("int")).alias("sim_year"),
        F.dayofmonth("ts").alias("sim_day"),
        (F.lit(30.0) + F.lit(2.5) * (F.col("user_id") % 5)).alias("latitude"),
        (F.lit(-100.0) + F.lit(10.0) * (F.col("user_id") % 5)).alias("longitude"),
        F.when(F.col("event_type") == "view", F.lit("none"))
        .otherwise(F.col("event_type")).alias("fault_type"),
        (F.col("event_type") != "view").alias("fault_active"),
        (F.lit(10.0) * k).cast("float").alias("poa_global_wm2"),
        F.col("value").cast("float").alias("ac_power_kw"),
        (F.col("value") * gain + (k % 7) * F.lit(0.01)).cast("float").alias("dc_power_kw"),
    ]
    if extended:
        event = F.col("event_id")
        columns += [
            (F.lit(15.0) + (event % 200) * F.lit(0.1)).cast("float").alias("ambient_temp_c"),
            (F.lit(20.0) + k * F.lit(0.3)).cast("float").alias("cell_temp_c"),
            ((event % 13) * F.lit(0.5)).cast("float").alias("wind_speed_ms"),
            F.lit(0.0).cast("float").alias("dhi_wm2"),
            (F.lit(30.0) + (k % 11) * F.lit(0.2)).cast("float").alias("voc_v"),
            (k / F.lit(50.0)).cast("float").alias("stress_heat"),
            (F.lit(1.0) - F.col("user_id") * F.lit(0.0001)).cast("float").alias("aging_factor"),
            F.col("value").cast("float").alias("ac_power_true"),
            (event % 3).cast("float").alias("mystery_reading"),
        ]
    return (events.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
            .select(*columns))


# --- a directory of run files -------------------------------------------------------

def list_files(spark: SparkSession, data_dir: str, pattern: str = "*.parquet") -> DataFrame:
    """``(path, source_file, bytes)`` of the matching files; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(data_dir)
            .select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"),
                    F.col("length").alias("bytes")))


RUN_PATTERNS = ("*_noisy.parquet", "*_clean.parquet")


def list_batch_files(spark: SparkSession, data_dir: str,
                     location_filter: str | None = None) -> DataFrame:
    """The noisy files of a batch, else the clean ones; neither is an error."""
    files = list_files(spark, data_dir, batch_pattern(spark, data_dir))
    return files.where(F.col("source_file").contains(location_filter)) if location_filter else files


def batch_pattern(spark: SparkSession, data_dir: str,
                  patterns: Sequence[str] = RUN_PATTERNS) -> str:
    """The first file pattern that matches anything."""
    for pattern in patterns:
        if list_files(spark, data_dir, pattern).limit(1).count():
            return pattern
    raise FileNotFoundError(f"No parquet files in {data_dir}")


def schema_file(spark: SparkSession, data_dir: str) -> DataFrame:
    """The one file that decides the schema: first by name, fault-free names first."""
    pattern = batch_pattern(spark, data_dir, (*RUN_PATTERNS, "*.parquet"))
    return pick_schema_file(list_files(spark, data_dir, pattern))


def pick_schema_file(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("source_file").contains("fault"), "source_file").limit(1)


def scan_batch(spark: SparkSession, data_dir: str, columns: Sequence[str] | None = None,
               years: Sequence[int] | None = None, pattern: str = "*_noisy.parquet",
               location_filter: str | None = None,
               schema: T.StructType | None = None,
               files: Sequence[str] | None = None) -> DataFrame:
    """All run files of a batch as one pruned scan, keyed by ``source_file``.

    ``row_index`` is the position in the file, the order the rolling features follow.  A
    given ``schema`` holds for every file: columns a file lacks are NULL.  Given names of
    ``files``, the others are not opened.
    """
    reader = spark.read.option("pathGlobFilter", pattern)
    frame = (reader.schema(schema) if schema else reader).parquet(data_dir)
    if files is not None:
        frame = frame.where(F.col("_metadata.file_name").isin(list(files)))
    wanted = [c for c in (columns or frame.columns) if c in frame.columns]
    if years and "sim_year" not in wanted and "sim_year" in frame.columns:
        wanted.append("sim_year")
    frame = frame.select(*wanted, F.col("_metadata.file_name").alias("source_file"),
                         F.col("_metadata.row_index").alias("row_index"))
    if location_filter:
        frame = frame.where(F.col("source_file").contains(location_filter))
    return downcast(wall_clock(year_filter(frame, years)))


def wall_clock(df: DataFrame, name: str = "timestamp") -> DataFrame:
    """Timestamps written as nanoseconds or as text, read as wall-clock times."""
    if name not in df.columns:
        return df
    kind = df.schema[name].dataType
    if isinstance(kind, T.LongType):
        micros = F.timestamp_micros(F.expr(f"`{name}` div 1000"))
        return df.withColumn(name, micros.cast("timestamp_ntz"))
    if isinstance(kind, (T.StringType, T.TimestampType)):
        return df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


def year_filter(df: DataFrame, years: Sequence[int] | None) -> DataFrame:
    return df.where(F.col("sim_year").isin(list(years))) if years else df


def downcast(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Doubles become floats, and NaN becomes NULL so that comparisons drop it."""
    def shrink(field: T.StructField) -> Column:
        column = F.col(field.name)
        if field.name in keep:
            return column
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            single = column.cast("float")
            return F.when(~F.isnan(single), single).alias(field.name)
        return column
    return df.select(*[shrink(f) for f in df.schema.fields])


def file_order(df: DataFrame) -> list[str]:
    """Columns giving the row order inside one run file."""
    if "row_index" in df.columns:
        return ["row_index"]
    return ["timestamp", "event_id"] if "event_id" in df.columns else ["timestamp"]


def time_order(df: DataFrame) -> list[str]:
    """Columns giving the time order inside one run file, made total by a tie-breaker."""
    ties = [c for c in ("event_id", "row_index") if c in df.columns]
    return ["timestamp", *ties]


def row_key(df: DataFrame) -> list[str]:
    """Columns that identify one row, used for repeatable random order."""
    return ["event_id"] if "event_id" in df.columns else ["source_file", *file_order(df)]
