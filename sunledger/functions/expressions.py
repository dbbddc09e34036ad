"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(value: Column, low: float, high: float, default: float) -> Column:
    """Fill, then clip, then narrow to float."""
    filled = F.coalesce(value.cast("double"), F.lit(float(default)))
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), filled)).cast("float")


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL on a zero denominator instead of an ANSI error."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def cyclic(value: Column, period: float, function) -> Column:
    return function(F.lit(2.0) * F.pi() * value / F.lit(float(period))).cast("float")


def seeded_digest(seed: int, *keys: str) -> Column:
    """Repeatable random order: md5 of the seed and the row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.parquet$", "")


def parse_file_fault_type(name: Column) -> Column:
    """Fault type encoded in a run file's name."""
    # each suffix is stripped once, noisy first
    scenario = F.regexp_replace(F.regexp_replace(file_stem(name), "_noisy$", ""), "_clean$", "")
    after = F.split_part(scenario, F.lit("_fault_"), F.lit(2))
    cut = (F.when(after.contains("_af"), F.substring_index(after, "_af", 1))
           .when(after.contains("_aging"), F.substring_index(after, "_aging", 1))
           .otherwise(after))
    return (F.when(scenario.contains("_fault_"), cut)
            .when(scenario.contains("_combo"), F.lit("combo"))
            .otherwise(F.lit("none")))


def parse_run_id(name: Column) -> Column:
    return F.substring_index(file_stem(name), "_", 1)


def loc_id(latitude: Column, longitude: Column) -> Column:
    return F.concat_ws("_", F.round(latitude, 2).cast("string"),
                       F.round(longitude, 2).cast("string"))


def clean_number(name: str) -> Column:
    """NULL, NaN and both infinities of a column become 0."""
    x = f"CAST(`{name}` AS FLOAT)"
    return F.expr(f"CAST(IF({x} IS NULL OR isnan({x}) OR abs({x}) = float('inf'), 0, {x}) "
                  "AS FLOAT)")
