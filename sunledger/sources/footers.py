"""What the footers of Parquet run files say, read in parallel and without any data page.

A footer holds the number of rows and, per row group and column, counts, minimum and maximum.
It can prove that a column varies; where it cannot prove more (statistics are missing, texts
may be cut short, floats may hide NaN), the caller scans that column alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sunledger.operators import stats
from sunledger.session import settle

#: texts of this length may have been cut by the writer
CUT_TEXT = 64
#: whole numbers beyond this are not told apart as doubles
EXACT = 1 << 53

FOOTER = ("path string, n_rows long, n_groups long, column string, n_values long, n_nulls long, "
          "low double, high double, low_text string, high_text string")
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def open_footer(path: str) -> pq.FileMetaData | None:
    """The footer of one file; None where its file system cannot be opened from Python.

    None is no result: callers leave the file to a scan by Spark.
    """
    try:
        if path.startswith("file:"):
            system, inner = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        else:
            system, inner = fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    with system.open_input_file(inner) as file:
        return pq.read_metadata(file)


def _number(value) -> float | None:
    if isinstance(value, (bool, int, float)):
        return float(value)
    return None


def _column(meta: pq.FileMetaData, at: int) -> tuple:
    """Counts and bounds of one column over all row groups; None for what is not known."""
    values = nulls = 0
    bounds: list[tuple] = []
    for group in range(meta.num_row_groups):
        chunk = meta.row_group(group).column(at)
        stats = chunk.statistics
        if stats is None or not stats.has_null_count:
            return None, None, None, None, None, None
        rows = meta.row_group(group).num_rows
        values, nulls = values + rows - stats.null_count, nulls + stats.null_count
        if rows > stats.null_count:
            bounds.append((stats.min, stats.max) if stats.has_min_max else (None, None))
    lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]
    for pick in (_number, lambda v: v if isinstance(v, str) else None):
        if bounds and all(pick(v) is not None for v in (*lows, *highs)):
            low, high = min(map(pick, lows)), max(map(pick, highs))
            return ((values, nulls, low, high, None, None) if isinstance(low, float)
                    else (values, nulls, None, None, low, high))
    return values, nulls, None, None, None, None


def read_footers(files: DataFrame, per_task: int = 256) -> DataFrame:
    """One row per file and top-level column of ``files`` (a column ``path``).

    ``n_values`` and ``n_nulls`` are NULL where a row group lacks counts, the bounds where one
    lacks them.  A file without columns, or one that Python cannot open, has one row with a
    NULL column; the latter has no ``n_rows``.  A footer is read where Spark sends its path.
    """
    listed = files.select("path")
    spread = max(1, -(-listed.count() // per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch["path"].to_pylist():
                meta = open_footer(path)
                if meta is None:
                    rows.append((path, None, None, *[None] * 7))
                    continue
                head = (path, meta.num_rows, meta.num_row_groups)
                flat = [(meta.schema.column(i), i) for i in range(len(meta.schema))]
                found = [(*head, c.name, *_column(meta, i)) for c, i in flat if c.path == c.name]
                rows += found or [(*head, *[None] * 7)]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(_ARROW.names, r)) for r in rows], schema=_ARROW)

    return listed.repartition(spread).mapInArrow(run, FOOTER)


_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in
                    (f.split() for f in FOOTER.split(", "))])


def row_counts(footers: DataFrame, name: Column | None = None,
               scan: Callable[[], DataFrame] | None = None) -> DataFrame:
    """``(source_file, n_rows)`` of every file that was opened.

    With ``scan``, which gives the plain scan of the same files, it is every file: Spark counts
    those that Python cannot open.  ``scan`` is called only if there are such files.
    """
    named = F.element_at(F.split("path", "/"), -1) if name is None else name
    counts = footers.groupBy("path").agg(F.max("n_rows").alias("n_rows"))
    if scan is not None:
        counts = settle(counts)
        if not counts.where(F.col("n_rows").isNull()).isEmpty():
            counts = _counted_by_scan(counts, scan())
    return (counts.where(F.col("n_rows").isNotNull())
            .select(named.alias("source_file"), "n_rows"))


def _counted_by_scan(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """``counts`` with the scanned number of rows where a footer was not read.

    A scan without columns reads footers alone.  A file that it does not name has no rows; one
    that only the scan names would be lost, so it is an error.
    """
    # the scan escapes paths, the listing does not; a plus stands for itself in a path
    escaped = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    found = rows.groupBy(F.url_decode(escaped).alias("path")).agg(
        F.count(F.lit(1)).alias("_scanned"))
    listed = counts.withColumn("_listed", F.lit(True))
    lost = F.raise_error(F.concat(F.lit("scanned but not listed: "), "path")).cast("long")
    return listed.join(found, "path", "full").select("path", F.when(
        F.col("_listed").isNull(), lost).otherwise(
        F.coalesce("n_rows", "_scanned", F.lit(0).cast("long"))).alias("n_rows"))


def column_bounds(footers: DataFrame, schema: T.StructType) -> dict[str, dict]:
    """Per column of ``schema``: rows of the batch, values, NULLs, and bounds over all files.

    A count or bound is None unless every file tells it; a file without the column counts as
    NULLs.  One row per schema column comes to the driver.  The footers are read once.
    """
    footers = settle(footers)
    files = footers.groupBy("path").agg(F.max("n_rows").alias("n")).agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n").isNull()).alias("closed")).first()
    held = F.coalesce("n_values", F.lit(0).cast("long")) > 0
    bounds = ("low", "high", "low_text", "high_text")
    told = footers.where(F.col("column").isin(schema.names)).groupBy("column").agg(
        F.count_if(F.col("n_values").isNull()).alias("unknown"), F.sum("n_rows").alias("rows"),
        F.sum("n_values").alias("values"), F.sum("n_nulls").alias("nulls"),
        *[(F.min if b.startswith("low") else F.max)(b).alias(b) for b in bounds],
        F.count_if(held & F.col("low").isNull()).alias("no_number"),
        F.count_if(held & F.col("low_text").isNull()).alias("no_text"))
    found = {r["column"]: r.asDict() for r in told.collect()}
    out = {}
    for field in schema.fields:
        known = found.get(field.name)
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        if files["closed"] or nested or (known and known["unknown"]):
            out[field.name] = dict.fromkeys(("values", "nulls", *bounds))
            continue
        known = known or {"values": 0, "nulls": 0, "rows": 0, "no_number": 0, "no_text": 0}
        row = {"values": known["values"], "nulls": (files["rows"] or 0) - known["values"]}
        for b in bounds:
            missing = known["no_text" if b.endswith("text") else "no_number"]
            row[b] = None if missing else known.get(b)
        out[field.name] = row
    return out


def constant_by_footer(bounds: dict[str, dict], schema: T.StructType) -> tuple[list[str], list[str]]:
    """Columns that are certainly constant, and those the footers cannot decide.

    NULL counts as one value.  All other columns certainly vary.
    """
    certain, open_ones = [], []
    for field in schema.fields:
        b = bounds[field.name]
        if isinstance(field.dataType, T.MapType):
            continue
        if b["values"] is None:
            open_ones.append(field.name)
        elif b["values"] == 0:
            certain.append(field.name)
        elif b["nulls"] > 0:
            continue
        elif b["low"] is not None:
            exact = isinstance(field.dataType, _WHOLE) and max(abs(b["low"]), abs(b["high"])) < EXACT
            if b["low"] == b["high"]:
                (certain if exact else open_ones).append(field.name)
        elif b["low_text"] is None or b["low_text"] == b["high_text"] or max(
                len(b[k].encode()) for k in ("low_text", "high_text")) >= CUT_TEXT:
            open_ones.append(field.name)
    return certain, open_ones


def highest(bounds: dict[str, dict], name: str) -> float | None:
    """The largest value of a numeric column, if the footers of all files tell it."""
    return bounds[name]["high"] if name in bounds else None


def constant_columns(files: DataFrame, rows: DataFrame, schema: T.StructType,
                     bounds: dict[str, dict] | None = None) -> DataFrame:
    """The ``(column)`` names with at most one value: by footers, and by a scan of those
    columns alone that the footers leave open.

    ``rows`` are the files' rows as the scan gives them (NaN read as NULL).
    """
    certain, open_ones = constant_by_footer(bounds or column_bounds(read_footers(files), schema),
                                            schema)
    spark = rows.sparkSession
    sure = spark.createDataFrame([(c,) for c in certain], "column string")
    return sure.unionByName(stats.constant_columns(rows, open_ones)) if open_ones else sure
