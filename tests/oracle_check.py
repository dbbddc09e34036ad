"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py [sf] [name...]``."""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
import pandas as pd

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if frame[name].dtype.kind == "M":
            frame[name] = frame[name].astype("datetime64[us]")
        if isinstance(frame[name].dtype, pd.Int64Dtype) and frame[name].isna().any():
            frame[name] = frame[name].astype("float64")  # as Spark hands over NULL integers
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when the frames hold the same rows, else what differs first."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    left, right = canonical(left), canonical(right)
    for name in left.columns:
        if left[name].dtype != right[name].dtype and {
                left[name].dtype.kind, right[name].dtype.kind} - {"O", "U", "T"}:
            return f"{name}: type {left[name].dtype} != {right[name].dtype}"
        a, b = left[name], right[name]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = int((~same).to_numpy().argmax())
            return f"{name}: {int((~same).sum())} values, first {a[at]!r} != {b[at]!r}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from sunledger.session import build_session

    scale = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    spark = build_session(master="local[8]", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__sql__shuffle__partitions="8",
                          spark__ui__showConsoleProgress="false")
    con = connect(sf_dir)
    sql, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s\n{got.head(6)}", flush=True)
                continue
            problem = difference(got, con.execute(sql[name]).df())
        except Exception as error:  # noqa: BLE001
            problem, took, got = str(error).split("\n")[0][:600], time.time() - start, ()
        print(f"{'FAIL' if problem else 'ok'}  {name}: {problem or len(got)} {took:.1f}s",
              flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
