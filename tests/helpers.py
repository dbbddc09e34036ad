"""Fixtures built by hand and brute-force answers in pandas and numpy."""

import datetime as dt
import math

import numpy as np
import pandas as pd

START = dt.datetime(2024, 1, 1)
RUN_SCHEMA = ("source_file string, event_id long, timestamp timestamp_ntz, sim_year int, "
              "sim_day int, fault_active boolean, fault_type string, poa_global_wm2 float, "
              "ac_power_kw float, dc_power_kw float")


def run_rows(name, n, seed, first_id, minutes=5):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        at = START + dt.timedelta(minutes=minutes * i)
        ac = float(np.float32(rng.uniform(0, 400)))
        faulty = bool(rng.random() < 0.6)
        out.append((name, first_id + i, at, 1 + i % 3, 1 + i // 20, faulty,
                    ["click", "error", "signup"][int(rng.integers(3))] if faulty else "none",
                    float(np.float32(rng.uniform(0, 1000))), ac,
                    float(np.float32(ac * rng.uniform(1, 2)))))
    return out


def skewed_runs(spark, hot=300, others=(7, 1, 2, 3, 13, 60, 90, 120)):
    """One run with about half of all rows next to short ones; rows are shuffled."""
    rows, at = run_rows("hot_noisy.parquet", hot, 1, 0), hot
    for i, n in enumerate(others):
        rows += run_rows(f"r{i}_noisy.parquet", n, i + 2, at)
        at += n
    np.random.default_rng(0).shuffle(rows)
    rows = [(r[0], int(r[1]), r[2], int(r[3]), int(r[4]), r[5], r[6], float(r[7]), float(r[8]),
             float(r[9])) for r in rows]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def pandas_features(frame, kwp, lookback):
    """The feature formulas over one frame of rows, file by file."""
    out = []
    for _, run in frame.groupby("source_file"):
        run = run.sort_values(["timestamp", "event_id"])
        run = run[run.poa_global_wm2 > 10].copy()
        f32 = np.float32
        sun = (run.poa_global_wm2.astype(f32) / f32(1000)).astype(f32).replace(0, np.nan)
        pr = ((run.ac_power_kw.astype(f32) / f32(kwp)) / sun).fillna(0).clip(-1, 2).astype(f32)
        run["performance_ratio"] = pr
        mean = pr.astype(float).rolling(lookback, min_periods=max(1, lookback // 4)).mean()
        run["pr_deviation"] = (pr.astype(float) / mean.replace(0, np.nan)).fillna(1).clip(
            0, 3).astype(f32)
        step = pr.diff().abs().rolling(lookback, min_periods=1).max()
        run["power_step"] = step.fillna(0).clip(0, 2).astype(f32)
        ac = run.ac_power_kw.astype(f32).replace(0, np.nan)
        run["dc_ac_power_ratio"] = (run.dc_power_kw.astype(f32) / ac).fillna(1).clip(
            0, 5).astype(f32)
        out.append(run)
    return pd.concat(out).sort_values("event_id").reset_index(drop=True)


def brute_auc(score, positive):
    score, positive = np.asarray(score), np.asarray(positive, dtype=bool)
    pos, neg = score[positive], score[~positive]
    if not len(pos) or not len(neg):
        return None
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    return wins / (len(pos) * len(neg))


def close(a, b, digits=9):
    return (a is None and b is None) or math.isclose(a, b, abs_tol=10 ** -digits)
