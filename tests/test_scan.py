"""Two-level scans and blocked lag correlations against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kilnworks.operators import scan, stats
from pyspark.sql import functions as F

rng = random.Random(2)
PLACES = sorted(rng.sample(range(-300, 900), 500)) + [901, 902, 903]


def series_of(spark, keys=("a", None)):
    rows = [(k, t, float((t * 37) % 101)) for k in keys for t in PLACES]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t long, v double").repartition(3)


@pytest.mark.parametrize("width", [7, 64, 100_000])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_scans_equal_a_loop(spark, width, keys):
    df = series_of(spark) if keys else series_of(spark, ("a",))
    rows = scan.segments(scan.row_numbers(df, "t", keys, total="n", width=width), 1, "t", keys, age="age", width=width)
    rows = scan.time_split(scan.running_max(rows, F.col("v"), "t", keys, width=width), (0.5, 0.25), "t", keys, width=width)
    assert set(rows.columns) == {"k", "t", "v", "place", "n", "segment", "age", "best", "part"}
    got = {(r["k"], r["t"]): (r["place"], r["n"], r["segment"], r["age"], r["best"], r["part"]) for r in rows.collect()}
    want, n = {}, len(PLACES)
    for k in ("a", None) if keys else ("a",):
        segment, age, best, last = 0, 0, -1.0, None
        for i, t in enumerate(PLACES):
            if last is None or t - last != 1:
                segment, age = segment + 1, -1
            age, last, best = age + 1, t, max(best, float((t * 37) % 101))
            want[k, t] = (i, n, segment, age, best, "train" if i < n // 2 else "validation" if i < int(n * 0.75) else "test")
    assert got == want


def test_scans_of_nothing(spark):
    empty = series_of(spark).limit(0)
    assert scan.segments(empty, 1, "t", age="age").count() == 0
    assert scan.time_split(empty, order="t").count() == 0


def test_only_totals_meet_in_one_task(spark):
    """Below every exchange into one partition stands an aggregate by blocks: rows never go there."""
    df = series_of(spark, ("a",))
    for made in (scan.segments(df, 1, "t", age="age"), scan.time_split(df, order="t"), scan.running_max(df, F.col("v"), "t")):
        lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
        at = [i for i, x in enumerate(lines) if "SinglePartition" in x]
        assert at
        for i in at:
            deeper = next(x for x in lines[i + 1 :] if "Project" not in x)
            assert "HashAggregate" in deeper and "_block" in deeper


def plain_lags(x, y, segment, lags):
    out = {}
    for k in lags:
        pairs = [(x[t - k], y[t]) for t in range(len(y)) if 0 <= t - k < len(y) and segment[t] == segment[t - k] and x[t - k] is not None and y[t] is not None]
        a, b = (np.array(v, float) for v in zip(*pairs)) if pairs else (np.zeros(0), np.zeros(0))
        defined = len(a) >= 20 and a.std() > 1e-9 and b.std() > 1e-9
        out[k] = (len(a), float(np.corrcoef(a, b)[0, 1]) if defined else None)
    return out


@pytest.mark.parametrize("block", [16, 50, 1 << 14])
def test_lag_correlations_in_blocks(spark, block):
    r = random.Random(5)
    n = 240
    y = [r.gauss(1000, 3) if r.random() > 0.1 else None for _ in range(n)]
    x = [(y[t + 4] or 1000) + r.gauss(0, 1) if t + 4 < n and r.random() > 0.1 else None for t in range(n)]
    segment = [t // 90 for t in range(n)]
    rows = [(g, segment[t], t, x[t], 5.0, y[t] if g == "p" else -(y[t] or 0.0)) for g in ("p", "q") for t in range(n)]
    df = spark.createDataFrame(rows, "g string, segment int, t long, x double, flat double, y double").repartition(3)
    lags = range(-9, 40)
    for keys in ((), ("segment",)):
        found = stats.lag_correlations(df, ["x", "flat", "y"], "y", lags, "t", keys, groups=["g"], block=block)
        got = {(r["g"], r["input"], r["lag"]): (r["pairs"], r["corr"]) for r in found.collect()}
        assert len(got) == 2 * 3 * len(lags)
        parts = segment if keys else [0] * n
        for k, (pairs, corr) in plain_lags(x, y, parts, lags).items():
            assert got["p", "x", k][0] == pairs
            assert got["p", "x", k][1] == (None if corr is None else pytest.approx(corr, abs=1e-9))
            assert got["p", "flat", k][1] is None
        best = {r["g"]: r["delay"] for r in stats.best_lags(found.filter("input = 'x'"), ["g"]).collect()}
        assert best["p"] == 4


def test_six_hundred_lags_of_fifty_inputs(spark):
    r = np.random.default_rng(1)
    y = r.normal(size=3000)
    names = [f"x{i}" for i in range(50)]
    data = {"t": np.arange(3000), "y": y} | {c: np.roll(y, -12 * i) + r.normal(size=3000) for i, c in enumerate(names)}
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(data)).repartition(4)
    found = stats.lag_correlations(df, names, "y", range(601), "t", block=1024)
    assert found.count() == 601 * 50
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    best = {r["input"]: r["delay"] for r in stats.best_lags(found).collect()}
    assert best == {c: 12 * i for i, c in enumerate(names)}
