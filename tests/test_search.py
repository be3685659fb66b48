"""The search over real data against a plain loop; what it may look at; and going on after a stop."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from kilnworks.operators import identification as ident
from kilnworks.operators import search, windows

INPUTS, OUTPUT = ["u", "v"], "y"
N, WINDOW, STEP, GUARD = 500, 30, 15, 7
OPTIONS = {"window": WINDOW, "step": STEP, "guard": GUARD, "alphas": (0.0, 5.0), "orders": (1, 2)}


def plant(seed=3):
    r = np.random.default_rng(seed)
    u, v, y = np.cumsum(r.normal(size=N)) * 0.2 + 50, 20 + 5 * np.sin(np.arange(N) / 7) + r.normal(size=N), np.full(N, 40.0)
    for t in range(4, N):
        y[t] = 10 + 0.6 * y[t - 1] + 0.15 * u[t - 3] + 0.1 * v[t - 2] + r.normal() * 0.3
    df = pd.DataFrame({"rn": np.arange(N), "u": u, "v": v, "y": y})
    df.loc[[40, 41, 333, 334, 420], "y"] = np.nan
    df.loc[[120, 360], "u"] = np.nan
    df["part"] = np.where(df.rn < 300, "train", np.where(df.rn < 400, "validation", "test"))
    return df


def spark_frame(spark, df):
    return spark.createDataFrame(df.astype(object).where(df.notna(), None), "rn long, u double, v double, y double, part string")


# ---- the plain loop


def runs_of(places):
    out = []
    for p in places:
        if out and p == out[-1][-1] + 1:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def plain_features(df, runs, delays, order):
    """Rows (place, features) with all lags of the highest order inside one run."""
    for run in runs:
        for i, t in enumerate(run):
            lags = [("y", k) for k in range(1, order + 1)] + [(c, max(1, delays[c]) + j) for c in INPUTS for j in range(order)]
            if all(k <= i for _, k in lags):
                yield t, {f"{c}_{k}": df[c][t - k] for c, k in lags}


def plain_targets(df, places):
    inside = set(places)
    whole = lambda t: all(not math.isnan(df[c][t]) for c in INPUTS)
    for i, t in enumerate(places):
        if i >= GUARD and all(not math.isnan(df["y"][t - k]) and t - k in inside for k in range(4)) and all(whole(t - k) for k in range(GUARD + 1)):
            yield t


def plain_errors(df, places, fit):
    inside, errors = set(places), []
    for t in plain_targets(df, places):
        p = fit["coefficients"][0]
        for b, name in zip(fit["coefficients"][1:], fit["features"]):
            c, k = name.rsplit("_", 1)
            p += b * df[c][t - int(k)] if t - int(k) in inside else math.nan
        errors.append(df["y"][t] - p)
    y = np.array([df["y"][t] for t in plain_targets(df, places)])
    return np.array(errors), y


def plain_evaluate(df, chosen, top_k, max_lag):
    train, val = [t for t in range(N) if df["part"][t] == "train"], [t for t in range(N) if df["part"][t] == "validation"]
    rows = [t for t in train if any(a <= t <= b for a, b in chosen[:top_k])]
    runs, delays = runs_of(rows), {}
    for c in INPUTS:
        best = None
        for k in range(max_lag + 1):
            pairs = [(df[c][run[i - k]], df["y"][run[i]]) for run in runs for i in range(k, len(run))]
            pairs = np.array([p for p in pairs if not any(map(math.isnan, p))])
            if len(pairs) >= 20:
                r = round(abs(np.corrcoef(pairs.T)[0, 1]), 9)
                if best is None or r > best[0]:
                    best = (r, k)
        if best is None:
            return None
        delays[c] = best[1]
    data = [(x, df["y"][t]) for t, x in plain_features(df, runs, delays, 3) if not math.isnan(df["y"][t]) and not any(map(math.isnan, x.values()))]
    found = []
    for order in OPTIONS["orders"]:
        for family in ("AR", "ARX"):
            names = [n for n, _, _ in ident.lag_names(order, delays if family == "ARX" else {}, "y")]
            x, y = np.array([[d[n] for n in names] for d, _ in data]).reshape(len(data), len(names)), np.array([t for _, t in data])
            if len(x) < max(20, 2 * (len(names) + 1)):
                continue
            mean, scale = x.mean(0), x.std(0)
            z = (x - mean) / scale
            for alpha in OPTIONS["alphas"]:
                beta = np.linalg.solve(z.T @ z + alpha * np.eye(len(names)), z.T @ (y - y.mean())) / scale
                fit = {"features": names, "coefficients": [y.mean() - beta @ mean, *beta], "order": order, "family": family, "alpha": alpha}
                errors, target = plain_errors(df, val, fit)
                if ident.is_stable(beta[:order]) and not np.isnan(errors).any():
                    bic = len(errors) * math.log((errors**2).mean()) + (len(names) + 1) * math.log(len(errors))
                    found.append((bic, fit, errors, target))
    if not found:
        return None
    _, fit, errors, target = min(found, key=lambda f: f[0])
    r2, rmse = 1 - (errors**2).sum() / ((target - target.mean()) ** 2).sum(), math.sqrt((errors**2).mean())
    coverage = len(rows) / len(train)
    score = round(100 * (0.68 * min(1, max(0, (r2 + 0.2) / 1.2)) + 0.17 / (1 + rmse) + 0.15 * coverage), 3)
    return fit | {"r2": r2, "rmse": rmse, "mae": np.abs(errors).mean(), "score": score, "delays": delays, "rows": len(rows)}


def plain_search(df, chosen, max_lag, bounds):
    seen, out = [], []

    def move(k, lag):
        pairs = [(a, b) for a in range(bounds["top_k"][0], bounds["top_k"][1] + 1) for b in range(bounds["max_lag"][0], bounds["max_lag"][1] + 1)]
        k, lag = min(max(k, bounds["top_k"][0]), bounds["top_k"][1]), min(max(lag, bounds["max_lag"][0]), bounds["max_lag"][1])
        at = pairs.index((k, lag))
        return next(p for p in pairs[at:] + pairs[:at] if p not in seen)

    def take(number, k, lag):
        pair = move(k, lag)
        seen.append(pair)
        out.append((number, *pair, plain_evaluate(df, chosen, *pair)))

    half = max(10, max_lag // 2)
    for i, (k, lag) in enumerate(((5, max_lag), (3, half), (8, max_lag + half), (6, max(10, round(max_lag * 0.75))), (10, max_lag * 2), (4, max(10, round(max_lag * 1.25))))):
        take(i + 1, k, lag)
    first = best = max((r for r in out if r[3]), key=lambda r: r[3]["score"])
    idle = 0
    for number, (more, ahead) in enumerate(search.DIRECTIONS, 7):
        anchor = first if number <= 8 else best
        take(number, anchor[1] + more, max(10, anchor[2] + ahead * max(10, max_lag // 4)))
        gain = out[-1][3]["score"] - best[3]["score"] if out[-1][3] else 0
        best = out[-1] if gain > 0 else best
        idle = 0 if gain >= 0.2 else idle + 1
        if number >= 8 and idle >= 3 and best[3]["r2"] >= 0 and best[3]["rows"] / 300 >= 0.05:
            break
    return out, max((r for r in out if r[3]), key=lambda r: r[3]["score"])


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    journal = str(tmp_path_factory.mktemp("search") / "journal")
    s = search.Search(spark_frame(spark, plant()), INPUTS, OUTPUT, journal=journal, **OPTIONS)
    return s, s.run(max_lag=12), journal


def key(r):
    return tuple(r.get(k) for k in ("round", "top_k", "max_lag", "status", "score", "family", "model_order", "alpha"))


def test_rounds_equal_a_plain_loop(whole):
    s, found, _ = whole
    df = {c: x.tolist() for c, x in plant().items()}
    rounds, winner = plain_search(df, s.windows, 12, search.BOUNDS)
    assert len(found["rounds"]) == len(rounds) >= 8
    for got, (number, k, lag, want) in zip(found["rounds"], rounds):
        assert (got["round"], got["top_k"], got["max_lag"], got["status"]) == (number, k, lag, "completed" if want else "infeasible")
        if want:
            assert got["delays"] == want["delays"] and got["train_rows"] == want["rows"]
            assert (got["family"], got["model_order"], got["alpha"]) == (want["family"], want["order"], want["alpha"])
            assert got["coefficients"] == pytest.approx(want["coefficients"], rel=1e-6)
            assert [got[m] for m in ("r2", "rmse", "mae", "score")] == pytest.approx([want[m] for m in ("r2", "rmse", "mae", "score")], abs=2e-3)
    assert found["winner"]["round"] == winner[0]
    test = [t for t in range(N) if df["part"][t] == "test"]
    errors, target = plain_errors(df, test, winner[3])
    assert found["test"]["targets"] == len(target) and found["test"]["rmse"] == pytest.approx(math.sqrt((errors**2).mean()), rel=1e-6)


def test_windows_are_those_of_train_rows(spark, whole):
    s, _, _ = whole
    train = spark_frame(spark, plant()).filter("part = 'train'")
    scored = windows.score_windows(train, INPUTS, OUTPUT, [*INPUTS, OUTPUT], size=WINDOW, step=STEP)
    assert s.windows == [(r["start_rn"], r["end_rn"]) for r in windows.top_windows(scored, 20).collect()]
    assert all(b < 300 for _, b in s.windows)


def test_test_rows_change_no_round(spark, whole, tmp_path):
    _, found, journal = whole
    df = plant()
    df.loc[df.part == "test", ["u", "v", "y"]] *= -7.5
    s = search.Search(spark_frame(spark, df), INPUTS, OUTPUT, journal=str(tmp_path / "j"), **OPTIONS)
    again = s.run(max_lag=12)
    assert list(map(key, again["rounds"])) == list(map(key, found["rounds"])) and again["winner"]["round"] == found["winner"]["round"]
    assert again["test"]["rmse"] != found["test"]["rmse"]
    assert [s.signature(r) for r in again["rounds"]] == [r["signature"] for r in found["rounds"]]


def test_a_search_goes_on_where_it_stopped(spark, whole, tmp_path):
    _, found, _ = whole
    journal = str(tmp_path / "j")
    half = search.Search(spark_frame(spark, plant()), INPUTS, OUTPUT, journal=journal, **OPTIONS)
    half.evaluate(search.first_candidates(12)[:4])
    assert len(half.evaluated) == 4
    s = search.Search(spark_frame(spark, plant()), INPUTS, OUTPUT, journal=journal, **OPTIONS)
    again = s.run(max_lag=12)
    assert list(map(key, again["rounds"])) == list(map(key, found["rounds"]))
    assert len(s.evaluated) == len(found["rounds"]) - 4 and not set(s.evaluated) & set(half.evaluated)
    rows = s.journal.frame().collect()
    assert len(rows) == len({r["signature"] for r in rows}) == len(found["rounds"]) + 1  # and the only test
    third = search.Search(spark_frame(spark, plant()), INPUTS, OUTPUT, journal=journal, **OPTIONS)
    assert list(map(key, third.run(max_lag=12)["rounds"])) == list(map(key, found["rounds"])) and not third.evaluated
    assert third.journal.frame().count() == len(rows)


def test_other_data_have_other_signatures(spark, whole):
    s, found, journal = whole
    df = plant()
    df.loc[350, "y"] += 1e-9  # a validation row
    other = search.Search(spark_frame(spark, df), INPUTS, OUTPUT, journal=journal, **OPTIONS)
    assert not {other.signature(r) for r in found["rounds"]} & {s.signature(r) for r in found["rounds"]}


def test_nothing_to_judge(spark, tmp_path):
    df = plant()
    df["u"] = 5.0  # a constant input has no delay
    s = search.Search(spark_frame(spark, df), INPUTS, OUTPUT, journal=str(tmp_path / "j"), **OPTIONS)
    found = s.run(max_lag=12)
    assert found["winner"] is None and {r["reason"] for r in found["rounds"]} == {"no_delay_evidence"}
    assert search.rounds_frame(spark, found).count() == 6


def test_candidates_stay_in_bounds():
    bounds = {"top_k": (2, 3), "max_lag": (5, 6)}
    seen = []
    for _ in range(4):
        c = search.within({"top_k": 9, "max_lag": 1}, bounds, seen)
        seen.append((c["top_k"], c["max_lag"]))
    assert seen == [(3, 5), (3, 6), (2, 5), (2, 6)]
    assert search.within({"top_k": 2, "max_lag": 5}, bounds, seen) is None


def test_a_policy_sets_the_search(spark, tmp_path):
    from kilnworks.operators import policy

    p = policy.of_scene("blast_furnace", {"decoupling": {"orders": [1]}})["policy"]
    s = search.Search.of_policy(spark_frame(spark, plant()), INPUTS, OUTPUT, p, journal=str(tmp_path / "j"), guard=GUARD)
    found = s.run(p["decoupling"]["max_lag"], p["optimization"]["bounds"], max_rounds=6)
    assert [(r["top_k"], r["max_lag"]) for r in found["rounds"]] == p["optimization"]["candidates"]
    assert all(b - a == 23 for a, b in s.windows) and {r["model_order"] for r in found["rounds"] if r["status"] == "completed"} <= {1}
    with pytest.raises(ValueError, match="output's past"):
        search.Search.of_policy(spark_frame(spark, plant()), INPUTS, OUTPUT, policy.of_scene("vapor_pressure_soft_sensor")["policy"])
