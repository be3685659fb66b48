"""Policies: defaults, checks, what came from where, and the next candidate of a search."""

from __future__ import annotations

import copy
import hashlib
import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The engine's defaults by section.
DEFAULTS = {
    "selection": {"window": 30, "step": 15, "strict_score": 80.0, "usable_score": 60.0, "snr_db": 10.0, "min_valid_samples": 15, "top_k": 5, "fallback": False, "sparse_output": False, "min_output_observations": 1, "weights": {"input_change": 0.35, "output_response": 0.25, "completeness": 0.20, "anomaly": 0.10, "smoothness": 0.10}, "scales": {"input_change": 1500.0, "output_response": 1800.0}},
    "decoupling": {"max_lag": 60, "correlation": 0.9, "vif": 10.0, "max_features": 0, "families": ["ARX", "AR"], "orders": [1, 2, 3], "ridge": [0.0, 1.0, 10.0]},
    "optimization": {"weights": {"r2": 0.68, "rmse": 0.17, "coverage": 0.15}, "rounds": 16, "min_rounds": 8, "patience": 3, "bounds": {}, "constraints": {}, "candidates": []},
    "resample": {"seconds": 10.0},
}
#: The sampling period of each scene, in seconds.
SCENE_SECONDS = {
    "blast_furnace": 3600.0,
    "debutanizer_column": 60.0,
    "industrial_dryer": 10.0,
    "steel_industry_energy": 900.0,
    "thermal_power_boiler_long_tail": 1.0,
    "vapor_pressure_soft_sensor": 3600.0,
}
#: What scenes set otherwise than the defaults. Candidates are (windows, longest delay), bounds (least, most).
SCENE_PROFILES = {
    "blast_furnace": {
        "selection": {"window": 24, "step": 6, "strict_score": 75, "usable_score": 55, "snr_db": 6, "fallback": True, "min_valid_samples": 18, "weights": {"input_change": 0.25, "output_response": 0.3, "completeness": 0.25, "anomaly": 0.1, "smoothness": 0.1}, "scales": {"input_change": 900, "output_response": 1200}},
        "decoupling": {"max_lag": 12, "correlation": 0.92, "vif": 12, "orders": [1, 2]},
        "optimization": {"weights": {"r2": 0.65, "rmse": 0.15, "coverage": 0.2}, "bounds": {"top_k": (2, 12), "max_lag": (4, 24)}, "constraints": {"min_r2": 0, "min_coverage": 0.08}, "candidates": [(5, 12), (3, 6), (8, 18), (10, 24), (6, 9), (4, 15)]},
    },
    "debutanizer_column": {
        "selection": {"window": 120, "step": 30, "strict_score": 75, "usable_score": 55, "snr_db": 8, "fallback": True, "min_valid_samples": 30, "weights": {"input_change": 0.3, "output_response": 0.25, "completeness": 0.2, "anomaly": 0.1, "smoothness": 0.15}, "scales": {"input_change": 1200, "output_response": 1500}},
        "decoupling": {"max_lag": 90, "correlation": 0.95, "vif": 15},
        "optimization": {"weights": {"r2": 0.7, "rmse": 0.2, "coverage": 0.1}, "bounds": {"top_k": (2, 14), "max_lag": (30, 90)}, "constraints": {"min_r2": 0, "min_coverage": 0.08}, "candidates": [(5, 60), (3, 30), (8, 75), (10, 90), (6, 45), (4, 75)]},
    },
    "industrial_dryer": {
        "selection": {"window": 18, "step": 6, "fallback": True},
        "decoupling": {"max_lag": 18},
        "optimization": {"bounds": {"top_k": (2, 12), "max_lag": (4, 18)}, "constraints": {"min_r2": 0, "min_coverage": 0.05}, "candidates": [(5, 12), (3, 6), (8, 18), (10, 15), (6, 9), (4, 18)]},
    },
    "thermal_power_boiler_long_tail": {"selection": {"fallback": True, "top_k": 20}, "decoupling": {"families": ["ARX"]}},
    "vapor_pressure_soft_sensor": {
        "selection": {"window": 96, "step": 24, "usable_score": 50, "fallback": True, "sparse_output": True, "top_k": 80, "weights": {"input_change": 0.45, "output_response": 0.1, "completeness": 0.2, "anomaly": 0.1, "smoothness": 0.15}, "scales": {"input_change": 1200, "output_response": 900}},
        "decoupling": {"max_lag": 72, "families": ["FIRX"], "orders": [1], "ridge": [1, 10, 100], "max_features": 12},
        "optimization": {"bounds": {"top_k": (20, 100), "max_lag": (12, 72)}, "constraints": {"min_r2": 0, "min_coverage": 0.05}, "candidates": [(80, 48), (60, 24), (100, 72), (70, 36), (90, 60), (50, 12)]},
    },
}
_UNITS = {"s": 1, "min": 60, "h": 3600}


def seconds_of(period: str | float) -> float:
    """'10s', '1min' or '2 h' in seconds; a millisecond to 30 days."""
    if isinstance(period, str):
        m = re.fullmatch(r"\s*([0-9.]+)\s*(s|min|h)\s*", period)
        if not m:
            raise ValueError(f"{period!r} is no period")
        period = float(m[1]) * _UNITS[m[2]]
    if not 0.001 <= period <= 30 * 86400:
        raise ValueError("a period is between a millisecond and 30 days")
    return float(period)


def _between(value: object, low: float, high: float, whole: bool = False) -> bool:
    return not isinstance(value, bool) and isinstance(value, int if whole else (int, float)) and low <= value <= high


def check(policy: dict) -> None:
    """ValueError where a section contradicts itself or a value is out of its range."""
    s, d, o = policy["selection"], policy["decoupling"], policy["optimization"]
    weights = lambda w, names: set(w) == set(names) and all(_between(x, 0, 1) for x in w.values()) and abs(sum(w.values()) - 1) < 1e-9
    limits = {"top_k": 100_000, "max_lag": 600}
    bounded = all(k in limits and len(b) == 2 and all(_between(x, 1, limits[k], True) for x in b) and b[0] <= b[1] for k, b in o["bounds"].items())
    for ok, why in (
        (_between(s["window"], 15, 100_000, True), "windows have 15 rows at least"), (_between(s["step"], 1, s["window"], True), "steps are not longer than windows"),
        (_between(s["min_valid_samples"], 15, 100_000, True), "15 valid samples at least"), (_between(s["min_output_observations"], 1, s["window"], True), "a window holds the output's observations"), (_between(s["top_k"], 1, 100_000, True), "one window at least"),
        (all(_between(s[k], 0, 100) for k in ("strict_score", "usable_score")) and s["usable_score"] <= s["strict_score"], "usable is not above strict"), (_between(s["snr_db"], -200, 200), "signal to noise is in decibels"),
        (all(isinstance(s[k], bool) for k in ("fallback", "sparse_output")), "switches are true or false"), (weights(s["weights"], DEFAULTS["selection"]["weights"]), "selection weights add up to 1"),
        (set(s["scales"]) == {"input_change", "output_response"} and all(_between(x, 1e-6, 1e9) for x in s["scales"].values()), "scales are positive"),
        (weights(o["weights"], DEFAULTS["optimization"]["weights"]), "optimization weights add up to 1"), (_between(d["max_lag"], 1, 600, True), "lags are 1 to 600"), (_between(d["max_features"], 0, 10_000, True), "features are 0 (all) to 10000"),
        (_between(d["correlation"], 1e-6, 1) and _between(d["vif"], 1, 1e6), "collinearity thresholds are out of range"), (bool(d["orders"]) and all(_between(x, 1, 3, True) for x in d["orders"]), "orders are 1 to 3"),
        (bool(d["ridge"]) and all(_between(x, 0, 1e9) for x in d["ridge"]), "ridge is not negative"), (bool(d["families"]) and set(d["families"]) <= {"ARX", "AR", "FIRX"}, "families are ARX, AR and FIRX"),
        ("FIRX" not in d["families"] or len(d["families"]) == 1, "FIRX stands alone"), (bounded, "bounds are of top_k and max_lag, least first"),
        (set(o["constraints"]) <= {"min_r2", "min_coverage"} and all(_between(x, -1e9 if k == "min_r2" else 0, 1) for k, x in o["constraints"].items()), "constraints are min_r2 and min_coverage"),
        (len(o["candidates"]) <= 16 and all(len(c) == 2 and _between(c[0], 1, 100_000, True) and _between(c[1], 1, 600, True) for c in o["candidates"]), "candidates are pairs of windows and longest delay"),
    ):
        if not ok:
            raise ValueError(why)
    seconds_of(policy["resample"]["seconds"])


def receipt(scene: dict | None = None, request: dict | None = None) -> dict:
    """The effective policy, for each of its keys whether default, scene or request set it, and its SHA-256."""
    policy, origin = copy.deepcopy(DEFAULTS), {}
    for section, values in policy.items():
        for key in values:
            origin[f"{section}.{key}"] = "default"
    for name, given in (("scene", scene or {}), ("request", request or {})):
        for section, values in given.items():
            for key, value in values.items():
                if key not in policy.get(section, {}):
                    raise ValueError(f"{section}.{key} is unknown")
                policy[section][key] = value
                origin[f"{section}.{key}"] = name
    check(policy)
    return {"policy": policy, "origin": origin, "sha256": hashlib.sha256(json.dumps(policy, sort_keys=True, ensure_ascii=False).encode()).hexdigest()}


def of_scene(name: str, request: dict | None = None) -> dict:
    """The receipt of a scene's profile and sampling period, with what a request sets on top; scenes without a profile have the defaults."""
    profile = copy.deepcopy(SCENE_PROFILES.get(name, {}))
    if name in SCENE_SECONDS:
        profile["resample"] = {"seconds": SCENE_SECONDS[name]}
    return receipt(profile, request)


def next_candidate(wanted: tuple[int, int], bounds: tuple[tuple[int, int], tuple[int, int]], used: Iterable[tuple[int, int]]) -> tuple[int, int] | None:
    """The wanted pair within its bounds, or the nearest one that was not tried; None when all were."""
    (a0, a1), (b0, b1) = bounds
    a, b = min(max(wanted[0], a0), a1), min(max(wanted[1], b0), b1)
    seen = set(used)
    left = [(abs(x - a) + abs(y - b), x, y) for x in range(a0, a1 + 1) for y in range(b0, b1 + 1) if (x, y) not in seen]
    return min(left)[1:] if left else None


def scenes(spark: SparkSession) -> DataFrame:
    """The dictionary of scenes: number (from 0, by name), scene and seconds."""
    rows = [(i, name, SCENE_SECONDS[name]) for i, name in enumerate(sorted(SCENE_SECONDS))]
    return spark.createDataFrame(rows, "number int, scene string, seconds double")


def effective_seconds(requested: Column, project: Column, detected: Column, seconds: Column, automatic: Column) -> Column:
    """The sampling period of an upload: as requested, but the detected scene's where an automatic upload leaves its project's scene.

    An unknown scene on either side, or a period that is null, not finite or not positive, leaves what was requested.
    """
    crosses = automatic & (project != "") & (detected != "") & (project != detected)
    usable = (seconds > 0) & (seconds < float("inf"))
    return F.when(F.coalesce(crosses & usable, F.lit(False)), seconds).otherwise(requested)
