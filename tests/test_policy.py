"""Policies and candidates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kilnworks.operators import policy


def test_requests_go_before_scenes():
    r = policy.receipt({"selection": {"window": 60, "step": 20}}, {"selection": {"step": 30}})
    assert r["policy"]["selection"]["window"] == 60 and r["policy"]["selection"]["step"] == 30
    assert r["origin"]["selection.window"] == "scene" and r["origin"]["selection.step"] == "request" and r["origin"]["decoupling.vif"] == "default"
    assert r["sha256"] != policy.receipt()["sha256"] and policy.DEFAULTS["selection"]["window"] == 30


@pytest.mark.parametrize("bad", [{"selection": {"window": 10}}, {"selection": {"step": 31}}, {"decoupling": {"orders": [4]}}, {"decoupling": {"families": ["FIRX", "AR"]}}, {"selection": {"nothing": 1}}, {"resample": {"seconds": 0}}, {"optimization": {"bounds": {"top_k": (5, 2)}}}, {"optimization": {"bounds": {"other": (1, 2)}}}, {"optimization": {"constraints": {"min_r2": 2}}}, {"optimization": {"candidates": [(5, 601)]}}, {"decoupling": {"max_features": -1}}, {"selection": {"scales": {"input_change": 0, "output_response": 1}}}, {"selection": {"fallback": 1}}])
def test_contradictions(bad):
    with pytest.raises(ValueError):
        policy.receipt(request=bad)


def test_periods():
    assert policy.seconds_of("15 min") == 900 and policy.seconds_of("10s") == 10
    with pytest.raises(ValueError):
        policy.seconds_of("a while")


def test_candidates_run_out():
    bounds, used = ((2, 3), (4, 5)), []
    for _ in range(4):
        used.append(policy.next_candidate((9, 9), bounds, used))
    assert len(set(used)) == 4 and used[0] == (3, 5) and policy.next_candidate((9, 9), bounds, used) is None


def test_the_detected_scene_gives_the_period_across_scenes(spark):
    rows = [
        ("a", "b", 60.0, True, 60.0), ("a", "a", 60.0, True, 10.0), ("a", "b", 60.0, False, 10.0), ("", "b", 60.0, True, 10.0), ("a", None, 60.0, True, 10.0),
        ("a", "b", None, True, 10.0), ("a", "b", float("nan"), True, 10.0), ("a", "b", float("inf"), True, 10.0), ("a", "b", 0.0, True, 10.0), ("a", "b", 60.0, None, 10.0),
    ]
    df = spark.createDataFrame(rows, "project string, detected string, own double, automatic boolean, want double")
    found = policy.effective_seconds(F.lit(10.0), *map(F.col, ("project", "detected", "own", "automatic")))
    assert [r[0] == r[1] for r in df.select(found, "want").collect()] == [True] * len(rows)


@pytest.mark.parametrize("name", [*policy.SCENE_SECONDS, "unknown"])
def test_scene_profiles_are_whole(name):
    r = policy.of_scene(name, {"selection": {"top_k": 7}})
    assert r["policy"]["selection"]["top_k"] == 7 and r["origin"]["selection.top_k"] == "request"
    assert r["policy"]["resample"]["seconds"] == policy.SCENE_SECONDS.get(name, 10.0)
    if name == "blast_furnace":
        assert r["policy"]["optimization"]["candidates"][0] == (5, 12) and r["origin"]["decoupling.max_lag"] == "scene" and r["policy"]["decoupling"]["families"] == ["ARX", "AR"]
