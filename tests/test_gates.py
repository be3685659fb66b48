"""Gates over evidence, case by case; models of many runs against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnworks.operators import gates

REVIEW = "run long, decision string, required_coverage double, quality double, family string, r2 double, improvement double, stable boolean, multi_rmse double, multi_baseline double, sim_r2 double, diverged boolean, acf double, acf_bound double, time_axis string, fitted_inputs array<string>"
GOOD = dict(run=0, decision="ready", required_coverage=1.0, quality=90.0, family="ARX", r2=0.8, improvement=5.0, stable=True, multi_rmse=1.0, multi_baseline=2.0, sim_r2=0.3, diverged=False, acf=0.1, acf_bound=0.2, time_axis="wall_clock", fitted_inputs=["u"])
NEVER = {"external_operating_period", "measurement_traceability", "online_monitoring"}


@pytest.mark.parametrize(
    ("change", "blockers", "offline", "sensor"),
    [
        ({}, [], [], []),
        ({"decision": "reject"}, ["standardization_rejected"], ["field_contract"], []),
        ({"required_coverage": 0.9}, [], ["field_contract"], []),
        ({"quality": 59.9}, ["low_quality"], ["data_quality"], []),
        ({"quality": None}, ["low_quality"], ["data_quality"], []),
        ({"r2": None}, ["no_test_measure"], ["independent_test"], []),
        ({"r2": -0.1}, ["negative_r2"], ["independent_test"], []),
        ({"improvement": None}, ["no_baseline"], ["independent_test"], []),
        ({"improvement": 0.99}, ["little_gain"], ["independent_test"], []),
        ({"family": "AR", "fitted_inputs": []}, ["output_alone"], [], ["external_inputs_used"]),
        ({"stable": None}, ["unstable"], ["dynamic_validity"], []),
        ({"multi_rmse": 2.0}, ["long_forecast"], ["dynamic_validity"], []),
        ({"sim_r2": None}, ["simulation"], ["dynamic_validity"], []),
        ({"diverged": True}, ["simulation"], ["dynamic_validity"], []),
        ({"family": "FIRX", "multi_rmse": None, "sim_r2": None}, [], [], []),
        ({"acf": None}, [], [], ["residual_whiteness"]),
        ({"acf": 0.3}, [], [], ["residual_whiteness"]),
        ({"time_axis": "ordered_samples"}, [], [], ["verified_physical_time"]),
        ({"time_axis": None}, [], [], []),
    ],
)
def test_review(spark, change, blockers, offline, sensor):
    row = gates.review_runs(spark.createDataFrame([GOOD | change], REVIEW)).first()
    assert row["blockers"] == blockers and row["passed"] == (not blockers)
    assert row["offline_failed"] == offline
    assert set(row["sensor_failed"]) == NEVER | set(offline) | set(sensor)
    assert len(row["loop_failed"]) == len(row["sensor_failed"]) + 3


def test_review_of_searches_and_outputs(spark):
    df = spark.createDataFrame([GOOD | {"run": i} for i in range(4)], REVIEW).withColumns({
        "selection_warnings": F.when(F.col("run") == 1, F.array(F.lit("few rows"))), "selection_qualified": F.when(F.col("run") > 0, F.col("run") != 1),
        "outputs": F.when(F.col("run") > 1, 2), "ready_outputs": F.when(F.col("run") == 3, 2),
    })
    rows = {r["run"]: r for r in gates.review_runs(df).collect()}
    assert rows[1]["blockers"] == ["few rows"] and rows[1]["offline_failed"] == ["search_quality_constraints"]
    assert rows[2]["offline_failed"] == ["multi_output_identification"]
    assert rows[0]["offline_failed"] == rows[3]["offline_failed"] == []


def test_review_of_nothing_and_of_no_runs(spark):
    row = gates.review_runs(spark.createDataFrame([{"run": 1}], REVIEW)).first()
    assert row["blockers"] == ["low_quality", "no_test_measure", "no_baseline", "unstable", "long_forecast", "simulation"]
    assert len(row["offline_failed"]) == 4
    assert gates.review_runs(spark.createDataFrame([], REVIEW)).count() == 0


def statuses(df, **more):
    return {(r["tool"], r["gate"]): r["status"] for r in gates.tool_results(df, **more).collect()}


def test_tool_gates(spark):
    whole = "1L as run, 'a' as split, 'p' as protocol, 'c' as config, 'h' as validation_hash, 'patience' as stop_reason, 's' as score_components, 'v' as collinearity, 2 as segments, 16 as max_rounds, 1 as test_evaluations, false as synthetic_fallback, false as test_in_search, true as diagnostics, array(named_struct('delay', 0, 'max_lag', 3)) as lags".split(", '")
    df = spark.sql("select " + ", '".join(whole))
    assert set(statuses(df).values()) == {"passed"} and len(statuses(df)) == 17
    nothing = statuses(spark.createDataFrame([(1,)], "run long"))
    assert {g for (_, g), x in nothing.items() if x == "passed"} == {"no_synthetic_fallback"}  # nothing says that there was one
    assert set(nothing.values()) == {"passed", "failed"}
    assert set(statuses(df.withColumn("go", F.lit(None).cast("boolean")), started="go").values()) == {"pending"}
    assert statuses(df, tools={"t": ("bounded_search", "never_heard_of")}) == {("t", "bounded_search"): "passed", ("t", "never_heard_of"): "unknown"}
    for lags, causal, bounded in (("-1, 3", "failed", "passed"), ("4, 3", "passed", "failed"), ("null, 3", "failed", "passed"), ("2, null", "passed", "failed")):
        delay, longest = lags.split(", ")
        got = statuses(df.withColumn("lags", F.expr(f"array(named_struct('delay', cast({delay} as int), 'max_lag', cast({longest} as int)))")))
        assert got["run_decoupling_identification", "causal_delay"] == causal and got["run_decoupling_identification", "maximum_lag_bound"] == bounded
    again = statuses(df.withColumns({"test_evaluations": F.lit(2), "stop_reason": F.lit(""), "synthetic_fallback": F.lit(True)}))
    assert {g for (_, g), x in again.items() if x == "failed"} == {"single_final_test", "stopping_reason_recorded", "no_synthetic_fallback", "real_data_only"}


SET = dict(source_type="REAL_PLANT", hash_matches=True, evidence_source="x", analysis_allowed=True, license="y", required=4, matched=4, in_review=0, units_documented=True, time_valid=True, seconds=60.0, stated_seconds=60.0, sampling_evidence="z", normalization="physical", manifest=None, rows=150, target_rows=1)
SETS = "source_type string, hash_matches boolean, evidence_source string, analysis_allowed boolean, license string, required int, matched int, in_review int, units_documented boolean, time_valid boolean, seconds double, stated_seconds double, sampling_evidence string, normalization string, manifest string, rows long, target_rows long"


@pytest.mark.parametrize(
    ("change", "eligibility", "reasons"),
    [
        ({}, "ELIGIBLE", []),
        ({"normalization": "restored", "manifest": "m"}, "ELIGIBLE", []),
        ({"normalization": "restored"}, "NORMALIZATION_BLOCKED", ["normalization"]),
        ({"source_type": "SYNTHETIC"}, "UNUSABLE", ["source"]),
        ({"source_type": None}, "METADATA_LIMITED", ["source"]),
        ({"hash_matches": None}, "METADATA_LIMITED", ["source"]),
        ({"license": ""}, "UNUSABLE", ["license"]),
        ({"license": None, "normalization": None}, "UNUSABLE", ["license", "normalization"]),
        ({"matched": 3}, "DATA_LIMITED", ["fields"]),
        ({"matched": 3, "in_review": 1}, "REVIEW_BLOCKED", ["fields"]),
        ({"matched": 2, "in_review": 1}, "DATA_LIMITED", ["fields"]),
        ({"units_documented": None}, "METADATA_LIMITED", ["units"]),
        ({"stated_seconds": 61.0}, "METADATA_LIMITED", ["time"]),
        ({"sampling_evidence": None}, "METADATA_LIMITED", ["time"]),
        ({"rows": 149}, "METADATA_LIMITED", ["rows"]),
        ({"target_rows": 0}, "METADATA_LIMITED", ["rows"]),
    ],
)
def test_precheck(spark, change, eligibility, reasons):
    row = gates.precheck_runs(spark.createDataFrame([SET | change], SETS)).first()
    assert (row["eligibility"], row["reasons"]) == (eligibility, reasons)


def plain(y, u):
    """One run's fit and test by a loop."""
    n = len(y)
    lo, hi = n * 6 // 10, n * 8 // 10
    fits = {}
    for name, cols in (("AR", [y[:-1]]), ("ARX", [y[:-1], u[:-1]])):
        x = np.column_stack([np.ones(n - 1), *cols])
        k = np.linalg.lstsq(x[: lo - 1], y[1:lo], rcond=None)[0]
        fits[name] = (((y[lo:hi] - x[lo - 1 : hi - 1] @ k) ** 2).mean(), np.r_[k, 0.0][:3])
    family = "ARX" if fits["ARX"][0] < fits["AR"][0] else "AR"
    c, a, b = fits[family][1]
    e, se, seen, s = [], 0.0, [], None
    for t in range(hi, n):
        e.append(y[t] - c - a * y[t - 1] - b * u[t - 1])
        s = c + a * (y[t - 1] if (t - hi) % gates.STRETCH == 0 else s) + b * u[t - 1]
        se += (y[t] - s) ** 2
        seen.append(y[t])
    far = []
    for t in range(max(hi, gates.STEPS), n):
        p = y[t - gates.STEPS]
        for j in range(t - gates.STEPS, t):
            p = c + a * p + b * u[j]
        far.append(y[t] - p)
    e, seen = np.array(e), np.array(seen)
    return {
        "family": family, "r2": 1 - (e**2).sum() / (len(e) * seen.var()), "rmse": np.sqrt((e**2).mean()), "multi_rmse": np.sqrt((np.array(far) ** 2).mean()), "sim_r2": 1 - se / (len(e) * seen.var()),
        "acf": max(abs((e[k:] * e[:-k]).sum()) for k in range(1, gates.RESIDUAL_LAGS + 1)) / (e**2).sum(),
    }


def test_models_of_runs_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for run in range(6):
        n = 60 + 45 * run
        u, y = rng.normal(size=n), np.zeros(n)
        for t in range(1, n):
            y[t] = 2 + 0.7 * y[t - 1] + (run % 2) * 1.5 * u[t - 1] + rng.normal() * 0.3
        want[run] = plain(y, u)
        rows += [(run, t, float(y[t]), float(u[t]), "clash") for t in range(n)]
    # a constant run and a single row have no model; nulls in the middle only cost the rows that need them
    rows += [(90, t, 1.0, float(t), "clash") for t in range(50)] + [(91, 0, 1.0, 1.0, "clash")]
    df = gates.numbered(spark.createDataFrame(rows, "run long, h long, y double, u double, note string"))
    got = {r["run"]: r for r in gates.test_evidence(df, gates.fit_runs(df)).collect()}
    assert sorted(got) == sorted(want)
    for run, facts in want.items():
        assert got[run]["family"] == facts.pop("family")
        for k, v in facts.items():
            assert got[run][k] == pytest.approx(v, rel=1e-6, abs=1e-9), (run, k)


def test_null_samples_and_no_samples(spark):
    rng = np.random.default_rng(4)
    rows = [(1, t, None if t % 7 == 3 else float(rng.normal()), None if t % 11 == 5 else 1.0) for t in range(100)]
    schema = "run long, h long, y double, u double"
    df = gates.numbered(spark.createDataFrame(rows, schema))
    r = gates.test_evidence(df, gates.fit_runs(df)).first()
    assert r["family"] == "AR" and r["n_test"] == sum(1 for t in range(80, 100) if rows[t][2] is not None and rows[t - 1][2] is not None and rows[t - 1][3] is not None)
    empty = gates.numbered(spark.createDataFrame([], schema))
    assert gates.test_evidence(empty, gates.fit_runs(empty)).count() == 0
