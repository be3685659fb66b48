"""Evidence of models fitted for many runs at once, and the gates that judge it.

Runs are groups of one table: a model for each is fitted, chosen and tested by grouped aggregates, whatever their number.
The gates are columns over evidence, a row for each run; evidence that is null counts as missing, never as passed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a review asks of quality, of the gain over the last value in per cent, and of rows before anything is fitted.
LEAST_QUALITY, LEAST_GAIN, LEAST_ROWS = 60, 1, 150
#: Steps of the long forecast, of a free simulation before it starts anew from a measured value, and lags of the residuals.
STEPS, STRETCH, RESIDUAL_LAGS = 10, 24, 5

#: The gates that each tool states.
TOOLS = {
    "run_dynamic_selection": ("training_partition_only", "minimum_valid_samples", "score_components_available", "no_synthetic_fallback"),
    "run_decoupling_identification": ("causal_delay", "maximum_lag_bound", "vif_or_correlation_evidence", "common_validation_targets", "reproducible_fit", "residual_diagnostics"),
    "run_closed_loop_optimization": ("real_data_only", "frozen_split_unchanged", "validation_hash_identical_across_candidates", "test_not_in_objective", "single_final_test", "bounded_search", "stopping_reason_recorded"),
}
#: Classes of sources that may be analysed, and those that never are.
REAL_SOURCES = ("REAL_PLANT", "PUBLIC_REAL_PROCESS", "PUBLIC_EXPERIMENT", "BENCHMARK_REAL", "DERIVED_REAL")
UNREAL_SOURCES = ("SYNTHETIC", "UNKNOWN")


def numbered(samples: DataFrame, run: str = "run", order: str = "h") -> DataFrame:
    """rn, n, part, y1, u1: place in the run, its rows, 60/20/20 by time, and the last sample's y and u."""
    by_run = Window.partitionBy(run)
    w = by_run.orderBy(order)
    rows = samples.withColumns({"rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(by_run), "y1": F.lag("y").over(w), "u1": F.lag("u").over(w)})
    ends = [F.floor(F.col("n") * share / 10) for share in (6, 8)]
    return rows.withColumn("part", F.when(F.col("rn") <= ends[0], "train").when(F.col("rn") <= ends[1], "validation").otherwise("test"))


def fit_runs(rows: DataFrame, run: str = "run") -> DataFrame:
    """family, a, b, c for each run: y = c + a * y1 + b * u1, or without u1, whichever errs less on the validation rows.

    Both are fitted on the train rows from one aggregate of covariances. Runs where y1 is constant have none; where u1
    is constant or collinear, or the errors are equal, the model without it is taken.
    """
    whole = rows.dropna(subset=["y", "y1", "u1"])
    means = [F.avg(c).alias(f"m_{c}") for c in ("y", "y1", "u1")]
    spread = [F.covar_pop(x, z).alias(k) for k, x, z in (("v1", "y1", "y1"), ("v2", "u1", "u1"), ("c12", "y1", "u1"), ("c1", "y", "y1"), ("c2", "y", "u1"))]
    f = whole.filter("part = 'train'").groupBy(run).agg(*means, *spread)
    f = f.filter("v1 > 1e-12").withColumn("det", F.expr("if(v1 * v2 - c12 * c12 > 1e-9 * v1 * v2, v1 * v2 - c12 * c12, null)"))
    f = f.selectExpr(run, "m_y", "m_y1", "m_u1", "c1 / v1 as a0", "(c1 * v2 - c2 * c12) / det as a1", "(c2 * v1 - c1 * c12) / det as b1")
    f = f.selectExpr(run, "a0", "m_y - a0 * m_y1 as c0", "a1", "b1", "m_y - a1 * m_y1 - b1 * m_u1 as c1")
    judged = whole.filter("part = 'validation'").join(f, run).groupBy(run, *[c for c in f.columns if c != run])
    judged = judged.agg(F.avg(F.expr("pow(y - c0 - a0 * y1, 2)")).alias("mse0"), F.avg(F.expr("pow(y - c1 - a1 * y1 - b1 * u1, 2)")).alias("mse1"))
    better = F.coalesce(F.round("mse1", 9) < F.round("mse0", 9), F.lit(False))
    pick = lambda x, z: F.when(better, F.col(x)).otherwise(z)
    return judged.select(run, F.when(better, "ARX").otherwise("AR").alias("family"), pick("a1", F.col("a0")).alias("a"), pick("b1", F.lit(0.0)).alias("b"), pick("c1", F.col("c0")).alias("c"))


def test_evidence(rows: DataFrame, fits: DataFrame, run: str = "run") -> DataFrame:
    """What the test rows say of each fitted run: r2, rmse, improvement (per cent over the last value), acf and its bound, multi_rmse, multi_baseline, sim_r2, diverged, stable.

    Forecasts of STEPS steps start from measured values before them, in whatever part; simulations start anew every
    STRETCH samples, so no task holds more of a run than that. Runs without test rows are not returned.
    """
    w = Window.partitionBy(run).orderBy("rn")
    df = rows.join(fits, run).withColumn("push", F.expr("c + b * u1"))
    df = df.withColumn("e", F.expr("if(part = 'test', y - push - a * y1, null)")).withColumn("far", F.lag("y", STEPS).over(w))
    ahead = sum((F.pow("a", F.lit(i)) * F.lag("push", i).over(w) for i in range(1, STEPS)), F.col("push")) + F.pow("a", F.lit(STEPS)) * F.col("far")
    df = df.withColumns({"ahead": ahead} | {f"e{k}": F.lag("e", k).over(w) for k in range(1, RESIDUAL_LAGS + 1)}).filter("part = 'test'")
    both = F.expr("e is not null")
    found = df.groupBy(run, "family", "a").agg(
        F.count("e").alias("n_test"), F.sum(F.expr("e * e")).alias("sse"), F.var_pop(F.when(both, F.col("y"))).alias("vy"), F.sum(F.when(both, F.expr("pow(y - y1, 2)"))).alias("sb"),
        F.sqrt(F.avg(F.expr("pow(y - ahead, 2)"))).alias("multi_rmse"), F.sqrt(F.avg(F.expr("if(ahead is not null, pow(y - far, 2), null)"))).alias("multi_baseline"),
        *[F.sum(F.expr(f"e * e{k}")).alias(f"p{k}") for k in range(1, RESIDUAL_LAGS + 1)],
    )
    rmse, base = F.sqrt(F.col("sse") / F.col("n_test")), F.sqrt(F.col("sb") / F.col("n_test"))
    share = F.greatest(*[F.abs(F.col(f"p{k}")) for k in range(1, RESIDUAL_LAGS + 1)]) / F.when(F.col("sse") > 0, F.col("sse"))
    found = found.select(
        run, "family", "n_test", F.when(F.col("vy") > 0, 1 - F.col("sse") / (F.col("n_test") * F.col("vy"))).alias("r2"), F.when(F.col("n_test") > 0, rmse).alias("rmse"),
        F.when(F.col("sb") > 0, 100 * (base - rmse) / base).alias("improvement"), share.alias("acf"), F.when(F.col("n_test") > 0, 1.96 / F.sqrt("n_test")).alias("acf_bound"),
        "multi_rmse", "multi_baseline", (F.abs("a") < 1).alias("stable"),
    )
    place = F.col("rn") - F.floor(F.col("n") * 8 / 10) - 1
    stretches = df.groupBy(run, "a", F.floor(place / STRETCH).alias("stretch")).agg(F.sort_array(F.collect_list(F.struct("rn", "push", "y", "y1"))).alias("steps"))  # STRETCH rows
    start = F.struct(F.col("steps")[0]["y1"].alias("s"), F.lit(0).cast("long").alias("k"), *[F.lit(0.0).alias(c) for c in ("se", "sy", "syy")], F.lit(False).alias("lost"))

    def step(acc: Column, x: Column) -> Column:
        s = F.col("a") * acc["s"] + x["push"]
        seen = s.isNotNull() & x["y"].isNotNull()
        add = lambda old, new: old + F.when(seen, new).otherwise(0)
        return F.struct(
            s.alias("s"), add(acc["k"], F.lit(1)).cast("long").alias("k"), add(acc["se"], (x["y"] - s) * (x["y"] - s)).alias("se"), add(acc["sy"], x["y"]).alias("sy"),
            add(acc["syy"], x["y"] * x["y"]).alias("syy"), (acc["lost"] | F.coalesce(~(F.abs(s) < 1e12), F.lit(True))).alias("lost"),
        )

    sims = stretches.select(run, F.aggregate("steps", start, step).alias("z")).groupBy(run)
    sims = sims.agg(*[F.sum(f"z.{c}").alias(c) for c in ("k", "se", "sy", "syy")], F.bool_or("z.lost").alias("diverged")).withColumn("var", F.expr("syy - sy * sy / nullif(k, 0)"))
    return found.join(sims.select(run, F.expr("if(k > 1 and var > 1e-9 * syy, 1 - se / var, null)").alias("sim_r2"), "diverged"), run, "left")


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _names(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that do not hold, null ones among them."""
    return F.filter(F.array(*[F.when(~_is(ok), F.lit(k)) for k, ok in conditions.items()]), lambda x: x.isNotNull())


def review_runs(runs: DataFrame) -> DataFrame:
    """blockers, passed, and the failed gates of the offline model, the soft sensor and the closed loop.

    Reads decision, required_coverage, quality, family, r2, improvement, stable, multi_rmse, multi_baseline, sim_r2,
    diverged, acf, acf_bound, time_axis and fitted_inputs; where there are the columns selection_warnings (strings, each
    a blocker), selection_qualified, and outputs with ready_outputs, the search and the outputs are judged too. A sparse
    target (FIRX) needs neither long forecasts nor a simulation. What only people can show is never passed here, so no
    run is ready for more than offline work.
    """
    c = F.col
    sparse, has = c("family") == "FIRX", set(runs.columns)
    long_run = (c("multi_rmse") < c("multi_baseline"))
    simulated = (c("sim_r2") >= 0) & ~F.coalesce(c("diverged"), F.lit(False))
    sound = {
        "standardization_rejected": ~F.coalesce(c("decision") == "reject", F.lit(False)),
        "low_quality": c("quality") >= LEAST_QUALITY,
        "no_test_measure": c("r2").isNotNull(),
        "negative_r2": c("r2").isNull() | (c("r2") >= 0),
        "no_baseline": c("improvement").isNotNull(),
        "little_gain": c("improvement").isNull() | (c("improvement") >= LEAST_GAIN),
        "output_alone": ~F.coalesce(c("family") == "AR", F.lit(False)),
        "unstable": c("stable"),
        "long_forecast": _is(sparse) | long_run,
        "simulation": _is(sparse) | simulated,
    }
    blockers = _names(sound)
    if "selection_warnings" in has:
        blockers = F.concat(F.coalesce(c("selection_warnings"), F.array().cast("array<string>")), blockers)
    offline = {
        "field_contract": ~F.coalesce(c("decision") == "reject", F.lit(False)) & (c("required_coverage") >= 1),
        "data_quality": c("quality") >= LEAST_QUALITY,
        "independent_test": (c("r2") >= 0) & (c("improvement") >= LEAST_GAIN),
        "dynamic_validity": c("stable") & ((_is(sparse) & (c("r2") >= 0) & c("improvement").isNotNull()) | (~_is(sparse) & _is(long_run) & _is(simulated))),
    }
    if "selection_qualified" in has:
        offline["search_quality_constraints"] = c("selection_qualified").isNull() | c("selection_qualified")
    if {"outputs", "ready_outputs"} <= has:
        offline["multi_output_identification"] = F.coalesce(c("outputs"), F.lit(0)) <= 1
        offline["multi_output_identification"] |= c("ready_outputs") == c("outputs")
    no = F.lit(False)
    sensor = {
        "external_inputs_used": c("family").isin("ARX", "FIRX") & (F.size("fitted_inputs") > 0), "residual_whiteness": c("acf") <= c("acf_bound"),
        "verified_physical_time": F.coalesce(c("time_axis"), F.lit("wall_clock")) == "wall_clock",
        "external_operating_period": no, "measurement_traceability": no, "online_monitoring": no,
    }
    loop = {"causal_control_validation": no, "constraints_and_interlocks": no, "shadow_and_operator_acceptance": no}
    new = {"blockers": blockers, "offline_failed": _names(offline), "sensor_failed": _names(offline | sensor), "loop_failed": _names(offline | sensor | loop)}
    return runs.withColumns(new).withColumn("passed", F.size("blockers") == 0)


#: Columns that facts are read from, with their types.
FACT_COLUMNS = {
    **dict.fromkeys(("split", "protocol", "config", "validation_hash", "stop_reason", "score_components", "collinearity"), "string"), **dict.fromkeys(("segments", "max_rounds", "test_evaluations"), "long"),
    **dict.fromkeys(("synthetic_fallback", "test_in_search", "diagnostics"), "boolean"), "lags": "array<struct<delay:int,max_lag:int>>",
}


def tool_facts(runs: DataFrame) -> dict[str, Column]:
    """The facts that tools' gates name, true or false; columns of FACT_COLUMNS that are not there count as null.

    Of the string ones only whether they are null matters. Delays must lie between 0 and their longest.
    """
    c = {name: F.col(name) if name in runs.columns else F.lit(None).cast(kind) for name, kind in FACT_COLUMNS.items()}
    some = _is(F.size(c["lags"]) > 0)
    hashed = c["validation_hash"].isNotNull()
    return {
        "training_partition_only": c["split"].isNotNull(),
        "minimum_valid_samples": _is(c["segments"] > 0),
        "score_components_available": c["score_components"].isNotNull(),
        "no_synthetic_fallback": ~_is(c["synthetic_fallback"]),
        "causal_delay": some & _is(F.forall(c["lags"], lambda x: _is(x["delay"] >= 0))),
        "maximum_lag_bound": some & _is(F.forall(c["lags"], lambda x: F.coalesce(x["delay"], F.lit(0)) <= F.coalesce(x["max_lag"], F.lit(-1)))),
        "vif_or_correlation_evidence": c["collinearity"].isNotNull(),
        "common_validation_targets": hashed,
        "reproducible_fit": c["config"].isNotNull(),
        "residual_diagnostics": _is(c["diagnostics"]),
        "real_data_only": _is(~c["synthetic_fallback"]),
        "frozen_split_unchanged": c["protocol"].isNotNull() & hashed,
        "validation_hash_identical_across_candidates": hashed,
        "test_not_in_objective": _is(~c["test_in_search"]),
        "single_final_test": _is(c["test_evaluations"] == 1),
        "bounded_search": _is(c["max_rounds"] > 0),
        "stopping_reason_recorded": _is(c["stop_reason"] != ""),
    }


def tool_results(runs: DataFrame, keep: Sequence[str] = ("run",), started: str | None = None, tools: Mapping[str, Sequence[str]] = TOOLS) -> DataFrame:
    """keep, tool, gate, status: a row for each gate of each tool; a gate that no fact answers is unknown.

    Where the column `started` is not true, all gates are pending.
    """
    facts = tool_facts(runs)
    state = lambda g: F.when(facts[g], "passed").otherwise("failed") if g in facts else F.lit("unknown")
    waits = ~_is(F.col(started)) if started else F.lit(False)
    rows = [F.struct(F.lit(t).alias("tool"), F.lit(g).alias("gate"), F.when(waits, "pending").otherwise(state(g)).alias("status")) for t, gates in tools.items() for g in gates]
    return runs.select(*keep, F.explode(F.array(*rows)).alias("_g")).select(*keep, "_g.*")


def precheck_runs(sets: DataFrame) -> DataFrame:
    """eligibility and reasons of data sets, a row for each.

    Columns: source_type, hash_matches, evidence_source; analysis_allowed, license; required, matched, in_review: numbers
    of fields; units_documented; time_valid, seconds, stated_seconds, sampling_evidence; normalization, manifest; rows,
    target_rows. Null is not established. Without a reason a set is ELIGIBLE; else the gravest reason names its class.
    """
    c = F.col
    legal = _is(c("analysis_allowed")) & _is(c("license") != "")
    physical = _is((c("normalization") == "physical") | ((c("normalization") == "restored") & (c("manifest") != "")))
    whole = _is(c("matched") == c("required"))
    ok = {
        "source": c("source_type").isin(*REAL_SOURCES) & c("hash_matches") & (c("evidence_source") != ""), "license": legal, "fields": whole, "units": c("units_documented"),
        "time": c("time_valid") & (c("seconds") == c("stated_seconds")) & (c("sampling_evidence") != ""), "normalization": physical, "rows": (c("rows") >= LEAST_ROWS) & (c("target_rows") > 0),
    }
    reasons = _names(ok)
    missing = _is(c("required") - c("matched") - c("in_review") > 0)
    kind = F.when(F.size(reasons) == 0, "ELIGIBLE").when(_is(c("source_type").isin(*UNREAL_SOURCES)) | ~legal, "UNUSABLE").when(~physical, "NORMALIZATION_BLOCKED")
    kind = kind.when(missing, "DATA_LIMITED").when(_is(c("in_review") > 0), "REVIEW_BLOCKED").otherwise("METADATA_LIMITED")
    return sets.withColumns({"eligibility": kind, "reasons": reasons})
