"""Models fitted for every user of the events, and the gates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.functions.numeric import correlation
from kilnworks.operators import gates
from kilnworks.operators.series import INPUTS, OUTPUT

from .base import query, r6, sql_r6, table

MEASURES = ("r2", "rmse", "improvement", "acf", "acf_bound", "multi_rmse", "multi_baseline", "sim_r2")
FIELDS = (*INPUTS, OUTPUT)
NAMED = ", ".join(f"'{c}'" for c in FIELDS)

_AHEAD = " + ".join([*(f"a ** {i} * lag(push, {i}) OVER w" for i in range(gates.STEPS)), f"a ** {gates.STEPS} * lag(y, {gates.STEPS}) OVER w"])
_LAGS = range(1, gates.RESIDUAL_LAGS + 1)
NUMBERED = f"""N AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY run) AS n, lag(y) OVER w AS y1, lag(u) OVER w AS u1
    FROM (SELECT user_id AS run, date_trunc('hour', ts) AS h, avg(value) AS y, CAST(count(*) AS DOUBLE) AS u FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY run ORDER BY h)),
  R AS (SELECT *, CASE WHEN rn <= n * 6 // 10 THEN 'train' WHEN rn <= n * 8 // 10 THEN 'validation' ELSE 'test' END AS part FROM N)"""
FITS = f"""{NUMBERED},
  A AS (SELECT run, avg(y) AS my, avg(y1) AS m1, avg(u1) AS mu, var_pop(y1) AS v1, var_pop(u1) AS v2, covar_pop(y1, u1) AS c12, covar_pop(y, y1) AS c1, covar_pop(y, u1) AS c2
    FROM R WHERE part = 'train' AND y IS NOT NULL AND y1 IS NOT NULL AND u1 IS NOT NULL GROUP BY 1),
  B AS (SELECT run, my, m1, mu, c1 / v1 AS a0, (c1 * v2 - c2 * c12) / det AS a1, (c2 * v1 - c1 * c12) / det AS b1 FROM (SELECT *, CASE WHEN v1 * v2 - c12 * c12 > 1e-9 * v1 * v2 THEN v1 * v2 - c12 * c12 END AS det FROM A WHERE v1 > 1e-12)),
  C AS (SELECT *, my - a0 * m1 AS c0, my - a1 * m1 - b1 * mu AS cc FROM B),
  J AS (SELECT run, round(avg((y - c0 - a0 * y1) ** 2), 9) AS e0, round(avg((y - cc - a1 * y1 - b1 * u1) ** 2), 9) AS e1 FROM R JOIN C USING (run) WHERE part = 'validation' AND y IS NOT NULL AND y1 IS NOT NULL AND u1 IS NOT NULL GROUP BY 1),
  F AS (SELECT run, CASE WHEN e1 < e0 THEN 'ARX' ELSE 'AR' END AS family, CASE WHEN e1 < e0 THEN a1 ELSE a0 END AS a, CASE WHEN e1 < e0 THEN b1 ELSE 0 END AS b, CASE WHEN e1 < e0 THEN cc ELSE c0 END AS c FROM J JOIN C USING (run))"""
EVIDENCE = f"""{FITS},
  P AS (SELECT R.*, family, a, c + b * u1 AS push FROM R JOIN F USING (run)),
  E AS (SELECT *, lag(y, {gates.STEPS}) OVER w AS far, {_AHEAD} AS ahead, CASE WHEN part = 'test' THEN y - push - a * y1 END AS e FROM P WINDOW w AS (PARTITION BY run ORDER BY rn)),
  K AS (SELECT *, {", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in _LAGS)}, (rn - n * 8 // 10 - 1) // {gates.STRETCH} AS stretch FROM E WINDOW w AS (PARTITION BY run ORDER BY rn)),
  T AS (SELECT * FROM K WHERE part = 'test'),
  S AS (SELECT t.run, t.y, t.rn, sum(t.a ** (t.rn - p.rn) * p.push) + t.a ** (t.rn - f.rn + 1) * f.y1 AS s FROM T t JOIN T p ON p.run = t.run AND p.stretch = t.stretch AND p.rn <= t.rn
    JOIN (SELECT run, stretch, min(rn) AS rn, arg_min(y1, rn) AS y1 FROM T GROUP BY 1, 2) f ON f.run = t.run AND f.stretch = t.stretch GROUP BY t.run, t.y, t.rn, t.a, f.rn, f.y1),
  Z AS (SELECT run, CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - sum((y - s) ** 2) / (count(*) * var_pop(y)) END AS sim_r2, bool_or(abs(s) >= 1e12) AS diverged FROM S GROUP BY 1),
  X AS (SELECT run, family, count(e) AS n_test, 1 - sum(e * e) / nullif(count(e) * var_pop(y), 0) AS r2, sqrt(sum(e * e) / count(e)) AS rmse, sqrt(avg((y - y1) ** 2)) AS base,
      greatest({", ".join(f"abs(sum(e * e{k}))" for k in _LAGS)}) / nullif(sum(e * e), 0) AS acf, 1.96 / sqrt(count(e)) AS acf_bound,
      sqrt(avg((y - ahead) ** 2)) AS multi_rmse, sqrt(avg(CASE WHEN ahead IS NOT NULL THEN (y - far) ** 2 END)) AS multi_baseline, abs(a) < 1 AS stable FROM T GROUP BY run, family, a),
  V AS (SELECT *, 100 * (base - rmse) / nullif(base, 0) AS improvement FROM X LEFT JOIN Z USING (run))"""


def samples(s: SparkSession, d: str) -> DataFrame:
    """run, h, y, u: each user's hours with events; their mean value and number. Hot users meet here, before any window."""
    e = table(s, d, "events")
    return e.groupBy(F.col("user_id").alias("run"), F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("y"), F.count(F.lit(1)).cast("double").alias("u"))


def evidence(s: SparkSession, d: str) -> DataFrame:
    rows = gates.numbered(samples(s, d))
    return gates.test_evidence(rows, gates.fit_runs(rows))


@query("q_run_models", f"WITH {FITS} SELECT run, family, {sql_r6('a', 'b', 'c')} FROM F")
def run_models(s: SparkSession, d: str) -> DataFrame:
    """A model for each user, with or without the input, fitted and chosen by two aggregates for all."""
    return gates.fit_runs(gates.numbered(samples(s, d))).select("run", "family", *r6("a", "b", "c"))


@query("q_run_tests", f"WITH {EVIDENCE} SELECT run, family, n_test, stable, diverged, {sql_r6(*MEASURES)} FROM V")
def run_tests(s: SparkSession, d: str) -> DataFrame:
    return evidence(s, d).select("run", "family", "n_test", "stable", "diverged", *r6(*MEASURES))


RECORDS = f"""D AS (SELECT user_id AS run, count(*) AS rows, count(CASE WHEN event_type = '{OUTPUT}' THEN value END) AS target_rows, count(DISTINCT CASE WHEN event_type IN ({NAMED}) THEN event_type END) AS matched,
    100.0 * count(value) / count(*) AS quality, count(DISTINCT event_type) - count(DISTINCT CASE WHEN event_type IN ({NAMED}) THEN event_type END) AS other, count(DISTINCT ts) = count(*) AS time_valid FROM events GROUP BY 1)"""


def records(s: SparkSession, d: str) -> DataFrame:
    """What each user's events say of themselves: fields are event types, and the required ones are inputs and output."""
    e, named = table(s, d, "events"), F.col("event_type").isin(*FIELDS)
    # counts for each user and type first, so that distinct counts never see the rows of a hot user
    kinds = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("v"))
    times = e.groupBy("user_id", "ts").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg((F.coalesce(F.max("n"), F.lit(1)) == 1).alias("once"), F.bool_and(F.col("ts").isNotNull()).alias("all"))
    found = kinds.groupBy("user_id").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("event_type") == OUTPUT, F.col("v"))), F.lit(0).cast("long")).alias("target_rows"), F.count(F.when(named, 1)).alias("matched"),
        (F.sum("v") * 100.0 / F.sum("n")).alias("quality"), (F.count("event_type") - F.count(F.when(named, 1))).alias("other"),
    )
    return found.join(times, "user_id").withColumn("time_valid", F.col("once") & F.col("all")).drop("once", "all").withColumnRenamed("user_id", "run")


_BLOCKERS = f"""CASE WHEN matched < 2 THEN ['standardization_rejected'] ELSE [] END || CASE WHEN quality >= {gates.LEAST_QUALITY} THEN [] ELSE ['low_quality'] END || CASE WHEN r2 IS NULL THEN ['no_test_measure'] ELSE [] END
    || CASE WHEN r2 < 0 THEN ['negative_r2'] ELSE [] END || CASE WHEN improvement IS NULL THEN ['no_baseline'] ELSE [] END || CASE WHEN improvement < {gates.LEAST_GAIN} THEN ['little_gain'] ELSE [] END
    || CASE WHEN family = 'AR' THEN ['output_alone'] ELSE [] END || CASE WHEN stable THEN [] ELSE ['unstable'] END || CASE WHEN multi_rmse < multi_baseline THEN [] ELSE ['long_forecast'] END
    || CASE WHEN sim_r2 >= 0 AND NOT coalesce(diverged, false) THEN [] ELSE ['simulation'] END"""


@query("q_run_review", f"""WITH {EVIDENCE}, {RECORDS}, G AS (SELECT *, {_BLOCKERS} AS b, coalesce(matched = {len(FIELDS)} AND quality >= {gates.LEAST_QUALITY} AND r2 >= 0 AND improvement >= {gates.LEAST_GAIN} AND stable
    AND multi_rmse < multi_baseline AND sim_r2 >= 0 AND NOT coalesce(diverged, false), false) AS offline, coalesce(family = 'ARX', false) AS external, coalesce(acf <= acf_bound, false) AS white FROM D LEFT JOIN V USING (run))
  SELECT run, len(b) = 0 AS passed, array_to_string(b, ',') AS blockers, offline, CASE WHEN external THEN 0 ELSE 1 END + CASE WHEN white THEN 0 ELSE 1 END + 3 + len([x FOR x IN [matched = {len(FIELDS)}, quality >= {gates.LEAST_QUALITY},
    coalesce(r2 >= 0 AND improvement >= {gates.LEAST_GAIN}, false), coalesce(stable AND multi_rmse < multi_baseline AND sim_r2 >= 0 AND NOT coalesce(diverged, false), false)] IF NOT x]) AS sensor_gates, external, white FROM G""")
def run_review(s: SparkSession, d: str) -> DataFrame:
    """Every user's model before the whole review; users that cannot be fitted have blockers for what is missing."""
    c = F.col
    facts = records(s, d).join(evidence(s, d), "run", "left").withColumns({
        "required_coverage": c("matched") / len(FIELDS), "decision": F.when(c("matched") < 2, "reject").when(c("matched") < len(FIELDS), "review").otherwise("ready"),
        "time_axis": F.lit("wall_clock"), "fitted_inputs": F.when(c("family") == "ARX", F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")),
    })
    g = gates.review_runs(facts)
    lacks = lambda name: ~F.array_contains("sensor_failed", name)
    return g.select("run", "passed", F.array_join("blockers", ",").alias("blockers"), (F.size("offline_failed") == 0).alias("offline"), F.size("sensor_failed").cast("long").alias("sensor_gates"), lacks("external_inputs_used").alias("external"), lacks("residual_whiteness").alias("white"))


_FACTS = {
    "training_partition_only": "split", "minimum_valid_samples": "coalesce(n_test > 0, false)", "score_components_available": "quality IS NOT NULL", "no_synthetic_fallback": "true",
    "causal_delay": "family IS NOT NULL", "maximum_lag_bound": "family IS NOT NULL", "common_validation_targets": "checked IS NOT NULL", "reproducible_fit": "family IS NOT NULL",
    "vif_or_correlation_evidence": "coalesce(related, false)", "residual_diagnostics": "acf IS NOT NULL", "real_data_only": "true", "frozen_split_unchanged": "split AND checked IS NOT NULL", "validation_hash_identical_across_candidates": "checked IS NOT NULL",
    "test_not_in_objective": "true", "single_final_test": "family IS NOT NULL", "bounded_search": "true", "stopping_reason_recorded": "family IS NOT NULL",
}
_GATES_SQL = " UNION ALL ".join(f"SELECT run, '{tool}' AS tool, '{g}' AS gate, CASE WHEN rows < 30 THEN 'pending' WHEN {_FACTS.get(g, 'NULL')} THEN 'passed' WHEN NOT ({_FACTS.get(g, 'NULL')}) THEN 'failed' ELSE 'unknown' END AS status FROM O" for tool, names in gates.TOOLS.items() for g in names)


@query("q_run_tool_gates", f"""WITH {EVIDENCE}, {RECORDS}, W AS (SELECT run, bool_or(part = 'train') AS split, sum(CASE WHEN part = 'validation' AND y1 IS NOT NULL AND u1 IS NOT NULL AND y IS NOT NULL THEN 1 END) AS checked, var_pop(CASE WHEN part = 'train' AND y1 IS NOT NULL AND u1 IS NOT NULL THEN y1 END) > 0 AND var_pop(CASE WHEN part = 'train' AND y1 IS NOT NULL AND u1 IS NOT NULL THEN u1 END) > 0 AS related FROM R GROUP BY 1),
  O AS (SELECT * FROM D JOIN W USING (run) LEFT JOIN V USING (run)) SELECT tool, gate, status, count(*) AS runs, CAST(sum(run) AS BIGINT) AS run_sum FROM ({_GATES_SQL}) GROUP BY 1, 2, 3""")
def run_tool_gates(s: SparkSession, d: str) -> DataFrame:
    """All facts of all tools for each user; those of users with fewer than 30 events are pending."""
    c, none = F.col, F.lit(None)
    rows = gates.numbered(samples(s, d))
    whole = c("y").isNotNull() & c("y1").isNotNull() & c("u1").isNotNull()
    both = (c("part") == "train") & c("y1").isNotNull() & c("u1").isNotNull()
    # both candidates are judged on the rows whose times make the digest
    parts = rows.groupBy("run").agg(F.bool_or(c("part") == "train").alias("has_train"), F.sum(F.when((c("part") == "validation") & whole, F.xxhash64("h") % (1 << 31))).alias("validation_hash"), correlation(F.when(both, c("y1")), F.when(both, c("u1"))).alias("related"))
    x = records(s, d).join(parts, "run").join(evidence(s, d), "run", "left")
    fitted = c("family").isNotNull()
    lag = F.array(F.struct(F.lit(1).alias("delay"), F.lit(1).alias("max_lag")))
    x = x.withColumns({
        "split": F.when(c("has_train"), "60/20/20"), "protocol": F.when(c("has_train"), "by time"), "segments": c("n_test"), "score_components": c("quality"), "synthetic_fallback": F.lit(False), "lags": F.when(fitted, lag), "collinearity": c("related"),
        "config": c("family"), "diagnostics": c("acf").isNotNull(), "test_in_search": F.lit(False), "test_evaluations": F.when(fitted, 1), "max_rounds": F.lit(2), "stop_reason": F.when(fitted, F.lit("all candidates tried")).otherwise(none), "started": c("rows") >= 30,
    })
    return gates.tool_results(x, started="started").groupBy("tool", "gate", "status").agg(F.count(F.lit(1)).alias("runs"), F.sum("run").alias("run_sum"))


_META = """M AS (SELECT c_custkey AS run, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'REAL_PLANT' WHEN 'BUILDING' THEN 'PUBLIC_EXPERIMENT' WHEN 'FURNITURE' THEN 'DERIVED_REAL' WHEN 'MACHINERY' THEN 'BENCHMARK_REAL' ELSE 'SYNTHETIC' END AS source_type,
    c_acctbal > -500 AS analysis_allowed, CASE c_nationkey % 4 WHEN 3 THEN 'standardised' WHEN 2 THEN 'restored' ELSE 'physical' END AS normalization, c_name AS manifest FROM customer)"""


@query("q_run_precheck", f"""WITH {RECORDS}, {_META}, X AS (SELECT run, coalesce(source_type <> 'SYNTHETIC', false) AS real, coalesce(source_type = 'SYNTHETIC', false) AS unreal, coalesce(analysis_allowed, false) AS legal, matched, other, time_valid, rows, target_rows,
    coalesce(normalization = 'physical' OR normalization = 'restored' AND manifest <> '', false) AS physical FROM D LEFT JOIN M USING (run)),
  Y AS (SELECT *, CASE WHEN real THEN [] ELSE ['source'] END || CASE WHEN legal THEN [] ELSE ['license'] END || CASE WHEN matched = {len(FIELDS)} THEN [] ELSE ['fields'] END || CASE WHEN time_valid THEN [] ELSE ['time'] END
    || CASE WHEN physical THEN [] ELSE ['normalization'] END || CASE WHEN rows >= {gates.LEAST_ROWS} AND target_rows > 0 THEN [] ELSE ['rows'] END AS r FROM X)
  SELECT run, array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN 'ELIGIBLE' WHEN unreal OR NOT legal THEN 'UNUSABLE' WHEN NOT physical THEN 'NORMALIZATION_BLOCKED' WHEN {len(FIELDS)} - matched - least(other, {len(FIELDS)} - matched) > 0 THEN 'DATA_LIMITED'
    WHEN least(other, {len(FIELDS)} - matched) > 0 THEN 'REVIEW_BLOCKED' ELSE 'METADATA_LIMITED' END AS eligibility FROM Y""")
def run_precheck(s: SparkSession, d: str) -> DataFrame:
    """Every user's events as a data set; customers of that key stand for what is documented of it, other event types for fields in review."""
    c = F.col
    kinds = F.create_map(*[F.lit(x) for x in ("AUTOMOBILE", "REAL_PLANT", "BUILDING", "PUBLIC_EXPERIMENT", "FURNITURE", "DERIVED_REAL", "MACHINERY", "BENCHMARK_REAL")])
    nation = F.pmod("c_nationkey", F.lit(4))
    known = table(s, d, "customer").select(
        c("c_custkey").alias("run"), F.coalesce(kinds[c("c_mktsegment")], F.lit("SYNTHETIC")).alias("source_type"), (c("c_acctbal") > -500).alias("analysis_allowed"),
        F.when(nation == 3, "standardised").when(nation == 2, "restored").otherwise("physical").alias("normalization"), c("c_name").alias("manifest"),
    )
    sets = records(s, d).join(known, "run", "left").withColumns({
        "required": F.lit(len(FIELDS)), "in_review": F.least("other", len(FIELDS) - c("matched")), "hash_matches": F.lit(True), "evidence_source": F.lit("customer"), "license": F.lit("stated"),
        "units_documented": F.lit(True), "seconds": F.lit(3600), "stated_seconds": F.lit(3600), "sampling_evidence": F.lit("grid"),
    })
    return gates.precheck_runs(sets).select("run", F.array_join("reasons", ",").alias("reasons"), "eligibility")
