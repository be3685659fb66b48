"""Queries of identification, search, gates and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnworks.functions.numeric import clip
from kilnworks.operators import identification as ident
from kilnworks.operators import policy, scan, search, series, stats
from kilnworks.operators.series import INPUTS, OUTPUT

from .process import artifact
from .base import FILLED, P, corr_sql, filled, frame, query, r6, table

SEG = P + """, O AS (SELECT * FROM P WHERE purchase IS NOT NULL), S AS (SELECT *, sum(CASE WHEN h - ph = 1 THEN 0 ELSE 1 END) OVER (ORDER BY h) AS segment FROM (SELECT *, lag(h) OVER (ORDER BY h) AS ph FROM O))"""
LAGS = SEG + ", GG AS (SELECT h, segment, purchase AS y, lag(purchase) OVER w AS y1, lag(click, 2) OVER w AS u2, row_number() OVER w - 1 AS age FROM S WINDOW w AS (PARTITION BY segment ORDER BY h)), W AS (SELECT * FROM GG WHERE y IS NOT NULL AND y1 IS NOT NULL AND u2 IS NOT NULL)"


def segmented(s: SparkSession, d: str) -> DataFrame:
    return series.segments(frame(s, d).filter(F.col(OUTPUT).isNotNull()), 1, "h")


def lag_frame(s: SparkSession, d: str) -> DataFrame:
    w = series.ordered("h", ["segment"])
    return segmented(s, d).select("h", "segment", F.col(OUTPUT).alias("y"), F.lag(OUTPUT).over(w).alias("y1"), F.lag("click", 2).over(w).alias("u2"), (F.row_number().over(w) - 1).alias("age"))


@query("q_ols2", f"WITH {LAGS} SELECT round(regr_intercept(y, y1), 6) AS intercept, round(regr_slope(y, y1), 6) AS slope FROM W")
def ols2(s: SparkSession, d: str) -> DataFrame:
    c = ident.solve(*ident.gram(lag_frame(s, d).dropna(), ["y1"], "y"))
    return fit_row(s, c, ["intercept", "slope"])


@query("q_ridge1", f"WITH {LAGS}, a AS (SELECT count(*) AS n, avg(y1) AS mx, avg(y) AS my, covar_pop(y1, y) AS c, var_pop(y1) AS v FROM W), b AS (SELECT *, (c / sqrt(v) * n) / (n + 10) / sqrt(v) AS slope FROM a) SELECT round(my - slope * mx, 6) AS intercept, round(slope, 6) AS slope FROM b")
def ridge1(s: SparkSession, d: str) -> DataFrame:
    c = ident.solve(*ident.gram(lag_frame(s, d).dropna(), ["y1"], "y"), alpha=10)
    return fit_row(s, c, ["intercept", "slope"])


@query("q_arx1", f"WITH {LAGS}, a AS (SELECT avg(y) AS my, avg(y1) AS m1, avg(u2) AS m2, var_pop(y1) AS v1, var_pop(u2) AS v2, covar_pop(y1, u2) AS c12, covar_pop(y, y1) AS c1, covar_pop(y, u2) AS c2 FROM W), b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS a1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM a) SELECT round(my - a1 * m1 - b2 * m2, 6) AS intercept, round(a1, 6) AS a1, round(b2, 6) AS b2 FROM b")
def arx1(s: SparkSession, d: str) -> DataFrame:
    c = ident.solve(*ident.gram(lag_frame(s, d).dropna(), ["y1", "u2"], "y"))
    return fit_row(s, c, ["intercept", "a1", "b2"])


MODEL = [20.0, 0.6, 0.2]


def fit_row(s: SparkSession, fit, names: list[str]) -> DataFrame:
    """The fit's numbers as one row, rounded; nulls where there were too few rows to fit."""
    values = [None] * len(names) if fit is None else [round(float(x), 6) for x in fit]
    return s.createDataFrame([tuple(values)], ", ".join(f"{n} double" for n in names))


@query("q_predict", f"WITH {LAGS} SELECT h, round(20 + .6 * y1 + .2 * u2, 6) AS predicted, round(y - (20 + .6 * y1 + .2 * u2), 6) AS residual FROM W")
def predict(s: SparkSession, d: str) -> DataFrame:
    p = ident.prediction(MODEL, ["y1", "u2"])
    return lag_frame(s, d).dropna().select("h", F.round(p, 6).alias("predicted"), F.round(F.col("y") - p, 6).alias("residual"))


COMMON = FILLED + """, X AS (SELECT rn, h, purchase AS y, lag(purchase) OVER o AS y1, lag(purchase, 2) OVER o AS y2, lag(purchase, 3) OVER o AS y3, lag(click, 2) OVER o AS u2, row_number() OVER o - 1 AS age,
    sum(CASE WHEN view IS NULL OR click IS NULL OR signup IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY rn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS gaps FROM Q WINDOW o AS (ORDER BY rn)),
  M AS (SELECT * FROM X WHERE age >= 5 AND gaps = 0 AND y IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL AND y3 IS NOT NULL)"""


@query("q_one_step_eval", f"""WITH {COMMON}, C AS (SELECT 'ARX' AS model, h, y, y1, 20 + .6 * y1 + .2 * u2 AS p FROM M UNION ALL SELECT 'AR', h, y, y1, 50 + .5 * y1 FROM M),
  a AS (SELECT model, count(*) AS n, count(h) || ':' || CAST(sum(CAST(CAST('0x' || substr(sha256(CAST(h AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST(CAST('0x' || substr(sha256(CAST(h AS VARCHAR)), 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS targets, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) ** 2) / nullif(count(*) * var_pop(y), 0) AS r2, sqrt(avg((y - y1) ** 2)) AS baseline FROM C GROUP BY 1)
  SELECT model, n, targets, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, round(baseline, 6) AS baseline, round(CASE WHEN baseline > 0 THEN 100 * (baseline - rmse) / baseline END, 6) AS improvement FROM a WHERE n >= 10""")
def one_step_eval(s: SparkSession, d: str) -> DataFrame:
    """Two candidates on the same targets, which `targets` shows."""
    df = series.segments(filled(s, d), 1, "h")
    w = series.ordered("h", ["segment"])
    m = ident.common_targets(df, OUTPUT, INPUTS, 5, "h").withColumns({"y1": F.lag(OUTPUT).over(w), "u2": F.lag("click", 2).over(w)}).filter("common")
    found = []
    for model, coefficients, features in (("ARX", MODEL, ["y1", "u2"]), ("AR", [50.0, 0.5], ["y1"])):
        p = m.withColumn("p", ident.prediction(coefficients, features))
        measures = stats.regression_metrics(F.col(OUTPUT), F.col("p"), len(coefficients))
        found.append(p.agg(F.lit(model).alias("model"), measures["n"].alias("n"), ident.target_check("h").alias("targets"), *[measures[k].alias(k) for k in ("rmse", "mae", "r2")], F.sqrt(F.avg((F.col(OUTPUT) - F.col("y1")) ** 2)).alias("baseline")))
    a = found[0].unionByName(found[1]).filter("n >= 10")
    return a.select("model", "n", "targets", *r6("rmse", "mae", "r2", "baseline"), F.round(F.when(F.col("baseline") > 0, 100 * (F.col("baseline") - F.col("rmse")) / F.col("baseline")), 6).alias("improvement"))


def _ten_sql() -> str:
    x = "lag(purchase, 10) OVER w"
    for _ in range(10):
        x = f"(50 + .5 * {x})"
    return x


@query("q_ten_step", f"WITH {SEG} SELECT h, round({_ten_sql()}, 6) AS forecast FROM S WINDOW w AS (PARTITION BY segment ORDER BY h)")
def ten_step(s: SparkSession, d: str) -> DataFrame:
    df = segmented(s, d)
    return df.select("h", F.round(ident.ten_steps(df, 50.0, [0.5], OUTPUT, 10, "h"), 6).alias("forecast"))


@query("q_free_sim", f"""WITH RECURSIVE {FILLED}, X AS (SELECT rn, h, row_number() OVER o - 1 AS age, lag(purchase) OVER o AS y1, lag(purchase, 2) OVER o AS y2, 20 + .2 * lag(click, 2) OVER o + .1 * lag(view) OVER o - .05 * lag(click, 3) OVER o AS push FROM Q WINDOW o AS (ORDER BY rn)),
  B AS (SELECT min(age) AS start FROM X WHERE age >= 7 AND y1 IS NOT NULL AND y2 IS NOT NULL AND push IS NOT NULL),
  Z AS (SELECT age, h, push + .5 * y1 + .1 * y2 AS y, CAST(y1 AS DOUBLE) AS p FROM X, B WHERE age = start UNION ALL SELECT X.age, X.h, X.push + .5 * Z.y + .1 * Z.p, Z.y FROM Z JOIN X ON X.age = Z.age + 1)
  SELECT h, round(y, 6) AS simulated, coalesce(y IS NULL OR abs(y) >= 1e12, true) AS diverged FROM Z""")
def free_sim(s: SparkSession, d: str) -> DataFrame:
    """A model of order 2 with two inputs, from the first whole history after the guard."""
    df = series.segments(filled(s, d), 1, "h")
    found = ident.free_simulation(df, 20.0, [0.5, 0.1], [("click", 2, 0.2), ("view", 1, 0.1), ("click", 3, -0.05)], OUTPUT, 7, "h")
    return found.select("h", F.round("simulated", 6).alias("simulated"), "diverged")


@query("q_firx_eval", f"WITH {P}, x AS (SELECT purchase AS y, last_value(purchase IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base, 30 + .4 * lag(click) OVER (ORDER BY rn) + .3 * lag(view, 2) OVER (ORDER BY rn) AS p FROM P), m AS (SELECT * FROM x WHERE y IS NOT NULL AND p IS NOT NULL AND base IS NOT NULL) SELECT count(*) AS n, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(sqrt(avg((y - base) ** 2)), 6) AS baseline, 'not_applicable' AS multi_step FROM m")
def firx_eval(s: SparkSession, d: str) -> DataFrame:
    """A sparse target without autoregressive terms is judged one step ahead alone, against the last value measured."""
    w = series.ordered("rn")
    base = F.last(OUTPUT, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = frame(s, d).select(F.col(OUTPUT).alias("y"), base.alias("base"), (30 + 0.4 * F.lag("click").over(w) + 0.3 * F.lag("view", 2).over(w)).alias("p")).dropna()
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)), 6).alias("rmse"), F.round(F.sqrt(F.avg((F.col("y") - F.col("base")) ** 2)), 6).alias("baseline"), F.lit("not_applicable").alias("multi_step"))


@query("q_pole1", f"WITH {LAGS} SELECT round(regr_slope(y, y1), 6) AS pole, abs(regr_slope(y, y1)) < 1 AS stable FROM W")
def pole1(s: SparkSession, d: str) -> DataFrame:
    c = ident.solve(*ident.gram(lag_frame(s, d).dropna(), ["y1"], "y"))
    return s.createDataFrame([(None, None) if c is None else (round(float(c[1]), 6), ident.is_stable(c[1:]))], "pole double, stable boolean")


@query("q_structure_search")
def structure_search(s: SparkSession, d: str) -> DataFrame:
    split = series.time_split(artifact(s, d, "segments"), order="h")
    found = ident.search(split, OUTPUT, {"click": 2, "view": 1}, (1, 2, 3), (0.0, 1.0, 10.0), "h")
    rows = [(c["family"], c["order"], c["alpha"], c["stable"], round(float(c["mse"]), 6), round(c["bic"], 6), c["winner"]) for c in found]
    return s.createDataFrame(rows, "family string, model_order int, alpha double, stable boolean, mse double, bic double, winner boolean")


@query("q_real_search")
def real_search(s: SparkSession, d: str) -> DataFrame:
    """Every round of a search over the hourly frame, the winner's with its only look at the test rows."""
    split = scan.time_split(filled(s, d), order="rn", width=256)
    return search.rounds_frame(s, search.Search(split, INPUTS, OUTPUT).run(max_lag=24))


@query("q_mimo_bank")
def mimo_bank(s: SparkSession, d: str) -> DataFrame:
    """One model for each output over shared inputs; each one's covariances are one aggregate."""
    df = series.segments(frame(s, d), 1, "h")
    rows = []
    for output in (OUTPUT, "error"):
        features = ident.lag_names(1, {c: 1 for c in INPUTS}, output)
        names = [n for n, _, _ in features]
        c = ident.solve(*ident.gram(ident.feature_frame(df, features, "h"), names, output), alpha=1.0)
        rows += [(output, n, round(float(x), 6)) for n, x in zip(["intercept", *names], () if c is None else c)]
    return s.createDataFrame(rows, "output string, term string, coefficient double")


@query("q_legacy_model")
def legacy_model(s: SparkSession, d: str) -> DataFrame:
    """The older chain: delays both ways, shifted inputs, collinear ones left out, least squares on the first 70 %."""
    df = series.interpolate_linear(frame(s, d), [*INPUTS, OUTPUT])
    delays = {r["input"]: max(0, r["delay"]) for r in stats.best_lags(stats.lag_correlations(df, list(INPUTS), OUTPUT, range(-6, 7), "rn")).collect()}  # a row for each input
    shifted = df.withColumns({f"{c}_aligned": series.lagged(c, k, keys=()) for c, k in delays.items()})
    names = [f"{c}_aligned" for c in delays]
    groups = stats.correlated_groups(stats.correlation_matrix(shifted, names), names)
    shifted, inside = stats.merge_groups(shifted, groups), {c for g in groups for c in g}
    names = [n for n in names if n not in inside] + [f"merged_{i + 1}" for i in range(len(groups))]
    m = stats.correlation_matrix(shifted, [*names, OUTPUT])
    kept = [n for n, ok, _ in stats.recommend(m[:-1, :-1], m[-1, :-1], names) if ok]
    split = series.time_split(shifted, (0.7, 0.0))
    c = ident.solve(*ident.gram(split.filter("part = 'train'"), kept, OUTPUT))
    measures = stats.regression_metrics(F.col(OUTPUT), ident.prediction(c, kept), len(c))
    return split.filter("part = 'test'").agg(*[F.round(measures[k], 6).alias(k) for k in ("rmse", "mae", "r2")])


#: Inputs of the response models and their delays; each is fitted alone with the output's last value.
CHANNEL_DELAYS = {"click": 2, "view": 1}
CHANNEL = SEG + ", C AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS input, {k} AS delay, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS a, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b FROM (SELECT var_pop(y1) AS v1, var_pop(u) AS v2, covar_pop(y1, u) AS c12, covar_pop(y, y1) AS c1, covar_pop(y, u) AS c2, count(*) AS n FROM (SELECT purchase AS y, lag(purchase) OVER w AS y1, lag({c}, {k}) OVER w AS u FROM S WINDOW w AS (PARTITION BY segment ORDER BY h)) WHERE y IS NOT NULL AND y1 IS NOT NULL AND u IS NOT NULL) WHERE n >= 20"
    for c, k in CHANNEL_DELAYS.items()) + ")"


def fitted_channels(s: SparkSession, d: str) -> DataFrame:
    """Models of the hourly frame, a row for each input; inputs that cannot be fitted have none."""
    df, rows = segmented(s, d), []
    for c, delay in CHANNEL_DELAYS.items():
        features = ident.lag_names(1, {c: delay}, OUTPUT)
        names = [n for n, _, _ in features]
        fit = ident.solve(*ident.gram(ident.feature_frame(df, features, "h"), names, OUTPUT))
        if fit is not None:
            rows.append((c, delay, [float(fit[2])], [float(fit[1])]))
    return s.createDataFrame(rows, ident.CHANNELS)


@query("q_step_response", f"""WITH {CHANNEL} SELECT input, CAST(k AS INTEGER) AS k, round(CASE WHEN k < delay THEN 0 ELSE b * a ** (k - delay) END, 6) AS impulse, round(CASE WHEN k < delay THEN 0 ELSE b * (1 - a ** (k - delay + 1)) / (1 - a) END, 6) AS response, round(b / (1 - a), 6) AS dc_gain FROM C, range(120) t(k)""")
def step_response(s: SparkSession, d: str) -> DataFrame:
    """Of the fitted models; the SQL has the closed forms of order one."""
    return ident.responses(fitted_channels(s, d)).select("input", "k", *r6("impulse"), F.round("step", 6).alias("response"), *r6("dc_gain"))


@query("q_freq_response", f"""WITH {CHANNEL}, W AS (SELECT C.*, k, k * (pi() / 95) AS w FROM C, range(96) t(k)),
  N AS (SELECT *, b * cos(w * delay) AS rn, -(b * sin(w * delay)) AS jn, 1 - a * cos(w) AS rd, a * sin(w) AS jd FROM W),
  Q AS (SELECT *, (rn * rd + jn * jd) / (rd * rd + jd * jd) AS re, (jn * rd - rn * jd) / (rd * rd + jd * jd) AS im FROM N)
  SELECT input, CAST(k AS INTEGER) AS k, round(w / (2 * pi() * 3600), 9) AS hz, round(20 * log10(greatest(sqrt(re * re + im * im), 1e-12)), 6) AS magnitude_db, round(re / sqrt(re * re + im * im), 4) + 0 AS phase_cos, round(im / sqrt(re * re + im * im), 4) + 0 AS phase_sin FROM Q""")
def freq_response(s: SparkSession, d: str) -> DataFrame:
    """All points; the phase is compared by its cosine and sine, which have no edge at 180 degrees."""
    f = ident.frequency_responses(fitted_channels(s, d), 3600.0)
    return f.select("input", "k", F.round("hz", 9).alias("hz"), *r6("magnitude_db"), (F.round(F.cos(F.radians("phase")), 4) + 0).alias("phase_cos"), (F.round(F.sin(F.radians("phase")), 4) + 0).alias("phase_sin"))


# search, gates and policies over runs: a day's line items stand for a candidate's evaluation

RUN = "R AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_discount) * 10 AS r2, stddev_samp(l_quantity) / 20 AS rmse, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END) AS coverage, count(*) AS n FROM lineitem GROUP BY 1)"


def runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg((F.avg("l_discount") * 10).alias("r2"), (F.stddev_samp("l_quantity") / 20).alias("rmse"), F.avg((F.col("l_returnflag") == "N").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def candidate_score(r2, rmse, coverage):
    """Null where a measure is undefined."""
    return 100 * (0.68 * clip((r2 + 0.2) / 1.2, 0, 1) + 0.17 / (1 + rmse) + 0.15 * coverage)


@query("q_candidate_score", f"WITH {RUN} SELECT day, round(100 * (.68 * least(greatest((r2 + .2) / 1.2, 0), 1) + .17 / (1 + rmse) + .15 * coverage), 4) AS score, coalesce(r2 >= .3 AND coverage >= .5, false) AS feasible FROM R")
def candidate(s: SparkSession, d: str) -> DataFrame:
    return runs(s, d).select("day", F.round(candidate_score(F.col("r2"), F.col("rmse"), F.col("coverage")), 4).alias("score"), F.coalesce((F.round("r2", 9) >= 0.3) & (F.col("coverage") >= 0.5), F.lit(False)).alias("feasible"))


@query("q_diag_gates", f"WITH {RUN}, g AS (SELECT day, coalesce(round(r2, 9) >= .4, false) AS fit, coalesce(rmse < .75, false) AS error, coverage >= .5 AS covered, n >= 10 AS enough, rmse IS NOT NULL AS defined FROM R) SELECT *, CASE WHEN fit AND error AND covered AND enough AND defined THEN 'success' ELSE 'partial' END AS status FROM g")
def diag_gates(s: SparkSession, d: str) -> DataFrame:
    no = F.lit(False)
    g = runs(s, d).select("day", F.coalesce(F.round("r2", 9) >= 0.4, no).alias("fit"), F.coalesce(F.col("rmse") < 0.75, no).alias("error"), (F.col("coverage") >= 0.5).alias("covered"), (F.col("n") >= 10).alias("enough"), F.col("rmse").isNotNull().alias("defined"))
    whole = F.col("fit") & F.col("error") & F.col("covered") & F.col("enough") & F.col("defined")
    return g.select("*", F.when(whole, "success").otherwise("partial").alias("status"))


@query("q_review_gates", f"WITH {RUN}, g AS (SELECT day, CASE WHEN round(r2, 9) >= .4 THEN '' ELSE 'r2 ' END || CASE WHEN coverage >= .5 THEN '' ELSE 'coverage ' END || CASE WHEN n >= 10 THEN '' ELSE 'rows ' END AS b, r2 FROM R) SELECT day, trim(b) AS blockers, b = '' AS soft_sensor, coalesce(round(r2, 9) >= 0, false) AS offline, false AS closed_loop FROM g")
def review_gates(s: SparkSession, d: str) -> DataFrame:
    ok = {"r2": F.coalesce(F.round("r2", 9) >= 0.4, F.lit(False)), "coverage": F.col("coverage") >= 0.5, "rows": F.col("n") >= 10}
    b = F.concat_ws(" ", *[F.when(~c, k) for k, c in ok.items()])
    return runs(s, d).select("day", b.alias("blockers"), (b == "").alias("soft_sensor"), F.coalesce(F.round("r2", 9) >= 0, F.lit(False)).alias("offline"), F.lit(False).alias("closed_loop"))


@query("q_safety", f"WITH {RUN} SELECT day, false AS actuation_allowed, CASE WHEN coverage < .5 THEN 'insufficient_coverage' ELSE 'advisory_only' END AS reason FROM R")
def safety(s: SparkSession, d: str) -> DataFrame:
    """Whatever the evidence, nothing may be actuated."""
    return runs(s, d).select("day", F.lit(False).alias("actuation_allowed"), F.when(F.col("coverage") < 0.5, "insufficient_coverage").otherwise("advisory_only").alias("reason"))


@query("q_tool_gates", f"WITH {RUN} SELECT gate, state, count(*) AS n FROM (SELECT 'r2' AS gate, CASE WHEN r2 IS NULL THEN 'unknown' WHEN round(r2, 9) >= .4 THEN 'passed' ELSE 'failed' END AS state FROM R UNION ALL SELECT 'rmse', CASE WHEN rmse IS NULL THEN 'unknown' WHEN rmse < .75 THEN 'passed' ELSE 'failed' END FROM R) GROUP BY 1, 2")
def tool_gates(s: SparkSession, d: str) -> DataFrame:
    state = lambda ok: F.when(ok.isNull(), "unknown").when(ok, "passed").otherwise("failed")
    g = runs(s, d).select(state(F.round("r2", 9) >= 0.4).alias("r2"), state(F.col("rmse") < 0.75).alias("rmse"))
    return g.unpivot([], ["r2", "rmse"], "gate", "state").groupBy("gate", "state").agg(F.count(F.lit(1)).alias("n"))


@query("q_artifact_state", f"WITH {RUN} SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN 'missing' WHEN n < 3 THEN 'partial' WHEN o_orderkey % 11 = 0 THEN 'not_generated' ELSE 'ready' END AS state FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def artifact_state(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"), F.count(F.lit(1)).alias("n"))
    j = table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.when(F.col("k").isNull(), "missing").when(F.col("n") < 3, "partial").when(F.col("k") % 11 == 0, "not_generated").otherwise("ready").alias("state"))


@query("q_effective_lag", "SELECT p_partkey, CAST(least(600, greatest(1, greatest(24, ceil(p_size * 60 / (10 + p_partkey % 50))))) AS BIGINT) AS lag FROM part")
def effective_lag(s: SparkSession, d: str) -> DataFrame:
    """The longest delay in samples, from minutes and the sampling period: 24 at least as configured, 600 at most."""
    needed = F.ceil(F.col("p_size") * 60 / (10 + F.col("p_partkey") % 50))
    return table(s, d, "part").select("p_partkey", F.least(F.lit(600), F.greatest(F.lit(1), F.lit(24), needed)).cast("long").alias("lag"))


@query("q_policy_merge", "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_size END, CASE WHEN p_partkey % 2 = 0 THEN 30 END, 15) AS \"window\", CASE WHEN p_size > 40 THEN 'request' WHEN p_partkey % 2 = 0 THEN 'scene' ELSE 'default' END AS origin FROM part")
def policy_merge(s: SparkSession, d: str) -> DataFrame:
    """A request's value goes before the scene's, that before the default; where it came from is kept."""
    asked, scene = F.when(F.col("p_size") > 40, F.col("p_size")), F.when(F.col("p_partkey") % 2 == 0, F.lit(30))
    return table(s, d, "part").select("p_partkey", F.coalesce(asked, scene, F.lit(15)).alias("window"), F.when(asked.isNotNull(), "request").when(scene.isNotNull(), "scene").otherwise("default").alias("origin"))


SCENES = ", ".join(f"({i}, '{name}', {policy.SCENE_SECONDS[name]}::DOUBLE)" for i, name in enumerate(sorted(policy.SCENE_SECONDS)))


@query("q_cadence_override", f"""WITH s AS (SELECT * FROM (VALUES {SCENES}) t(number, scene, seconds))
  SELECT c_custkey, p.scene AS project, f.scene AS detected,
    CASE WHEN c_custkey % 4 <> 0 AND p.scene <> f.scene THEN f.seconds ELSE 10.0 * (1 + c_custkey % 3) END AS seconds
  FROM customer LEFT JOIN s p ON c_nationkey % 7 = p.number LEFT JOIN s f ON c_custkey % 7 = f.number""")
def cadence_override(s: SparkSession, d: str) -> DataFrame:
    """Customers stand for uploads; the seventh number is a scene that is not known."""
    known = policy.scenes(s)
    project = F.broadcast(known.select(F.col("number").alias("a"), F.col("scene").alias("project")))  # six rows
    detected = F.broadcast(known.select(F.col("number").alias("b"), F.col("scene").alias("detected"), F.col("seconds").alias("own")))
    uploads = table(s, d, "customer").join(project, F.col("c_nationkey") % 7 == F.col("a"), "left")
    uploads = uploads.join(detected, F.col("c_custkey") % 7 == F.col("b"), "left")
    asked, automatic = 10.0 * (1 + F.col("c_custkey") % 3), F.col("c_custkey") % 4 != 0
    seconds = policy.effective_seconds(asked, F.col("project"), F.col("detected"), F.col("own"), automatic)
    return uploads.select("c_custkey", "project", "detected", seconds.alias("seconds"))
