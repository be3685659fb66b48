"""Queries of the time-series transforms: grids, joins in time, windows, flags and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnworks.operators import registry, scan, series, windows
from kilnworks.operators.series import DISTURBANCE, EVENT_TYPES, INPUTS, OUTPUT

from .base import FILLED, P, filled, frame, long_form, long_sql, query, r6, sql_r6, table

COLS = list(EVENT_TYPES)
BOUNDS = {c: (50.0, 250.0, 60.0) for c in COLS}


@query("q_process_frame", f"WITH {P} SELECT h, rn, {sql_r6(*COLS)} FROM P")
def process_frame(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d).select("h", F.col("rn").cast("long").alias("rn"), *r6(*COLS))


@query("q_resample_right", "SELECT user_id, CAST(ceil(epoch_us(ts) / 21600000000.0) AS BIGINT) AS h, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def resample_right(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("user_id", series.bin_end(F.col("ts"), 21600).alias("h")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("q_dedup_ts", "WITH t AS (SELECT *, date_trunc('hour', ts) AS hour FROM events) SELECT user_id, event_id, event_type, round(value, 6) AS value FROM t QUALIFY row_number() OVER (PARTITION BY user_id, hour ORDER BY event_id) = 1")
def dedup_ts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return series.first_of_duplicates(e, ["user_id", "hour"], "event_id").select("user_id", "event_id", "event_type", *r6("value"))


@query("q_ffill6", f"WITH {FILLED} SELECT rn, {sql_r6(*COLS)} FROM Q")
def ffill6(s: SparkSession, d: str) -> DataFrame:
    return filled(s, d).select(F.col("rn").cast("long").alias("rn"), *r6(*COLS))


@query("q_ffill6_blocks", f"WITH {FILLED} SELECT rn, {sql_r6(*COLS)} FROM Q")
def ffill6_blocks(s: SparkSession, d: str) -> DataFrame:
    """The same fill with the series dealt into blocks, as a long one would be."""
    done = series.in_blocks(frame(s, d), "rn", 96, 6, lambda df, keys: series.forward_fill(df, INPUTS, keys=keys))
    return done.select(F.col("rn").cast("long").alias("rn"), *r6(*COLS))


@query("q_interpolate_linear", f"""WITH {P}, a AS (SELECT rn, purchase, last_value(purchase IGNORE NULLS) OVER b AS x0, first_value(purchase IGNORE NULLS) OVER f AS x1,
  last_value(CASE WHEN purchase IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN purchase IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS t1 FROM P
  WINDOW b AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT rn, round(coalesce(purchase, x0 + (x1 - x0) * (rn - t0) / nullif(t1 - t0, 0), x0, x1), 6) AS purchase FROM a""")
def interpolate(s: SparkSession, d: str) -> DataFrame:
    return series.interpolate_linear(frame(s, d), ["purchase"]).select(F.col("rn").cast("long").alias("rn"), *r6("purchase"))


@query("q_anom_range", f"WITH {P} SELECT rn, coalesce(click < 60 OR click > 200, false) AS bad FROM P")
def anom_range(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d).select(F.col("rn").cast("long").alias("rn"), series.range_flag(F.col("click"), 60, 200).alias("bad"))


@query("q_anom_step", f"WITH {P} SELECT rn, coalesce(abs(click - lag(click) OVER (ORDER BY rn)) > 40, false) AS bad FROM P")
def anom_step(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d).select(F.col("rn").cast("long").alias("rn"), series.step_flag(F.col("click"), 40, series.ordered("rn")).alias("bad"))


def spike_sql(source: str, c: str) -> str:
    return f"""(SELECT rn, coalesce(s > 0 AND dv > 6 * s, false) AS bad FROM (SELECT rn, dv, CASE WHEN count(dv) OVER w >= 3 THEN quantile_cont(dv, 0.5) OVER w END AS s FROM (
  SELECT rn, abs({c} - CASE WHEN count({c}) OVER w >= 3 THEN quantile_cont({c}, 0.5) OVER w END) AS dv FROM {source} WINDOW w AS (ORDER BY rn ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)) WINDOW w AS (ORDER BY rn ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)))"""


@query("q_anom_spike", f"WITH {P} SELECT * FROM {spike_sql('P', 'click')}")
def anom_spike(s: SparkSession, d: str) -> DataFrame:
    return series.spike_flag(frame(s, d), "click", "bad").select(F.col("rn").cast("long").alias("rn"), "bad")


#: Flags on the filled inputs, repaired values, and inputs filled once more.
REPAIRED = FILLED + ", " + ", ".join(f"k_{c} AS {spike_sql('Q', c)}" for c in COLS) + ", F AS (SELECT Q.*, " + ", ".join(f"(k_{c}.bad OR coalesce(Q.{c} < 50 OR Q.{c} > 250, false) OR coalesce(abs(Q.{c} - lag(Q.{c}) OVER (ORDER BY Q.rn)) > 60, false)) AS {c}_bad" for c in COLS) + " FROM Q " + " ".join(f"JOIN k_{c} ON k_{c}.rn = Q.rn" for c in COLS) + """),
N AS (SELECT h, rn, """ + ", ".join(f"{c}_bad, CASE WHEN NOT {c}_bad THEN {c} END AS {c}" for c in COLS) + """ FROM F),
R AS (SELECT h, rn, """ + ", ".join(f"{c}_bad" for c in COLS) + ", error, purchase, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in INPUTS) + " FROM N WINDOW w AS (ORDER BY rn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"  # fmt: skip


#: What is made of the events, step by step.
ARTIFACTS = registry.Registry()


@ARTIFACTS.operator("resample", {"events": ("ts", "event_type", "value")}, "process_frame", ("h", "rn", *COLS))
def make_process_frame(events: DataFrame) -> DataFrame:
    return series.resample_mean(events)


@ARTIFACTS.operator("repair", {"process_frame": ("rn", *COLS)}, "repaired_frame", ("h", "rn", *COLS, *(f"{c}_bad" for c in COLS)))
def make_repaired_frame(process_frame: DataFrame) -> DataFrame:
    return series.repair(process_frame, BOUNDS, INPUTS)


@ARTIFACTS.operator("score windows", {"repaired_frame": ("rn", *COLS)}, "window_scores", ("window_id", "start_rn", "end_rn", "score", "level"))
def make_window_scores(repaired_frame: DataFrame) -> DataFrame:
    return windows.score_windows(repaired_frame, INPUTS, OUTPUT, COLS, [f"{c}_bad" for c in COLS])


@ARTIFACTS.operator("segment", {"process_frame": ("h", OUTPUT)}, "segments", ("h", "segment", *COLS))
def make_segments(process_frame: DataFrame) -> DataFrame:
    return series.segments(process_frame.filter(F.col(OUTPUT).isNotNull()), 1, "h")


def artifact(s: SparkSession, d: str, name: str) -> DataFrame:
    """An artifact made of the events, with whatever it needs on the way."""
    return ARTIFACTS.run([name], {"events": table(s, d, "events")})[name]


def repaired(s: SparkSession, d: str) -> DataFrame:
    return artifact(s, d, "repaired_frame")


@query("q_clean_repair", f"WITH {REPAIRED} SELECT rn, {sql_r6(*COLS)}, {', '.join(c + '_bad' for c in COLS)} FROM R")
def clean_repair(s: SparkSession, d: str) -> DataFrame:
    return repaired(s, d).select(F.col("rn").cast("long").alias("rn"), *r6(*COLS), *[f"{c}_bad" for c in COLS])


@query("q_hampel", f"""WITH {P}, a AS (SELECT rn, click, quantile_cont(click, 0.5) OVER w AS m, list(click) FILTER (click IS NOT NULL) OVER w AS l FROM P WINDOW w AS (ORDER BY rn ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
  b AS (SELECT rn, click, m, 1.4826 * list_aggregate(list_transform(l, lambda v: abs(v - m)), 'quantile_cont', 0.5) AS s FROM a) SELECT rn, round(CASE WHEN abs(click - m) > 3 * s THEN m ELSE click END, 6) AS click FROM b""")
def hampel(s: SparkSession, d: str) -> DataFrame:
    return series.hampel(frame(s, d), "click", "clean").select(F.col("rn").cast("long").alias("rn"), F.round("clean", 6).alias("click"))


#: Hours that have an output, which leave gaps; segments are runs without one.
SEG = P + """, O AS (SELECT * FROM P WHERE purchase IS NOT NULL), S AS (SELECT *, sum(CASE WHEN h - ph = 1 THEN 0 ELSE 1 END) OVER (ORDER BY h) AS segment FROM (SELECT *, lag(h) OVER (ORDER BY h) AS ph FROM O))"""


def segmented(s: SparkSession, d: str) -> DataFrame:
    return series.segments(frame(s, d).filter(F.col(OUTPUT).isNotNull()), 1, "h")


@query("q_segments", f"WITH {SEG} SELECT CAST(segment AS BIGINT) AS segment, min(h) AS start_h, max(h) AS end_h, count(*) AS n FROM S GROUP BY 1")
def segment_runs(s: SparkSession, d: str) -> DataFrame:
    return scan.segments(frame(s, d).filter(F.col(OUTPUT).isNotNull()), 1, "h", width=256).groupBy("segment").agg(F.min("h").alias("start_h"), F.max("h").alias("end_h"), F.count(F.lit(1)).alias("n")).withColumn("segment", F.col("segment").cast("long"))


@query("q_segment_lag", f"WITH {SEG} SELECT h, round(lag(click, 3) OVER (PARTITION BY segment ORDER BY h), 6) AS click_3 FROM S")
def segment_lag(s: SparkSession, d: str) -> DataFrame:
    return segmented(s, d).select("h", F.round(series.lagged("click", 3, "h"), 6).alias("click_3"))


@query("q_segment_age", f"WITH {SEG} SELECT h, row_number() OVER (PARTITION BY segment ORDER BY h) - 1 AS age FROM S")
def segment_age(s: SparkSession, d: str) -> DataFrame:
    return scan.segments(frame(s, d).filter(F.col(OUTPUT).isNotNull()), 1, "h", age="age", width=256).select("h", "age")


@query("q_history_mask", f"WITH {SEG} SELECT h, sum(CASE WHEN view IS NOT NULL AND click IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY segment ORDER BY h ROWS 4 PRECEDING) = 5 AS whole FROM S")
def history_mask(s: SparkSession, d: str) -> DataFrame:
    return series.history_mask(segmented(s, d), ["view", "click"], 4, "whole", "h").select("h", "whole")


@query("q_delay_compensate", f"WITH {P} SELECT rn, round(lag(view, 3) OVER (ORDER BY rn), 6) AS view_aligned, round(lag(click, 5) OVER (ORDER BY rn), 6) AS click_aligned FROM P")
def delay_compensate(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d).select(F.col("rn").cast("long").alias("rn"), *[F.round(series.lagged(c, k, keys=()), 6).alias(f"{c}_aligned") for c, k in (("view", 3), ("click", 5))])


@query("q_arx_features", f"WITH {SEG} SELECT h, {', '.join(f'round(lag({c}, {k}) OVER w, 6) AS {c}_{k}' for c, ks in (('purchase', (1, 2)), ('click', (2, 3)), ('view', (1, 2))) for k in ks)} FROM S WINDOW w AS (PARTITION BY segment ORDER BY h)")
def arx_features(s: SparkSession, d: str) -> DataFrame:
    lags = [(c, k) for c, delay in (("purchase", None), ("click", 2), ("view", 0)) for k in series.feature_lags(2, delay)]
    return segmented(s, d).select("h", *[F.round(series.lagged(c, k, "h"), 6).alias(f"{c}_{k}") for c, k in lags])


SPLIT = P + ", C AS (SELECT *, count(*) OVER () AS n FROM P), T AS (SELECT *, CASE WHEN rn < floor(n * 0.6) THEN 'train' WHEN rn < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS part FROM C)"


@query("q_time_split", f"WITH {SPLIT} SELECT rn, part FROM T")
def time_split(s: SparkSession, d: str) -> DataFrame:
    return scan.time_split(frame(s, d), width=256).select(F.col("rn").cast("long").alias("rn"), "part")


@query("q_split_manifest", f"WITH {SPLIT}, m AS (SELECT part, count(*) AS n, min(h) AS start_h, max(h) AS end_h FROM T GROUP BY 1) SELECT *, CAST(greatest(4, least(2 * 12 + 3, floor(least((SELECT n FROM m WHERE part = 'validation'), (SELECT n FROM m WHERE part = 'test')) / 3))) AS BIGINT) AS guard FROM m")
def split_manifest(s: SparkSession, d: str) -> DataFrame:
    m = series.time_split(frame(s, d)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("start_h"), F.max("h").alias("end_h"))
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("n"))).over(Window.partitionBy())
    return m.withColumn("v", of("validation")).withColumn("t", of("test")).select("part", "n", "start_h", "end_h", series.guard_rows(12, F.col("v"), F.col("t")).cast("long").alias("guard"))


@query("q_partition_boundary", f"WITH {SPLIT} SELECT part, count(*) AS n FROM T a WHERE NOT EXISTS (SELECT 1 FROM T b WHERE b.part < a.part AND b.h = a.h) GROUP BY 1")
def partition_boundary(s: SparkSession, d: str) -> DataFrame:
    """Bins that end at the end of an earlier part stay with that part alone."""
    t = series.time_split(frame(s, d)).select("h", "part")
    earlier = t.select("h", F.col("part").alias("p"))
    return t.join(earlier, (t["h"] == earlier["h"]) & (earlier["p"] < t["part"]), "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("q_preview", f"WITH {P}, c AS (SELECT rn, click, count(*) OVER () AS n FROM P) SELECT rn, round(click, 6) AS click FROM c WHERE rn % CAST(ceil(n / 120.0) AS BIGINT) = 0 OR rn = n - 1")
def preview(s: SparkSession, d: str) -> DataFrame:
    c = frame(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return c.filter((F.col("rn") % F.ceil(F.col("n") / 120) == 0) | (F.col("rn") == F.col("n") - 1)).select(F.col("rn").cast("long").alias("rn"), *r6("click"))


@query("q_chart_downsample", f"WITH {P}, c AS (SELECT rn, click, count(*) OVER () AS n FROM P), i AS (SELECT DISTINCT CAST(floor(k * ((SELECT max(n) FROM c) - 1) / 499.0) AS BIGINT) AS place FROM range(500) t(k)) SELECT rn, round(click, 6) AS click, click IS NULL AS gap FROM c JOIN i ON rn = place")
def chart_downsample(s: SparkSession, d: str) -> DataFrame:
    c = frame(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    # row r is point k for some k below 500 exactly if the next point's place is past it
    k = F.ceil(F.col("rn") * 499.0 / F.nullif(F.col("n") - 1, F.lit(0)))
    return c.filter((F.floor(k * (F.col("n") - 1) / 499.0) == F.col("rn")) & (k < 500)).select(F.col("rn").cast("long").alias("rn"), *r6("click"), F.col("click").isNull().alias("gap"))


# joins in time

@query("q_asof_backward", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), r AS (SELECT ts, value FROM events WHERE event_type = 'purchase'),
  j AS (SELECT event_id, r.value, (epoch_us(l.ts) - epoch_us(r.ts)) / 1e6 AS age FROM l ASOF LEFT JOIN r ON l.ts >= r.ts)
  SELECT event_id, round(CASE WHEN age <= 1800 THEN value END, 6) AS value, round(CASE WHEN age <= 1800 THEN age / 60 END, 6) AS age_minutes, coalesce(age <= 600, false) AS fresh FROM j""")
def asof_backward(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    left, right = e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("ts", "value")
    return series.asof_backward(left, right, "ts", ["value"], 1800).select("event_id", *r6("value", "age_minutes"), F.coalesce(F.col("age_minutes") <= 10, F.lit(False)).alias("fresh"))


@query("q_asof_by_user", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'),
  j AS (SELECT event_id, r.value, (epoch_us(l.ts) - epoch_us(r.ts)) / 1e6 AS age FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts)
  SELECT event_id, round(CASE WHEN age <= 86400 THEN value END, 6) AS value FROM j""")
def asof_by_user(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    left, right = e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return series.asof_backward(left, right, "ts", ["value"], 86400, ["user_id"]).select("event_id", *r6("value"))


# sliding windows

NW = f"W AS (SELECT R.*, CAST(unnest(range(CAST(greatest(0, ceil((rn - 29) / 15.0)) AS BIGINT), CAST(least(floor(rn / 15.0), floor(((SELECT count(*) FROM R) - 30) / 15.0)) AS BIGINT) + 1)) AS BIGINT) AS window_id FROM R), D AS (SELECT *, {', '.join(f'{c} - lag({c}) OVER w AS d_{c}' for c in COLS)} FROM W WINDOW w AS (PARTITION BY window_id ORDER BY rn))"
_rr = lambda c, scale: f"CASE WHEN count({c}) < 3 OR avg(abs({c})) = 0 THEN 0 ELSE least(100, (quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)) / avg(abs({c})) * {scale}) END"
_sm = lambda c: f"greatest(0, 100 - 600 * avg(abs(d_{c})) / (avg(abs({c})) + 1e-9))"
_snr = lambda c: f"""s_{c} AS (SELECT window_id, CASE WHEN n >= 15 AND n2 >= 12 AND total > 1e-12 AND sigma > 1e-12 THEN 10 * log10(greatest(total - sigma * sigma, 1e-12) / (sigma * sigma)) END AS v_{c}, n, CASE WHEN n >= 15 AND n2 >= 12 AND total > 1e-12 AND sigma > 1e-12 THEN sigma * sigma END AS noise FROM (
  SELECT window_id, count(x) AS n, count(d2) AS n2, var_pop(x) AS total, quantile_cont(abs(d2 - m), 0.5) / 0.67448975 / sqrt(6.0) AS sigma FROM (SELECT *, quantile_cont(d2, 0.5) OVER (PARTITION BY window_id) AS m FROM (SELECT window_id, {c} AS x, {c} - 2 * lag({c}, 1) OVER w + lag({c}, 2) OVER w AS d2 FROM W WINDOW w AS (PARTITION BY window_id ORDER BY rn))) GROUP BY 1))"""  # noqa: E731
SCORES = REPAIRED + ", " + NW + ", " + ", ".join(_snr(c) for c in [*INPUTS, OUTPUT]) + f""", A AS (SELECT window_id, min(rn) AS start_rn, max(rn) AS end_rn, ({' + '.join(_rr(c, 1500) for c in INPUTS)}) / {len(INPUTS)} AS input_change, {_rr(OUTPUT, 1800)} AS output_response,
  100 * (1 - ({' + '.join(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END)' for c in COLS)}) / {len(COLS)}) AS completeness, 100 * (1 - ({' + '.join(f'avg(CASE WHEN {c}_bad THEN 1.0 ELSE 0 END)' for c in COLS)}) / {len(COLS)}) AS anomaly, ({' + '.join(_sm(c) for c in COLS)}) / {len(COLS)} AS smoothness, count(purchase) AS output_observations FROM D GROUP BY 1),
Z AS (SELECT A.*, CASE WHEN v_purchase IS NOT NULL AND coalesce(v_view, v_click, v_signup) IS NOT NULL THEN least(greatest(v_view, v_click, v_signup), v_purchase) END AS snr_db, .35 * input_change + .25 * output_response + .2 * completeness + .1 * anomaly + .1 * smoothness AS score FROM A {' '.join(f'JOIN s_{c} ON s_{c}.window_id = A.window_id' for c in [*INPUTS, OUTPUT])}),
L AS (SELECT *, CASE WHEN score >= 80 AND snr_db >= 10 THEN 'strict' WHEN score >= 60 THEN 'usable' ELSE 'rejected' END AS level FROM Z)"""  # fmt: skip
PARTS = ["input_change", "output_response", "completeness", "anomaly", "smoothness"]


def scored(s: SparkSession, d: str) -> DataFrame:
    return artifact(s, d, "window_scores")


@query("q_window_scores", f"WITH {SCORES} SELECT window_id, start_rn, end_rn, {sql_r6(*PARTS, 'score', 'snr_db')}, output_observations, level FROM L")
def window_scores(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).select("window_id", F.col("start_rn").cast("long").alias("start_rn"), F.col("end_rn").cast("long").alias("end_rn"), *r6(*PARTS, "score", "snr_db"), "output_observations", "level")


@query("q_snr", f"WITH {P}, R AS (SELECT rn, view, click, error, purchase, signup FROM P), {NW}, {_snr('click')} SELECT window_id, n AS valid_samples, round(v_click, 6) AS snr_db, round(noise, 6) AS noise_power FROM s_click")
def snr(s: SparkSession, d: str) -> DataFrame:
    return windows.snr(windows.explode_windows(frame(s, d)), "click", ["window_id"]).select("window_id", "valid_samples", *r6("snr_db", "noise_power"))


@query("q_window_snr", f"WITH {SCORES} SELECT window_id, round(snr_db, 6) AS snr_db FROM L")
def window_snr(s: SparkSession, d: str) -> DataFrame:
    rows = windows.explode_windows(repaired(s, d))
    return windows.window_snr(windows.snr_of_all(rows, [*INPUTS, OUTPUT], ["window_id"]), INPUTS, [OUTPUT]).select("window_id", *r6("snr_db"))


@query("q_segment_rank", f"WITH {SCORES} SELECT window_id, round(score, 2) AS score, row_number() OVER (ORDER BY round(score, 2) DESC, start_rn) AS place FROM L")
def segment_rank(s: SparkSession, d: str) -> DataFrame:
    two = scored(s, d).withColumn("score", F.round("score", 2))
    return two.select("window_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "start_rn")).cast("long").alias("place"))


TOP = SCORES + ", M AS (SELECT *, CASE level WHEN 'strict' THEN 0 WHEN 'usable' THEN 1 ELSE 2 END AS tier FROM L), K AS (SELECT * FROM M WHERE tier = (SELECT min(tier) FROM M) ORDER BY score DESC, window_id LIMIT 5)"


@query("q_topk_windows", f"WITH {TOP} SELECT window_id, start_rn, end_rn, round(score, 6) AS score, level FROM K")
def topk_windows(s: SparkSession, d: str) -> DataFrame:
    return windows.top_windows(scored(s, d)).select("window_id", F.col("start_rn").cast("long").alias("start_rn"), F.col("end_rn").cast("long").alias("end_rn"), *r6("score"), "level")


@query("q_rows_in_windows", f"WITH {TOP} SELECT rn, {sql_r6('click', 'purchase')} FROM R WHERE EXISTS (SELECT 1 FROM K WHERE R.rn BETWEEN K.start_rn AND K.end_rn)")
def rows_in_windows(s: SparkSession, d: str) -> DataFrame:
    top = windows.top_windows(scored(s, d)).select("start_rn", "end_rn")
    return windows.rows_in_windows(repaired(s, d), top).select(F.col("rn").cast("long").alias("rn"), *r6("click", "purchase"))


@query("q_selected_flag", f"WITH {TOP} SELECT rn, EXISTS (SELECT 1 FROM K WHERE R.rn BETWEEN K.start_rn AND K.end_rn) AS selected FROM R")
def selected_flag(s: SparkSession, d: str) -> DataFrame:
    rows = repaired(s, d).select("rn")
    top = windows.top_windows(scored(s, d)).select("start_rn", "end_rn")
    chosen = windows.rows_in_windows(rows, top).select("rn", F.lit(True).alias("selected"))
    return rows.join(chosen, "rn", "left").select(F.col("rn").cast("long").alias("rn"), F.coalesce("selected", F.lit(False)).alias("selected"))


@query("q_reweight_segments", f"WITH {SCORES}, x AS (SELECT window_id, (1 * input_change + 2 * output_response + 1 * completeness + 1 * anomaly + 3 * smoothness) / 8 AS score FROM L) SELECT window_id, round(score, 6) AS score, round(avg(score) OVER (), 6) AS mean, row_number() OVER (ORDER BY round(score, 6) DESC, window_id) AS place FROM x WHERE score >= 50")
def reweight(s: SparkSession, d: str) -> DataFrame:
    shares = dict(zip(PARTS, (1, 2, 1, 1, 3)))
    x = scored(s, d).withColumn("score", sum((F.col(c) * n for c, n in shares.items()), F.lit(0.0)) / sum(shares.values())).filter("score >= 50")
    return x.select("window_id", *r6("score"), F.round(F.avg("score").over(Window.partitionBy()), 6).alias("mean"), F.row_number().over(Window.orderBy(F.round("score", 6).desc(), "window_id")).cast("long").alias("place"))


@query("q_union_dedup", f"WITH {TOP} SELECT DISTINCT rn FROM R JOIN K ON R.rn BETWEEN K.start_rn AND K.end_rn UNION SELECT rn FROM R WHERE rn < 40")
def union_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = repaired(s, d).select(F.col("rn").cast("long").alias("rn"))
    top = windows.top_windows(scored(s, d)).select("start_rn", "end_rn")
    return windows.rows_in_windows(rows, top).unionByName(rows.filter("rn < 40")).dropDuplicates(["rn"])


@query("q_quality_score", f"""WITH {SCORES}, T AS (SELECT 100 * (1 - ({' + '.join(f'avg(CASE WHEN P.{c} IS NULL THEN 1.0 ELSE 0 END)' for c in COLS)}) / 5) AS completeness FROM P),
  V AS (SELECT 100 * (1 - ({' + '.join(f'avg(CASE WHEN {c}_bad THEN 1.0 ELSE 0 END)' for c in COLS)}) / 5) AS validity FROM R), DD AS (SELECT *, {', '.join(f'{c} - lag({c}) OVER (ORDER BY rn) AS d_{c}' for c in COLS)} FROM R),
  SM AS (SELECT ({' + '.join(_sm(c) for c in COLS)}) / 5 AS smoothness FROM DD), DY AS (SELECT avg(s) AS dynamic FROM (SELECT round(score, 2) AS s FROM L ORDER BY 1 DESC LIMIT 5))
  SELECT {sql_r6('completeness', 'validity', 'smoothness', 'dynamic')}, round(.25 * completeness + .2 * validity + .15 * smoothness + .3 * dynamic + .1 * 100, 6) AS overall, round((.25 * completeness + .2 * validity + .15 * smoothness + .1 * 100) / .7, 6) AS without_windows FROM T, V, SM, DY""")
def quality_score(s: SparkSession, d: str) -> DataFrame:
    raw, clean = frame(s, d), repaired(s, d)
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    a = raw.agg((100 * (1 - mean([F.avg(F.col(c).isNull().cast("double")) for c in COLS]))).alias("completeness"))
    w = series.ordered("rn")
    b = clean.withColumns({f"_d_{c}": F.col(c) - F.lag(c).over(w) for c in COLS}).agg((100 * (1 - mean([F.avg(F.col(f"{c}_bad").cast("double")) for c in COLS]))).alias("validity"), mean([windows.smoothness(F.col(f"_d_{c}"), F.col(c)) for c in COLS]).alias("smoothness"))
    dynamic = scored(s, d).select(F.round("score", 2).alias("s")).orderBy(F.desc("s")).limit(5).agg(F.avg("s").alias("dynamic"))
    one = a.join(F.broadcast(b)).join(F.broadcast(dynamic))  # single rows
    parts = [F.col(c) for c in ("completeness", "validity", "smoothness")]
    return one.select(*r6("completeness", "validity", "smoothness", "dynamic"), F.round(windows.quality_score(*parts, F.col("dynamic"), F.lit(100.0)), 6).alias("overall"), F.round(windows.quality_score(*parts, None, F.lit(100.0)), 6).alias("without_windows"))


# events and runs

@query("q_change_energy", f"""WITH {P}, z AS (SELECT rn, abs(view - lag(view) OVER o) AS a, abs(click - lag(click) OVER o) AS b, abs(signup - lag(signup) OVER o) AS c FROM P WINDOW o AS (ORDER BY rn)), sd AS (SELECT stddev_pop(view) AS v, stddev_pop(click) AS k, stddev_pop(signup) AS g FROM P)
  SELECT rn, round(.55 * coalesce(a / nullif(v, 0), 0) + .25 * coalesce(b / nullif(k, 0), 0) + .2 * coalesce(c / nullif(g, 0), 0), 6) AS energy FROM z, sd""")
def change_energy(s: SparkSession, d: str) -> DataFrame:
    return energy(frame(s, d)).select(F.col("rn").cast("long").alias("rn"), *r6("energy"))


def energy(df: DataFrame) -> DataFrame:
    """Changes of the inputs in units of their own deviation, weighted and added up."""
    w, all_rows = series.ordered("rn"), Window.partitionBy()
    part = lambda c: F.coalesce(F.abs(F.col(c) - F.lag(c).over(w)) / F.nullif(F.stddev_pop(c).over(all_rows), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("energy", 0.55 * part("view") + 0.25 * part("click") + 0.20 * part("signup"))


COOLDOWN = f"""WITH RECURSIVE {P}, z AS (SELECT rn, abs(view - lag(view) OVER o) AS a, abs(click - lag(click) OVER o) AS b, abs(signup - lag(signup) OVER o) AS c FROM P WINDOW o AS (ORDER BY rn)),
  sd AS (SELECT stddev_pop(view) AS v, stddev_pop(click) AS k, stddev_pop(signup) AS g FROM P),
  x AS (SELECT rn, .55 * coalesce(a / nullif(v, 0), 0) + .25 * coalesce(b / nullif(k, 0), 0) + .2 * coalesce(c / nullif(g, 0), 0) AS energy FROM z, sd),
  n AS (SELECT CAST(rn AS BIGINT) AS rn, CAST(energy AS DOUBLE) AS energy, row_number() OVER (ORDER BY rn) AS i FROM x WHERE energy > 1.5),
  k(i, rn, energy, out_rn, out_energy) AS (SELECT i, rn, energy, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM n WHERE i = 1
    UNION ALL SELECT n.i, CASE WHEN n.rn - k.rn > 12 OR n.energy > k.energy THEN n.rn ELSE k.rn END, CASE WHEN n.rn - k.rn > 12 OR n.energy > k.energy THEN n.energy ELSE k.energy END,
      CASE WHEN n.rn - k.rn > 12 THEN k.rn END, CASE WHEN n.rn - k.rn > 12 THEN k.energy END FROM k JOIN n ON n.i = k.i + 1)
  SELECT out_rn AS rn, round(out_energy, 6) AS energy FROM k WHERE out_rn IS NOT NULL UNION ALL SELECT rn, round(energy, 6) FROM k WHERE i = (SELECT max(i) FROM n)"""


@query("q_event_cooldown", COOLDOWN)
def event_cooldown(s: SparkSession, d: str) -> DataFrame:
    """Rows whose energy is above 1.5, the stronger of any two within 12 rows."""
    events = energy(frame(s, d)).filter("energy > 1.5").select(F.col("rn").cast("long").alias("rn"), "energy")
    return windows.strongest(events, "rn", "energy", 12).select("rn", *r6("energy"))


@query("q_event_mask", f"WITH {P}, z AS (SELECT rn, click > 150 AS hit FROM P), m AS (SELECT rn, coalesce(max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 0) = 1 AS masked FROM z), r AS (SELECT *, CASE WHEN masked AND NOT coalesce(lag(masked) OVER (ORDER BY rn), false) THEN 1 ELSE 0 END AS new FROM m) SELECT rn, masked, CAST(sum(new) OVER (ORDER BY rn) AS BIGINT) AS run FROM r")
def event_mask(s: SparkSession, d: str) -> DataFrame:
    """Rows up to two after and one before an event, with a running count of such runs."""
    w = series.ordered("rn")
    m = frame(s, d).withColumn("masked", F.coalesce(F.max(F.when(F.col("click") > 150, 1).otherwise(0)).over(w.rowsBetween(-2, 1)), F.lit(0)) == 1)
    m = m.withColumn("new", (F.col("masked") & ~F.coalesce(F.lag("masked").over(w), F.lit(False))).cast("int"))
    return m.select(F.col("rn").cast("long").alias("rn"), "masked", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("run"))


@query("q_operating_state", f"""WITH {P}, m AS (SELECT {', '.join(f'median({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in INPUTS)} FROM P), z AS (SELECT rn, {', '.join(f'({c} - m_{c}) / nullif(s_{c}, 0) AS z_{c}' for c in INPUTS)} FROM P, m),
  a AS (SELECT rn, {', '.join(f'coalesce(abs(z_{c} - lag(z_{c}) OVER (ORDER BY rn)), NULL) AS a_{c}' for c in INPUTS)} FROM z), b AS (SELECT rn, coalesce(list_aggregate(list_filter([a_view, a_click, a_signup], lambda x: x IS NOT NULL), 'median'), 0) AS move FROM a), q AS (SELECT quantile_cont(move, 0.5) AS q1, quantile_cont(move, 0.85) AS q2 FROM b)
  SELECT rn, round(move, 6) AS move, CASE WHEN move <= q1 THEN 'steady' WHEN move <= q2 THEN 'adjusting' ELSE 'transient' END AS state FROM b, q""")
def operating_state(s: SparkSession, d: str) -> DataFrame:
    df, w, whole = frame(s, d), series.ordered("rn"), Window.partitionBy()
    z = df.withColumns({f"z_{c}": (F.col(c) - F.percentile(c, F.lit(0.5)).over(whole)) / F.nullif(F.stddev_pop(c).over(whole), F.lit(0.0)) for c in INPUTS})
    moves = F.array_sort(F.array_compact(F.array(*[F.abs(F.col(f"z_{c}") - F.lag(f"z_{c}").over(w)) for c in INPUTS])))
    z = z.withColumn("l", moves).withColumn("n", F.size("l"))
    z = z.withColumn("move", F.expr("if(n = 0, 0D, (l[cast((n - 1) div 2 as int)] + l[cast(n div 2 as int)]) / 2)"))
    z = z.withColumn("q1", F.percentile("move", F.lit(0.5)).over(whole)).withColumn("q2", F.percentile("move", F.lit(0.85)).over(whole))
    return z.select(F.col("rn").cast("long").alias("rn"), *r6("move"), F.when(F.col("move") <= F.col("q1"), "steady").when(F.col("move") <= F.col("q2"), "adjusting").otherwise("transient").alias("state"))


@query("q_missing_rate", f"WITH {P}, v AS ({long_sql('P', COLS)}) SELECT variable, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_rate FROM v GROUP BY 1")
def missing_rate(s: SparkSession, d: str) -> DataFrame:
    return long_form(frame(s, d), COLS).groupBy("variable").agg(F.round(F.avg(F.col("value").isNull().cast("double")), 6).alias("missing_rate"))


@query("q_smoothness", f"WITH {P}, D AS (SELECT *, {', '.join(f'{c} - lag({c}) OVER (ORDER BY rn) AS d_{c}' for c in COLS)} FROM P) SELECT round(({' + '.join(_sm(c) for c in COLS)}) / 5, 6) AS smoothness FROM D")
def smoothness(s: SparkSession, d: str) -> DataFrame:
    w = series.ordered("rn")
    df = frame(s, d).withColumns({f"_d_{c}": F.col(c) - F.lag(c).over(w) for c in COLS})
    return df.agg(F.round(sum((windows.smoothness(F.col(f"_d_{c}"), F.col(c)) for c in COLS), F.lit(0.0)) / len(COLS), 6).alias("smoothness"))


@query("q_time_consistency", "WITH x AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS d FROM events) SELECT user_id, round(CASE WHEN count(*) < 3 OR count(DISTINCT d) = 1 THEN 100 ELSE greatest(0, 100 - stddev_samp(d) / 3600) END, 6) AS score FROM x GROUP BY 1")
def time_consistency(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    x = table(s, d, "events").withColumn("d", (us - F.lag(us).over(w)) / 1e6)
    return x.groupBy("user_id").agg(F.round(F.when((F.count(F.lit(1)) < 3) | (F.count_distinct("d") == 1), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.stddev_samp("d") / 3600)), 6).alias("score"))


@query("q_native_period", "WITH x AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS d FROM events) SELECT user_id, round(quantile_cont(d, 0.5) FILTER (d > 0), 3) AS native_s, round(greatest(600, coalesce(quantile_cont(d, 0.5) FILTER (d > 0), 0)), 3) AS effective_s FROM x GROUP BY 1")
def native_period(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    x = table(s, d, "events").withColumn("d", (us - F.lag(us).over(w)) / 1e6)
    native = F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(0.5))
    return x.groupBy("user_id").agg(F.round(native, 3).alias("native_s"), F.round(F.greatest(F.lit(600.0), F.coalesce(native, F.lit(0.0))), 3).alias("effective_s"))


@query("q_disturbance_rows", f"WITH {P} SELECT rn, round({DISTURBANCE}, 6) AS error FROM P WHERE {DISTURBANCE} IS NOT NULL")
def disturbance_rows(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d).filter(F.col(DISTURBANCE).isNotNull()).select(F.col("rn").cast("long").alias("rn"), *r6("error"))
