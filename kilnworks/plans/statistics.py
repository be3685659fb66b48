"""Queries of statistics, joins, sets, order and aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnworks.functions.numeric import clip, correlation, improvement_percent
from kilnworks.operators import feedback, scan, series, stats, studies, windows
from kilnworks.operators.series import EVENT_TYPES, INPUTS, OUTPUT

from .base import P, corr_sql, frame, long_form, long_sql, query, r6, table

COLS = list(EVENT_TYPES)
PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1 :]]
CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {corr_sql(a, b)} AS corr FROM P" for a, b in PAIRS)
LONG = long_sql("P", COLS, "rn")


def longer(s: SparkSession, d: str) -> DataFrame:
    return long_form(frame(s, d), COLS, ["rn"])


def daily(s: SparkSession, d: str) -> DataFrame:
    """Quantities shipped each day, numbered."""
    days = table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"))
    return days.withColumn("i", F.row_number().over(series.ordered("day")) - 1)


DAILY = "days AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1), Y AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i FROM days)"


@query("q_profile", "SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_columns, count(*) - count(DISTINCT (user_id, event_type, date_trunc('hour', ts), props)) AS n_duplicates, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_constant FROM events")
def profile(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").alias("ts"), "props")
    return stats.profile(e, e.columns)


@query("q_relative_range", f"WITH {P}, v AS ({LONG}) SELECT variable, round(CASE WHEN count(value) < 3 OR avg(abs(value)) = 0 THEN 0 ELSE least(100, (quantile_cont(value, .95) - quantile_cont(value, .05)) / avg(abs(value)) * 60) END, 6) AS score FROM v GROUP BY 1")
def relative_range(s: SparkSession, d: str) -> DataFrame:
    return longer(s, d).groupBy("variable").agg(F.round(windows.relative_range(F.col("value"), 60), 6).alias("score"))


@query("q_zscore_anomaly", f"WITH {P}, v AS ({LONG}), m AS (SELECT variable, avg(value) AS mu, stddev_pop(value) AS sd FROM v GROUP BY 1) SELECT variable, count(*) FILTER (abs(value - mu) / nullif(sd, 0) > 3) AS n, round(count(*) FILTER (abs(value - mu) / nullif(sd, 0) > 3) / count(value), 6) AS rate FROM v JOIN m USING (variable) GROUP BY 1")
def zscore_anomaly(s: SparkSession, d: str) -> DataFrame:
    v = longer(s, d)
    m = v.groupBy("variable").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    far = F.count_if(F.abs(F.col("value") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)) > 3)
    return v.join(F.broadcast(m), "variable").groupBy("variable").agg(far.alias("n"), F.round(far / F.count("value"), 6).alias("rate"))


@query("q_trend_slope", f"WITH {DAILY} SELECT round(regr_slope(qty, i), 6) AS qty_slope, round(regr_slope(price, i), 6) AS price_slope FROM Y")
def trend_slope(s: SparkSession, d: str) -> DataFrame:
    return daily(s, d).agg(F.round(F.regr_slope("qty", "i"), 6).alias("qty_slope"), F.round(F.regr_slope("price", "i"), 6).alias("price_slope"))


@query("q_stability", f"WITH {P}, v AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY variable) AS n FROM ({LONG}) WHERE value IS NOT NULL) SELECT variable, round(stddev_pop(value) / greatest(abs(avg(value)), 1e-12), 6) AS cv, round(abs(avg(value) FILTER (i >= n // 2) - avg(value) FILTER (i < n // 2)) / greatest(abs(avg(value)), 1e-12), 6) AS drift FROM v GROUP BY 1 HAVING count(*) >= 4")
def stability(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("variable")
    v = longer(s, d).filter("value is not null").withColumn("late", F.row_number().over(w.orderBy("rn")) - 1 >= F.floor(F.count(F.lit(1)).over(w) / 2))
    size = F.greatest(F.abs(F.avg("value")), F.lit(1e-12))
    half = lambda late: F.avg(F.when(F.col("late") == late, F.col("value")))
    return v.groupBy("variable").agg(F.round(F.stddev_pop("value") / size, 6).alias("cv"), F.round(F.abs(half(True) - half(False)) / size, 6).alias("drift"), F.count(F.lit(1)).alias("_n")).filter("_n >= 4").drop("_n")


@query("q_corr_pairs", f"WITH {P}, c AS ({CORR}) SELECT a, b, round(corr, 6) AS corr FROM c WHERE corr IS NOT NULL ORDER BY round(abs(corr), 9) DESC, a, b LIMIT 8")
def corr_pairs(s: SparkSession, d: str) -> DataFrame:
    return stats.correlations(frame(s, d), COLS).filter("corr is not null").orderBy(F.round(F.abs("corr"), 9).desc(), "a", "b").limit(8).select("a", "b", *r6("corr"))


@query("q_corr_matrix", f"WITH {P}, c AS ({CORR}) SELECT a, b, round(corr, 6) AS corr FROM c UNION ALL SELECT b, a, round(corr, 6) FROM c UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in COLS))
def corr_matrix(s: SparkSession, d: str) -> DataFrame:
    c = stats.correlations(frame(s, d), COLS).select("a", "b", *r6("corr"))
    same = s.createDataFrame([(x, x, 1.0) for x in COLS], "a string, b string, corr double")
    return c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).unionByName(same)


@query("q_high_corr", f"WITH {P}, c AS ({CORR}) SELECT a, b, round(corr, 6) AS corr FROM c WHERE abs(corr) >= 0.05")
def high_corr(s: SparkSession, d: str) -> DataFrame:
    return stats.correlations(frame(s, d), COLS).filter(F.abs("corr") >= 0.05).select("a", "b", *r6("corr"))


@query("q_energy", "SELECT l_returnflag AS grp, round(sum(l_quantity), 6) AS total, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem GROUP BY 1")
def energy(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.round(F.sum("l_quantity"), 6).alias("total"), F.round(F.stddev_pop("l_quantity"), 6).alias("deviation"))


HEALTH = f"{P}, v AS ({LONG}), m AS (SELECT variable, avg(value) AS mu, stddev_pop(value) AS sd, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) AS missing FROM v GROUP BY 1), z AS (SELECT variable, any_value(mu) AS mu, any_value(sd) AS sd, any_value(missing) AS missing, count(*) FILTER (abs(value - mu) / nullif(sd, 0) > 3) / count(value) AS rate FROM v JOIN m USING (variable) GROUP BY 1), k AS (SELECT *, sd / greatest(abs(mu), 1e-12) AS cv FROM z)"


def health_rows(s: SparkSession, d: str) -> DataFrame:
    v = longer(s, d)
    m = v.groupBy("variable").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.avg(F.col("value").isNull().cast("double")).alias("missing"))
    rate = F.count_if(F.abs(F.col("value") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)) > 3) / F.count("value")
    z = v.join(F.broadcast(m), "variable").groupBy("variable", "mu", "sd", "missing").agg(rate.alias("rate"))
    return z.withColumn("cv", F.col("sd") / F.greatest(F.abs("mu"), F.lit(1e-12)))


@query("q_health", f"WITH {HEALTH} SELECT variable, round(1 - (.65 * least(greatest(rate, 0), 1) + .35 * least(greatest(cv, 0), 1)), 6) AS health FROM k")
def health(s: SparkSession, d: str) -> DataFrame:
    return health_rows(s, d).select("variable", F.round(1 - (0.65 * clip(F.col("rate"), 0, 1) + 0.35 * clip(F.col("cv"), 0, 1)), 6).alias("health"))


@query("q_quality_stats", f"WITH {HEALTH} SELECT variable, round(mu, 6) AS mean, round(sd, 6) AS deviation, round(missing, 6) AS missing FROM k")
def quality_stats(s: SparkSession, d: str) -> DataFrame:
    return health_rows(s, d).select("variable", F.round("mu", 6).alias("mean"), F.round("sd", 6).alias("deviation"), *r6("missing"))


@query("q_bottleneck", f"WITH {HEALTH} SELECT variable, round(.45 * missing + .55 * least(cv, 5) / 5, 6) AS score FROM k ORDER BY 2 DESC, 1 LIMIT 8")
def bottleneck(s: SparkSession, d: str) -> DataFrame:
    k = health_rows(s, d).select("variable", F.round(0.45 * F.col("missing") + 0.55 * F.least("cv", F.lit(5.0)) / 5, 6).alias("score"))
    return k.orderBy(F.desc("score"), "variable").limit(8)


@query("q_root_cause", f"WITH {P}, c AS ({CORR}) SELECT CASE WHEN a = 'purchase' THEN b ELSE a END AS variable, round(abs(corr), 6) AS strength FROM c WHERE 'purchase' IN (a, b) AND corr IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 8")
def root_cause(s: SparkSession, d: str) -> DataFrame:
    c = stats.correlations(frame(s, d), COLS).filter(f"'{OUTPUT}' in (a, b) and corr is not null")
    return c.select(F.when(F.col("a") == OUTPUT, F.col("b")).otherwise(F.col("a")).alias("variable"), F.round(F.abs("corr"), 6).alias("strength")).orderBy(F.desc("strength"), "variable").limit(8)


@query("q_confidence", f"WITH {P}, v AS ({LONG}) SELECT variable, round(least(.98, greatest(.2, .9 * least(1, count(value) / 1000.0))), 6) AS confidence FROM v GROUP BY 1")
def confidence(s: SparkSession, d: str) -> DataFrame:
    return longer(s, d).groupBy("variable").agg(F.round(clip(0.9 * F.least(F.lit(1.0), F.count("value") / 1000.0), 0.2, 0.98), 6).alias("confidence"))


XC = " UNION ALL ".join(f"SELECT 'click' AS input, {k} AS lag, {corr_sql('x', 'y')} AS corr, count(CASE WHEN y IS NOT NULL THEN x END) AS pairs FROM (SELECT purchase AS y, {'lag' if k >= 0 else 'lead'}(click, {abs(k)}) OVER (ORDER BY rn) AS x FROM P)" for k in range(-6, 7))


@query("q_xcorr", f"WITH {P}, c AS ({XC}) SELECT lag, round(CASE WHEN pairs >= 20 THEN corr END, 6) AS corr, pairs FROM c")
def xcorr(s: SparkSession, d: str) -> DataFrame:
    return stats.lag_correlations(frame(s, d), ["click"], OUTPUT, range(-6, 7), "rn").select("lag", *r6("corr"), "pairs")


@query("q_xcorr_wide", f"""WITH m AS (SELECT CAST(ceil(epoch_us(ts) / 60000000.0) AS BIGINT) AS h, event_type, avg(value) AS v FROM events GROUP BY 1, 2),
  p AS (SELECT x.event_type AS input, CAST(y.h - x.h AS INTEGER) AS lag, y.v AS y, x.v AS x FROM m y JOIN m x ON y.event_type = 'purchase' AND x.event_type IN {INPUTS} AND x.h BETWEEN y.h - 600 AND y.h)
  SELECT input, lag, round({corr_sql('x', 'y')}, 6) AS corr, count(*) AS pairs FROM p GROUP BY 1, 2 HAVING count(*) >= 20""")
def xcorr_wide(s: SparkSession, d: str) -> DataFrame:
    """All lags up to ten hours, a minute apart."""
    minutes = series.resample_mean(table(s, d, "events"), 60)
    found = stats.lag_correlations(minutes, list(INPUTS), OUTPUT, range(601), "rn", block=8192)
    return found.filter("pairs >= 20").select("input", "lag", *r6("corr"), "pairs")


@query("q_delay_bidir", f"WITH {P}, c AS ({XC}) SELECT input, lag AS delay, round(corr, 6) AS corr FROM c WHERE pairs >= 20 AND corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY input ORDER BY round(abs(corr), 12) DESC, abs(lag), lag DESC) = 1")
def delay_bidir(s: SparkSession, d: str) -> DataFrame:
    return stats.best_lags(stats.lag_correlations(frame(s, d), ["click"], OUTPUT, range(-6, 7), "rn")).select("input", "delay", *r6("corr"))


SEG = P + """, O AS (SELECT * FROM P WHERE purchase IS NOT NULL), S AS (SELECT *, sum(CASE WHEN h - ph = 1 THEN 0 ELSE 1 END) OVER (ORDER BY h) AS segment FROM (SELECT *, lag(h) OVER (ORDER BY h) AS ph FROM O))"""
DC = " UNION ALL ".join(f"SELECT '{c}' AS input, {k} AS lag, {corr_sql('x', 'y')} AS corr, count(CASE WHEN y IS NOT NULL THEN x END) AS pairs FROM (SELECT purchase AS y, lag({c}, {k}) OVER (PARTITION BY segment ORDER BY h) AS x FROM S)" for c in INPUTS for k in range(0, 9))


def segmented(s: SparkSession, d: str) -> DataFrame:
    return series.segments(frame(s, d).filter(F.col(OUTPUT).isNotNull()), 1, "h")


@query("q_delay_causal", f"WITH {SEG}, c AS ({DC}) SELECT input, lag AS delay, round(corr, 6) AS corr, pairs AS overlap, lag = 8 AS boundary_hit FROM c WHERE pairs >= 20 AND corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY input ORDER BY round(abs(corr), 12) DESC, lag) = 1")
def delay_causal(s: SparkSession, d: str) -> DataFrame:
    found = stats.lag_correlations(segmented(s, d), list(INPUTS), OUTPUT, range(0, 9), "h", ["segment"])
    return stats.best_lags(found).select("input", "delay", *r6("corr"), "overlap", "boundary_hit")


@query("q_vif2", f"WITH {P}, c AS (SELECT * FROM P WHERE view IS NOT NULL AND click IS NOT NULL), r AS (SELECT {corr_sql('view', 'click')} AS r FROM c) SELECT v.variable, round(1 / (1 - least(r * r, .999999)), 6) AS vif FROM r, (VALUES ('view'), ('click')) v(variable)")
def vif2(s: SparkSession, d: str) -> DataFrame:
    return vif_rows(s, frame(s, d), ["view", "click"])


VIF3 = f"""WITH {P}, c AS (SELECT * FROM P WHERE view IS NOT NULL AND click IS NOT NULL AND signup IS NOT NULL), r AS (SELECT corr(view, click) AS a, corr(view, signup) AS b, corr(click, signup) AS c FROM c),
  m AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r) SELECT v.variable, round(CASE v.variable WHEN 'view' THEN 1 - c * c WHEN 'click' THEN 1 - b * b ELSE 1 - a * a END / det, 6) AS vif FROM m, (VALUES ('view'), ('click'), ('signup')) v(variable)"""


@query("q_vif3", VIF3)
def vif3(s: SparkSession, d: str) -> DataFrame:
    return vif_rows(s, frame(s, d), ["view", "click", "signup"])


@query("q_vif")
def vif_all(s: SparkSession, d: str) -> DataFrame:
    return vif_rows(s, frame(s, d), COLS)


def vif_rows(s: SparkSession, df: DataFrame, columns: list[str]) -> DataFrame:
    factors = stats.vif(stats.correlation_matrix(df, columns))
    return s.createDataFrame([(c, float(round(v, 6))) for c, v in zip(columns, factors)], "variable string, vif double")


@query("q_recommend_variables")
def recommend(s: SparkSession, d: str) -> DataFrame:
    m = stats.correlation_matrix(frame(s, d), [*INPUTS, "error", OUTPUT])
    names = [*INPUTS, "error"]
    return s.createDataFrame(stats.recommend(m[:-1, :-1], m[-1, :-1], names, strong=0.05, most=1.001), "variable string, kept boolean, reason string")


@query("q_quality_radar")
def quality_radar(s: SparkSession, d: str) -> DataFrame:
    """The three lowest dimensions of quality and the mean of all four, each measured."""
    from .process import repaired

    raw = frame(s, d)
    worst = float(np.max(stats.vif(stats.correlation_matrix(raw, COLS))))
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    step = F.col("h") - F.lag("h").over(Window.orderBy("h"))
    spread = F.when(F.count_distinct("step") == 1, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.stddev_samp("step")))
    one = raw.withColumn("step", step).agg((100 * (1 - mean([F.avg(F.col(c).isNull().cast("double")) for c in COLS]))).alias("completeness"), spread.alias("consistency")).first()
    valid = repaired(s, d).agg(100 * (1 - mean([F.avg(F.col(f"{c}_bad").cast("double")) for c in COLS]))).first()[0]
    rows = [("completeness", one["completeness"]), ("consistency", one["consistency"]), ("validity", valid)]  # single numbers
    parts = s.createDataFrame(rows, "dimension string, score double").unionByName(s.range(1).select(F.lit("collinearity").alias("dimension"), windows.collinearity_score(F.lit(worst)).cast("double").alias("score")))
    return parts.withColumn("mean", F.round(F.avg("score").over(Window.partitionBy()), 4)).orderBy("score", "dimension").limit(3).withColumn("score", F.round("score", 4))


@query("q_topk_features", f"WITH {P}, c AS ({CORR}) SELECT CASE WHEN a = 'purchase' THEN b ELSE a END AS variable FROM c WHERE 'purchase' IN (a, b) ORDER BY round(abs(corr), 9) DESC, 1 LIMIT 2")
def topk_features(s: SparkSession, d: str) -> DataFrame:
    c = stats.correlations(frame(s, d), COLS).filter(f"'{OUTPUT}' in (a, b)").select(F.when(F.col("a") == OUTPUT, F.col("b")).otherwise(F.col("a")).alias("variable"), "corr")
    return c.orderBy(F.round(F.abs("corr"), 9).desc(), "variable").limit(2).select("variable")


@query("q_merge_group", f"WITH {P}, m AS (SELECT avg(view) AS a, stddev_pop(view) AS b, avg(click) AS c, stddev_pop(click) AS d FROM P) SELECT rn, round((SELECT avg(z) FROM (VALUES ((view - a) / nullif(b, 0)), ((click - c) / nullif(d, 0))) t(z)), 6) AS merged FROM P, m")
def merge_group(s: SparkSession, d: str) -> DataFrame:
    return stats.merge_groups(frame(s, d), [["view", "click"]]).select(F.col("rn").cast("long").alias("rn"), F.round("merged_1", 6).alias("merged"))


SALES = "l_quantity AS quantity, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, l_discount AS discount, -l_discount * 100 AS percent"
SALE_COLUMNS = ("quantity", "price", "net", "gross", "discount", "percent")
SALE_PAIRS = " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, corr({x}, {y}) AS r FROM S" for i, x in enumerate(SALE_COLUMNS) for j, y in enumerate(SALE_COLUMNS) if i < j)
SALE_Z = " UNION ALL ".join(f"SELECT row, k, n, {i} AS c, ({x} - (SELECT avg({x}) FROM S)) / (SELECT stddev_pop({x}) FROM S) AS z FROM S" for i, x in enumerate(SALE_COLUMNS))


@query("q_merge_groups", f"""WITH RECURSIVE S AS (SELECT row_number() OVER () AS row, l_orderkey AS k, l_linenumber AS n, {SALES} FROM lineitem), p AS (SELECT a, b FROM ({SALE_PAIRS}) WHERE abs(r) >= .9),
  e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS c, a AS m FROM e UNION SELECT r.c, e.b FROM r JOIN e ON e.a = r.m), g AS (SELECT c, min(m) AS g FROM r GROUP BY 1), Z AS ({SALE_Z})
  SELECT k, n, 'merged_' || dense_rank() OVER (ORDER BY g) AS variable, round(v, 6) AS value FROM (SELECT row, any_value(k) AS k, any_value(n) AS n, g, avg(z) AS v FROM Z JOIN g USING (c) GROUP BY row, g)""")
def merge_groups(s: SparkSession, d: str) -> DataFrame:
    """Measures of sales that say the same become one each; which do is found from the data."""
    price, off = F.col("l_extendedprice"), 1 - F.col("l_discount")
    sales = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("quantity"), price.alias("price"), (price * off).alias("net"), (price * off * (1 + F.col("l_tax"))).alias("gross"), F.col("l_discount").alias("discount"), (-F.col("l_discount") * 100).alias("percent"))
    groups = stats.correlated_groups(stats.correlation_matrix(sales, SALE_COLUMNS), SALE_COLUMNS)
    merged = stats.merge_groups(sales, groups)
    return long_form(merged, [f"merged_{i + 1}" for i in range(len(groups))], ["k", "n"]).select("k", "n", "variable", *r6("value"))


@query("q_input_filter", f"WITH {P}, v AS ({LONG}) SELECT variable, count(value) AS n, count(DISTINCT value) AS n_distinct, count(value) >= 20 AND count(DISTINCT value) >= 4 AND coalesce(stddev_samp(value) > 1e-12, false) AS usable FROM v GROUP BY 1")
def input_filter(s: SparkSession, d: str) -> DataFrame:
    v = longer(s, d).groupBy("variable").agg(F.count("value").alias("n"), F.count_distinct("value").alias("n_distinct"), F.stddev_samp("value").alias("_s"))
    return v.select("variable", "n", "n_distinct", ((F.col("n") >= 20) & (F.col("n_distinct") >= 4) & F.coalesce(F.col("_s") > 1e-12, F.lit(False))).alias("usable"))


METRICS = """x AS (SELECT y, p, y - p AS e FROM v WHERE y IS NOT NULL AND p IS NOT NULL), a AS (SELECT count(*) AS n, sum(e * e) AS sse, avg(abs(e)) AS mae, count(*) * var_pop(y) AS total FROM x)
  SELECT n, round(sse, 4) AS sse, round(sse / n, 6) AS mse, round(sqrt(sse / n), 6) AS rmse, round(mae, 6) AS mae, round(1 - sse / nullif(total, 0), 6) AS r2, round(1 - (sse / nullif(total, 0)) * (n - 1) / nullif(n - 3, 0), 6) AS adj_r2, round(sse / n * (n + 2) / nullif(n - 2, 0), 6) AS fpe, round(n * ln(nullif(sse / n, 0)) + 4, 6) AS aic, round(n * ln(nullif(sse / n, 0)) + 2 * ln(n), 6) AS bic FROM a"""


@query("q_reg_metrics", f"WITH {P}, v AS (SELECT purchase AS y, .5 * view + .5 * click AS p FROM P), {METRICS}")
def reg_metrics(s: SparkSession, d: str) -> DataFrame:
    m = stats.regression_metrics(F.col(OUTPUT), 0.5 * F.col("view") + 0.5 * F.col("click"), 2)
    return frame(s, d).agg(*[F.round(c, 4 if n == "sse" else 6).alias(n) if n != "n" else c.alias(n) for n, c in m.items()])


@query("q_acf", f"WITH {P}, c AS (SELECT rn, coalesce(click, 0) - avg(coalesce(click, 0)) OVER () AS x FROM P) " + " UNION ALL ".join(f"SELECT {k} AS lag, round(sum(x * l) / nullif(sum(x * x), 0), 6) AS autocorrelation FROM (SELECT x, lag(x, {k}) OVER (ORDER BY rn) AS l FROM c)" for k in range(1, 11)))
def acf(s: SparkSession, d: str) -> DataFrame:
    w = series.ordered("rn")
    x = F.coalesce(F.col("click"), F.lit(0.0))
    c = frame(s, d).select("rn", (x - F.avg(x).over(Window.partitionBy())).alias("x")).withColumns({f"l{k}": F.lag("x", k).over(w) for k in range(1, 11)})
    one = c.agg(*[(F.sum(F.col("x") * F.col(f"l{k}")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias(f"a{k}") for k in range(1, 11)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.round(f"a{k}", 6).alias("autocorrelation")) for k in range(1, 11)])).alias("x")).select("x.*")


@query("q_acf_segment", f"WITH {SEG} " + " UNION ALL ".join(f"SELECT {k} AS lag, round(CASE WHEN count(CASE WHEN x IS NOT NULL THEN purchase END) >= 3 THEN coalesce({corr_sql('x', 'purchase')}, 0) END, 6) AS autocorrelation, count(CASE WHEN x IS NOT NULL THEN purchase END) AS valid_pairs FROM (SELECT purchase, lag(purchase, {k}) OVER (PARTITION BY segment ORDER BY h) AS x FROM S)" for k in range(1, 6)))
def acf_segment(s: SparkSession, d: str) -> DataFrame:
    found = stats.lag_correlations(segmented(s, d), [OUTPUT], OUTPUT, range(1, 6), "h", ["segment"], least=3)
    return found.select("lag", F.round(F.when(F.col("pairs") >= 3, F.coalesce("corr", F.lit(0.0))), 6).alias("autocorrelation"), F.col("pairs").alias("valid_pairs"))


@query("q_persistence", f"WITH {P}, b AS (SELECT purchase AS y, last_value(purchase IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, last_value(click IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM P), m AS (SELECT sqrt(avg((y - p) ** 2)) AS baseline, sqrt(avg((y - q) ** 2)) AS model FROM b WHERE y IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL) SELECT round(baseline, 6) AS baseline, round(model, 6) AS model, round(CASE WHEN baseline > 0 THEN 100 * (baseline - model) / baseline END, 6) AS improvement FROM m")
def persistence(s: SparkSession, d: str) -> DataFrame:
    w = series.ordered("rn").rowsBetween(Window.unboundedPreceding, -1)
    b = frame(s, d).select(F.col(OUTPUT).alias("y"), F.last(OUTPUT, True).over(w).alias("p"), F.last("click", True).over(w).alias("q")).dropna()
    m = b.agg(F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)).alias("baseline"), F.sqrt(F.avg((F.col("y") - F.col("q")) ** 2)).alias("model"))
    return m.select(*r6("baseline", "model"), F.round(improvement_percent(F.col("baseline"), F.col("model")), 6).alias("improvement"))


@query("q_target_hash", "SELECT user_id, sha256(string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), chr(10) ORDER BY ts)) AS target_hash, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def target_hash(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").filter("event_type = 'purchase'")
    return e.groupBy("user_id").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))), 256).alias("target_hash"), F.count(F.lit(1)).alias("n"))


CLASS = "c AS (SELECT quality AS y, CASE WHEN doc_id % 3 = 0 THEN 1 - toxic ELSE 1 END AS p FROM labels), k AS (SELECT v.k, count(*) FILTER (y = v.k AND p = v.k) AS tp, count(*) FILTER (y <> v.k AND p = v.k) AS fp, count(*) FILTER (y = v.k AND p <> v.k) AS fn, count(*) AS n FROM c, (VALUES (0), (1)) v(k) GROUP BY 1)"


@query("q_class_metrics", f"WITH {CLASS} SELECT k AS label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS \"precision\", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((SELECT sum(tp) FROM k) / n, 6) AS accuracy, round((SELECT avg(2 * tp / nullif(2 * tp + fp + fn, 0)) FROM k), 6) AS macro_f1 FROM k")
def class_metrics(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "labels").select(F.col("quality").alias("y"), F.when(F.col("doc_id") % 3 == 0, 1 - F.col("toxic")).otherwise(1).alias("p"))
    k = c.withColumn("label", F.explode(F.array(F.lit(0), F.lit(1)))).groupBy("label").agg(F.count_if((F.col("y") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"), F.count_if((F.col("y") != F.col("label")) & (F.col("p") == F.col("label"))).alias("fp"), F.count_if((F.col("y") == F.col("label")) & (F.col("p") != F.col("label"))).alias("fn"), F.count(F.lit(1)).alias("n"))
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    f1, w = over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), Window.partitionBy()
    return k.select("label", "tp", "fp", "fn", F.round(over(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(over(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(F.sum("tp").over(w) / F.col("n"), 6).alias("accuracy"), F.round(F.avg(f1).over(w), 6).alias("macro_f1"))


@query("q_drift_summary", "WITH l AS (SELECT * FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20) SELECT user_id, round(avg(value), 6) AS mean, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_rate, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.25 AS warning FROM l GROUP BY 1")
def drift_summary(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(s, d, "events").withColumn("n", F.row_number().over(w)).filter("n <= 20")
    rate = F.avg((F.col("event_type") == "error").cast("double"))
    return last.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(rate, 6).alias("error_rate"), (rate > 0.25).alias("warning"))


@query("q_status_counts", "SELECT count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders")
def status_counts(s: SparkSession, d: str) -> DataFrame:
    x = F.col("o_orderstatus")
    return table(s, d, "orders").agg(F.count_if(x == "F").alias("done"), F.count_if(x == "O").alias("open"), F.count_if(~x.isin("F", "O")).alias("other"))


@query("q_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY 1")
def distinct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"))


@query("q_approx_distinct")
def approx_distinct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"))


@query("q_cube", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("q_rollup", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))


# ranks, running values and streaks

@query("q_rank_suite", "SELECT event_id, CAST(rank() OVER w AS BIGINT) AS rank, CAST(dense_rank() OVER w AS BIGINT) AS dense_rank, CAST(ntile(4) OVER w AS BIGINT) AS quartile, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist, round(sum(value) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent FROM (SELECT *, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, CAST(round(value) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY v, event_id)")
def rank_suite(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400000000)).cast("long")).withColumn("v", F.round("value").cast("long"))
    w = Window.partitionBy("user_id").orderBy("v", "event_id")
    recent = Window.partitionBy("user_id").orderBy("day").rangeBetween(-2, 0)
    return e.select("event_id", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense_rank"), F.ntile(4).over(w).cast("long").alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("percent_rank"), F.round(F.cume_dist().over(w), 6).alias("cume_dist"), F.round(F.sum("value").over(recent), 4).alias("recent"))


RUNS = "r AS (SELECT o_custkey AS study, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS round, o_totalprice AS score, o_orderkey FROM orders)"


def rounds(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select(F.col("o_custkey").alias("study"), F.row_number().over(w).cast("long").alias("round"), F.col("o_totalprice").alias("score"), "o_orderkey")


def by_round():
    return Window.partitionBy("study").orderBy("round")


@query("q_round_delta", f"WITH {RUNS} SELECT study, round, round(score - lag(score) OVER (PARTITION BY study ORDER BY round), 4) AS delta FROM r")
def round_delta(s: SparkSession, d: str) -> DataFrame:
    return rounds(s, d).select("study", "round", F.round(F.col("score") - F.lag("score").over(by_round()), 4).alias("delta"))


@query("q_best_so_far", f"WITH {RUNS} SELECT study, round, max(score) OVER (PARTITION BY study ORDER BY round) AS best FROM r")
def best_so_far(s: SparkSession, d: str) -> DataFrame:
    return rounds(s, d).select("study", "round", F.max("score").over(by_round()).alias("best"))


@query("q_running_max", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place, max(value) OVER (ORDER BY event_id) AS best FROM events")
def running_max(s: SparkSession, d: str) -> DataFrame:
    """Over all events as one series, block by block."""
    placed = scan.row_numbers(table(s, d, "events"), "event_id", width=2048)
    return scan.running_max(placed, F.col("value"), "event_id", width=2048).select("event_id", "place", "best")


@query("q_streak", f"WITH {RUNS}, b AS (SELECT study, round, score > coalesce(max(score) OVER (PARTITION BY study ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better FROM r), g AS (SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY study ORDER BY round) AS island FROM b) SELECT study, round, row_number() OVER (PARTITION BY study, island ORDER BY round) - 1 AS streak FROM g")
def streak(s: SparkSession, d: str) -> DataFrame:
    before = F.max("score").over(by_round().rowsBetween(Window.unboundedPreceding, -1))
    b = rounds(s, d).withColumn("better", (F.col("score") > F.coalesce(before, F.lit(-1.0))).cast("int"))
    g = b.withColumn("island", F.sum("better").over(by_round().rowsBetween(Window.unboundedPreceding, 0)))
    return g.select("study", "round", (F.row_number().over(Window.partitionBy("study", "island").orderBy("round")) - 1).cast("long").alias("streak"))


@query("q_study_decisions", f"""WITH {RUNS}, b AS (SELECT *, max(score) OVER (PARTITION BY study ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY study, CAST(floor(score / 1000) AS BIGINT) ORDER BY round) > 1 AS seen FROM r)
  SELECT study, round, CASE WHEN seen THEN 'equivalent' WHEN score < 20000 THEN 'infeasible' WHEN best IS NULL OR score > best THEN 'new_best' ELSE 'not_improved' END AS decision FROM b""")
def study_decisions(s: SparkSession, d: str) -> DataFrame:
    """A candidate whose signature was tried before is equivalent; one that breaks a constraint infeasible; else it is compared with the best before."""
    signature = F.floor(F.col("score") / 1000).cast("long")
    b = rounds(s, d).withColumn("signature", signature).withColumn("best", F.max("score").over(by_round().rowsBetween(Window.unboundedPreceding, -1)))
    b = b.withColumn("seen", F.row_number().over(Window.partitionBy("study", "signature").orderBy("round")) > 1)
    return b.select("study", "round", F.when(F.col("seen"), "equivalent").when(F.col("score") < 20000, "infeasible").when(F.col("best").isNull() | (F.col("score") > F.col("best")), "new_best").otherwise("not_improved").alias("decision"))


CONVERGE = RUNS + """, v AS (SELECT study, round, score / 4000 AS score, CAST(floor(score / 1000) AS BIGINT) AS signature, (o_orderkey % 100) / 5000.0 AS fit, score >= 20000 AS valid, o_orderkey % 5 = 0 AS edge FROM r),
  x AS (SELECT *, row_number() OVER (PARTITION BY study, signature ORDER BY round) > 1 AS seen FROM v)"""


@query("q_study_convergence", f"""WITH RECURSIVE {CONVERGE},
  t AS (SELECT study, round, CASE WHEN valid THEN 'new_best' ELSE 'infeasible' END AS decision, true AS is_best, score AS gain, true AS meaningful, valid AS bv, score AS bs, fit AS bf, edge AS be, CAST(0 AS BIGINT) AS idle, 'running' AS status FROM x WHERE round = 1
    UNION ALL SELECT study, round, decision, better, gain, told, CASE WHEN better THEN valid ELSE bv END, CASE WHEN better THEN score ELSE bs END, CASE WHEN better THEN fit ELSE bf END, CASE WHEN better THEN edge ELSE be END, idle,
      CASE WHEN status <> 'running' THEN 'after' WHEN round >= 8 AND round < 16 AND idle >= 3 AND CASE WHEN better THEN valid AND NOT edge ELSE bv AND NOT be END THEN 'converged' WHEN round >= 16 THEN 'limit' ELSE 'running' END
      FROM (SELECT *, CASE WHEN told THEN 0 ELSE old + 1 END AS idle FROM (SELECT *, NOT seen AND (valid AND NOT bv OR better AND (round(gain, 9) >= .2 OR round(fit - bf, 9) >= .003)) AS told,
        CASE WHEN seen THEN 'equivalent' WHEN NOT valid THEN 'infeasible' WHEN better THEN 'new_best' ELSE 'not_improved' END AS decision
        FROM (SELECT x.*, t.bv, t.bs, t.bf, t.be, t.status, t.idle AS old, x.score - t.bs AS gain, NOT x.seen AND CASE WHEN x.valid <> t.bv THEN x.valid ELSE x.score > t.bs END AS better FROM t JOIN x ON x.study = t.study AND x.round = t.round + 1))))
  SELECT study, round, decision, is_best, round(gain, 6) AS gain, meaningful, CAST(idle AS BIGINT) AS idle, status FROM t""")
def study_convergence(s: SparkSession, d: str) -> DataFrame:
    """Orders stand for the rounds of a customer's study; the SQL goes from round to round."""
    c = F.col
    r = rounds(s, d).select("study", "round", (c("score") / 4000).alias("score"), F.floor(c("score") / 1000).cast("long").alias("signature"), ((c("o_orderkey") % 100) / 5000.0).alias("fit"), (c("score") >= 20000).alias("valid"), (c("o_orderkey") % 5 == 0).alias("boundary_hit"))
    return studies.decide(r).select("study", "round", "decision", "is_best", *r6("gain"), "meaningful", "idle", "status")


# the application's reads

@query("q_latest_runs", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def latest_runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_totalprice")


@query("q_table_page", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey DESC LIMIT 100")
def table_page(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    page = c.orderBy(F.desc("c_custkey")).limit(100).select("c_custkey", "c_name")
    return page.join(F.broadcast(c.agg(F.count(F.lit(1)).alias("total"))))  # one row


@query("q_queue_head", "SELECT o_orderpriority, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS head FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def queue_head(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").filter("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("head"))


@query("q_retention", "WITH r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_orderkey FROM r WHERE n > 1 AND (n > 5 OR o_orderdate < TIMESTAMP '1997-01-01')")
def retention(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    r = table(s, d, "orders").withColumn("n", F.row_number().over(w))
    return r.filter((F.col("n") > 1) & ((F.col("n") > 5) | (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))).select("o_orderkey")


@query("q_best_experiment", "SELECT o_orderpriority, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS best, max(o_totalprice) AS score FROM orders GROUP BY 1")
def best_experiment(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.max("o_totalprice").alias("score"))


@query("q_feedback_stats", "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS conflicts FROM orders GROUP BY 1")
def feedback_stats(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("conflicts"))


@query("q_feedback_latest", "SELECT o_orderstatus AS status, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10")
def feedback_latest(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(s, d, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 10").select(F.col("o_orderstatus").alias("status"), "o_orderkey")


@query("q_feedback_log", """WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS n, CASE event_type WHEN 'view' THEN 'submit' WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'revoke' END AS action FROM events),
  z AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS action, 'none' AS before, 'none' AS after FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT e.user_id, e.n, e.event_id, e.action, z.after, CASE WHEN e.action = 'submit' AND z.after IN ('none', 'rejected') THEN 'pending' WHEN e.action = 'approve' AND z.after = 'pending' THEN 'approved' WHEN e.action = 'reject' AND z.after = 'pending' THEN 'rejected' WHEN e.action = 'revoke' AND z.after = 'approved' THEN 'rejected' ELSE z.after END FROM z JOIN e ON e.user_id = z.user_id AND e.n = z.n + 1)
  SELECT event_id, user_id, action, before, after, CASE WHEN before <> after THEN 'applied' WHEN action = 'submit' OR (action = 'approve' AND after = 'approved') OR (action = 'reject' AND after = 'rejected') THEN 'unchanged' ELSE 'refused' END AS outcome FROM z WHERE n > 0""")
def feedback_log(s: SparkSession, d: str) -> DataFrame:
    """Events stand for steps of review, users for records."""
    action = F.when(F.col("event_type").isin("view", "signup"), "submit").when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "error", "reject").otherwise("revoke")
    log = table(s, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("record"), F.col("ts").cast("timestamp").alias("at"), action.alias("action"), F.lit("user").alias("actor"), F.lit(None).cast("string").alias("note"))
    return feedback.fold_log(log).select(F.col("event_id").cast("long").alias("event_id"), F.col("record").cast("long").alias("user_id"), "action", "before", "after", "outcome")


@query("q_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at, count(*) AS changes FROM events GROUP BY 1")
def latest_state(s: SparkSession, d: str) -> DataFrame:
    """State from a log that is only appended to: the last record of each key, without a sort."""
    return table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("changes"))


@query("q_param_diff", "SELECT p_brand, count(DISTINCT p_type) > 1 AS type_differs, count(DISTINCT p_size) > 1 AS size_differs FROM part GROUP BY 1")
def param_diff(s: SparkSession, d: str) -> DataFrame:
    # more than one distinct value exactly if the least and the largest differ: no set of values is kept
    return table(s, d, "part").groupBy("p_brand").agg((F.min("p_type") != F.max("p_type")).alias("type_differs"), (F.min("p_size") != F.max("p_size")).alias("size_differs"))


@query("q_boxplot", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value - 100, {q}), 6) AS q{int(q * 100)}" for q in (0, 0.25, 0.5, 0.75, 1)) + " FROM events GROUP BY 1")
def boxplot(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "events").groupBy("event_type").agg(F.percentile(F.col("value") - 100, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q"))
    return b.select("event_type", *[F.round(F.col("q")[i], 6).alias(f"q{n}") for i, n in enumerate((0, 25, 50, 75, 100))])


@query("q_winner_view", "WITH w AS (SELECT o_orderkey, o_totalprice * 2 AS p FROM orders WHERE o_orderpriority = '1-URGENT') SELECT o.o_orderkey, round(coalesce(w.p, o.o_totalprice), 4) AS price, w.p IS NOT NULL AS overlaid FROM orders o LEFT JOIN w USING (o_orderkey)")
def winner_view(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    w = o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("p"))
    return o.join(w, "o_orderkey", "left").select("o_orderkey", F.round(F.coalesce("p", "o_totalprice"), 4).alias("price"), F.col("p").isNotNull().alias("overlaid"))


# joins and sets

@query("q_join_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_inner(s: SparkSession, d: str) -> DataFrame:
    o, c, n = table(s, d, "orders").select("o_custkey", "o_totalprice"), table(s, d, "customer").select("c_custkey", "c_nationkey"), table(s, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


@query("q_join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(s, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("q_join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_semi(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "orders").filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("q_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_anti(s: SparkSession, d: str) -> DataFrame:
    large = table(s, d, "orders").filter("o_totalprice > 250000")
    return table(s, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("q_join_full", "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_custkey % 7 = 0) FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) ON c_custkey = s_suppkey")
def join_full(s: SparkSession, d: str) -> DataFrame:
    c, p = table(s, d, "customer").filter("c_custkey % 7 = 0"), table(s, d, "supplier").filter("s_suppkey % 3 = 0")
    return c.join(p, F.col("c_custkey") == F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@query("q_lookup_join", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_join(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation"), table(s, d, "region")
    look = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    return table(s, d, "supplier").join(F.broadcast(look), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")  # 25 nations


@query("q_fk_join", "SELECT o_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 48")
def fk_join(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").filter("l_quantity > 48").select("l_orderkey", "l_linenumber")
    o, c = table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").select("c_custkey", "c_name")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "l_linenumber", "c_name")


@query("q_set_diff", "(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_diff(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).subtract(table(s, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@query("q_setops", "WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
def setops(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    tag = lambda name, df: df.select(F.lit(name).alias("op"), "k")
    return tag("union", a.union(b).distinct()).union(tag("intersect", a.intersect(b))).union(tag("except", a.subtract(b)))


@query("q_scan_pruned", "SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01'")
def scan_pruned(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).select("l_orderkey", "l_shipdate", "l_quantity")


@query("q_audit_hash", "SELECT n_nationkey, sha256(concat_ws('|', n_nationkey, n_name, n_regionkey)) AS sha256, substr(sha1(n_name), 1, 12) AS signature FROM nation")
def audit_hash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), 256).alias("sha256"), F.substring(F.sha1("n_name"), 1, 12).alias("signature"))


@query("q_restore_minmax", "SELECT l_orderkey, l_linenumber, round(l_discount / 0.1 * (50 - 10) + 10, 6) AS restored FROM lineitem")
def restore_minmax(s: SparkSession, d: str) -> DataFrame:
    """Values that were scaled to 0..1 from 10..50, scaled back."""
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") / 0.1 * (50 - 10) + 10, 6).alias("restored"))


@query("q_restore_zscore", "WITH m AS (SELECT avg(c_acctbal) AS mu, stddev_pop(c_acctbal) AS sd FROM customer) SELECT c_custkey, round((c_acctbal - mu) / nullif(sd, 0) * 4 + 20, 6) AS restored FROM customer, m")
def restore_zscore(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    m = c.agg(F.avg("c_acctbal").alias("mu"), F.stddev_pop("c_acctbal").alias("sd"))
    return c.join(F.broadcast(m)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)) * 4 + 20, 6).alias("restored"))


@query("q_pair_corr_by_user", f"WITH x AS (SELECT user_id, date_trunc('day', ts) AS day, avg(CASE WHEN event_type = 'view' THEN value END) AS x, avg(CASE WHEN event_type = 'click' THEN value END) AS y FROM events GROUP BY 1, 2) SELECT user_id, round({corr_sql('x', 'y')}, 6) AS corr FROM x GROUP BY 1")
def pair_corr_by_user(s: SparkSession, d: str) -> DataFrame:
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    x = table(s, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(of("view").alias("x"), of("click").alias("y"))
    return x.groupBy("user_id").agg(F.round(correlation(F.col("x"), F.col("y")), 6).alias("corr"))
