"""Sliding windows over a regular frame: scores, signal to noise, levels and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.functions.numeric import clip, median

#: Shares of the five part scores, and scales of the two ranges.
WEIGHTS = {"input_change": 0.35, "output_response": 0.25, "completeness": 0.20, "anomaly": 0.10, "smoothness": 0.10}
INPUT_SCALE, OUTPUT_SCALE = 1500.0, 1800.0
STRICT, USABLE, SNR_DB = 80.0, 60.0, 10.0


def explode_windows(df: DataFrame, size: int = 30, step: int = 15, order: str = "rn", keys: Sequence[str] = ()) -> DataFrame:
    """Each row once for every window it is in: windows of `size` rows start every `step` rows and are all full."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    first = F.greatest(F.lit(0), F.ceil((F.col(order) - (size - 1)) / step)).cast("long")
    last = F.least(F.floor(F.col(order) / step), F.floor((F.col("_n") - size) / step)).cast("long")
    return df.withColumn("_n", n).withColumn("_a", first).withColumn("_b", last).filter("_b >= _a").withColumn("window_id", F.explode(F.sequence("_a", "_b"))).drop("_n", "_a", "_b")


def relative_range(x: Column, scale: float) -> Column:
    """The middle 90 % of the values in units of the mean size, scaled, at most 100; 0 with fewer than 3 values or none that differ from 0."""
    size = F.avg(F.abs(x))
    spread = F.percentile(x, F.lit(0.95)) - F.percentile(x, F.lit(0.05))
    return F.when((F.count(x) < 3) | (size == 0), 0.0).otherwise(F.least(F.lit(100.0), spread / size * scale))


def smoothness(change: Column, x: Column) -> Column:
    """100 for a constant series, less by 600 times the mean change in units of the mean size; 0 at least."""
    return F.greatest(F.lit(0.0), 100 - 600 * F.avg(F.abs(change)) / (F.avg(F.abs(x)) + 1e-9))


def snr(df: DataFrame, column: str, groups: Sequence[str], order: str = "rn", least: int = 15) -> DataFrame:
    """groups, variable, snr_db, signal_power, noise_power, valid_samples of one column."""
    return _snr(df, column, groups, order, least).withColumn("variable", F.lit(column))


def snr_of_all(df: DataFrame, columns: Sequence[str], groups: Sequence[str], order: str = "rn", least: int = 15) -> DataFrame:
    """The same of several columns, in one pass over a row for each of them."""
    tall = df.unpivot([*groups, order], list(columns), "variable", "_value")
    return _snr(tall, "_value", [*groups, "variable"], order, least)


def _snr(df: DataFrame, column: str, groups: Sequence[str], order: str, least: int) -> DataFrame:
    """White noise is told from second differences by their median deviation."""
    w = Window.partitionBy(*groups).orderBy(order)
    x = F.col(column)
    second = x - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)
    d = df.select(*groups, x.alias("_x"), second.alias("_d2"))
    middle = F.percentile("_d2", F.lit(0.5)).over(Window.partitionBy(*groups))
    d = d.withColumn("_away", F.abs(F.col("_d2") - middle))
    stats = d.groupBy(*groups).agg(F.count("_x").alias("valid_samples"), F.count("_d2").alias("_n2"), F.var_pop("_x").alias("_total"), (median(F.col("_away")) / 0.67448975 / F.sqrt(F.lit(6.0))).alias("_sigma"))
    ok = (F.col("valid_samples") >= max(15, least)) & (F.col("_n2") >= max(12, max(15, least) - 3)) & (F.col("_total") > 1e-12) & (F.col("_sigma") > 1e-12)
    noise = F.col("_sigma") * F.col("_sigma")
    signal = F.greatest(F.col("_total") - noise, F.lit(1e-12))
    return stats.select(*groups, F.when(ok, 10 * F.log10(signal / noise)).alias("snr_db"), F.when(ok, signal).alias("signal_power"), F.when(ok, noise).alias("noise_power"), F.col("valid_samples").cast("long").alias("valid_samples"))


def window_snr(snrs: DataFrame, inputs: Sequence[str], outputs: Sequence[str], groups: Sequence[str] = ("window_id",)) -> DataFrame:
    """The best input's or the worst output's, whichever is less; null unless every output has one and some input."""
    of = lambda names: F.when(F.col("variable").isin(*names), F.col("snr_db"))
    return snrs.groupBy(*groups).agg(F.max(of(inputs)).alias("_i"), F.min(of(outputs)).alias("_o"), F.count(of(outputs)).alias("_n")).select(*groups, F.when((F.col("_n") == len(outputs)) & F.col("_i").isNotNull(), F.least("_i", "_o")).alias("snr_db"))


def score_windows(df: DataFrame, inputs: Sequence[str], output: str, columns: Sequence[str], flags: Sequence[str] = (), size: int = 30, step: int = 15, order: str = "rn", keys: Sequence[str] = (), weights: dict[str, float] = WEIGHTS, scales: tuple[float, float] = (INPUT_SCALE, OUTPUT_SCALE), levels: tuple[float, float, float] = (STRICT, USABLE, SNR_DB)) -> DataFrame:
    """One row for each window: its five part scores, segment_score, snr_db, output_observations and level (strict, usable, rejected).

    Levels test the unrounded score. Rows are multiplied by size / step; everything else is one aggregate for each
    window and one for each variable's signal to noise.
    """
    groups = [*keys, "window_id"]
    rows = explode_windows(df, size, step, order, keys)
    w = Window.partitionBy(*groups).orderBy(order)
    rows = rows.withColumns({f"_d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    missing = mean([F.avg(F.col(c).isNull().cast("double")) for c in columns])
    bad = mean([F.avg(F.col(f).cast("double")) for f in flags]) if flags else F.lit(0.0)
    scores = rows.groupBy(*groups).agg(
        F.min(order).alias("start_rn"), F.max(order).alias("end_rn"), mean([relative_range(F.col(c), scales[0]) for c in inputs]).alias("input_change"), relative_range(F.col(output), scales[1]).alias("output_response"),
        (100 * (1 - missing)).alias("completeness"), (100 * (1 - bad)).alias("anomaly"), mean([smoothness(F.col(f"_d_{c}"), F.col(c)) for c in columns]).alias("smoothness"), F.count(output).alias("output_observations"),
    )
    snrs = snr_of_all(rows, [*inputs, output], groups, order)
    scores = scores.join(window_snr(snrs, inputs, [output], groups), groups)
    scores = scores.withColumn("score", sum((F.col(name) * share for name, share in weights.items()), F.lit(0.0)))
    return scores.withColumn("level", level(F.col("score"), F.col("snr_db"), *levels))


def level(score: Column, snr_db: Column, strict: float = STRICT, usable: float = USABLE, least_db: float = SNR_DB) -> Column:
    return F.when((score >= strict) & (snr_db >= least_db), "strict").when(score >= usable, "usable").otherwise("rejected")


def top_windows(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k best windows of the best level that has any: strict, else usable, else whatever scores highest."""
    tier = F.when(F.col("level") == "strict", 0).when(F.col("level") == "usable", 1).otherwise(2)
    best = scores.withColumn("tier", tier).withColumn("_best", F.min("tier").over(Window.partitionBy()))
    return best.filter("tier = _best").orderBy(F.desc("score"), "window_id").limit(k).drop("_best")


def rows_in_windows(df: DataFrame, windows: DataFrame, order: str = "rn", block: int = 1024) -> DataFrame:
    """Rows of df inside any of the windows (start_rn, end_rn), each once.

    Windows are spread over the blocks of rows that they reach into, and rows meet those of their block: an equi-join,
    which Spark broadcasts where the windows are few.
    """
    spread = windows.select(F.explode(F.sequence(F.floor(F.col("start_rn") / block), F.floor(F.col("end_rn") / block))).alias("_block"), "start_rn", "end_rn")
    inside = (F.col("_own") == F.col("_block")) & (F.col(order) >= F.col("start_rn")) & (F.col(order) <= F.col("end_rn"))
    return df.withColumn("_own", F.floor(F.col(order) / block)).join(spread, inside, "left_semi").drop("_own")


def strongest(events: DataFrame, order: str, strength: str, cooldown: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, order, strength of the events that are kept: a later one within the cooldown takes the place of the last one kept if it is stronger.

    What is kept depends on what was kept before, so runs of events are folded in order; events that are further apart
    than the cooldown start a new run, which knows nothing of the others and is a group of its own.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) <= cooldown, 0).otherwise(1)
    runs = events.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(strength).alias("x")))).alias("found"))
    fold = f"""aggregate(slice(found, 2, size(found)), named_struct('done', slice(found, 1, 0), 'last', found[0]),
      (s, e) -> case when e.t - s.last.t > {int(cooldown)} then named_struct('done', concat(s.done, array(s.last)), 'last', e)
                     when e.x > s.last.x then named_struct('done', s.done, 'last', e) else s end,
      s -> concat(s.done, array(s.last)))"""
    return found.select(*keys, F.explode(F.expr(fold)).alias("e")).select(*keys, F.col("e.t").alias(order), F.col("e.x").alias(strength))


def quality_score(completeness: Column, validity: Column, smooth: Column, dynamic: Column | None, consistency: Column) -> Column:
    """The five dimensions' weighted sum; without windows the others' shares are scaled up."""
    rest = 0.25 * completeness + 0.20 * validity + 0.15 * smooth + 0.10 * consistency
    return rest / 0.70 if dynamic is None else rest + 0.30 * dynamic


def collinearity_score(vif: Column) -> Column:
    return clip(110 - 8 * vif, 0, 100)
