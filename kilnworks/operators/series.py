"""Causal transforms of time series: grids, fills, flags, segments, lags and splits.

Every operator orders by an explicit column. `keys` name the series: rows of different series never meet, and Spark
deals them to different tasks. One series without keys is ordered in one task, which is meant for frames that are
already resampled; in_blocks() deals a longer one into blocks with the rows before them, and the module scan numbers
its rows and segments block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EVENT_TYPES = ("view", "click", "error", "purchase", "signup")
INPUTS = ("view", "click", "signup")
DISTURBANCE = "error"
OUTPUT = "purchase"
#: Bins of a grid that are made from one row.
GRID = 1 << 16


def ordered(order: str, keys: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def bin_end(ts: Column, seconds: int) -> Column:
    """The number of the bin (t - s, t] that holds ts, counted from 1970; bins of whole days' parts start at midnight."""
    return F.ceil(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def resample_mean(events: DataFrame, seconds: int = 3600, types: Sequence[str] = EVENT_TYPES, ts: str = "ts", kind: str = "event_type", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Means of each kind in right-closed bins labelled by their end, on a full grid from a series' first to its last bin.

    Columns: keys, h (number of the bin), rn (place from 0), one for each kind; empty bins are null. One shuffle by
    bin with map-side sums; the grid is dealt out in stretches of GRID bins.
    """
    means = events.groupBy(*keys, bin_end(F.col(ts), seconds).alias("h")).agg(*[F.avg(F.when(F.col(kind) == t, F.col(value))).alias(t) for t in types])
    ends = means.groupBy(*keys).agg(F.min("h").alias("a"), F.max("h").alias("b"))
    parts = ends.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / GRID).cast("long"))).alias("part"))
    grid = parts.select(*keys, "a", F.explode(F.sequence(F.col("a") + F.col("part") * GRID, F.least(F.col("b"), F.col("a") + F.col("part") * GRID + GRID - 1))).alias("h"))
    return grid.join(means, [*keys, "h"], "left").select(*keys, "h", *types, (F.col("h") - F.col("a")).cast("int").alias("rn"))


def first_of_duplicates(rows: DataFrame, ts: Sequence[str], tie: str) -> DataFrame:
    """One row for each value of the ts columns: that of the smallest tie."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*ts).orderBy(tie))).filter("_n = 1").drop("_n")


def forward_fill(df: DataFrame, columns: Sequence[str], limit: int = 6, order: str = "rn", keys: Sequence[str] = ()) -> DataFrame:
    """Nulls take the last value of at most `limit` rows before."""
    w = ordered(order, keys).rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})


def interpolate_linear(df: DataFrame, columns: Sequence[str], order: str = "rn", keys: Sequence[str] = ()) -> DataFrame:
    """Not causal: nulls on the line between the values around them; at the ends, the nearest value."""
    w = ordered(order, keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = df
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col(order))
        x0, x1, t0, t1 = F.last(c, True).over(back), F.first(c, True).over(ahead), F.last(at, True).over(back), F.first(at, True).over(ahead)
        line = x0 + (x1 - x0) * (F.col(order) - t0) / F.nullif(t1 - t0, F.lit(0))
        out = out.withColumn(f"_{c}", F.coalesce(F.col(c), line, x0, x1))
    return out.select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def range_flag(x: Column, low: float, high: float) -> Column:
    return F.coalesce((x < low) | (x > high), F.lit(False))


def step_flag(x: Column, most: float, w: WindowSpec) -> Column:
    return F.coalesce(F.abs(x - F.lag(x).over(w)) > most, F.lit(False))


def spike_flag(df: DataFrame, column: str, name: str, rows: int = 9, times: float = 6.0, least: int = 3, order: str = "rn", keys: Sequence[str] = ()) -> DataFrame:
    """Whether the value is more than `times` the rolling median deviation away from the rolling median, both over the last `rows` rows with `least` values."""
    w = ordered(order, keys).rowsBetween(1 - rows, 0)
    rolling = lambda c: F.when(F.count(c).over(w) >= least, F.percentile(c, F.lit(0.5)).over(w))
    df = df.withColumn("_m", rolling(column)).withColumn("_d", F.abs(F.col(column) - F.col("_m"))).withColumn("_s", rolling("_d"))
    return df.withColumn(name, F.coalesce((F.col("_s") > 0) & (F.col("_d") > times * F.col("_s")), F.lit(False))).drop("_m", "_d", "_s")


def anomaly_flags(df: DataFrame, bounds: dict[str, tuple[float, float, float]], order: str = "rn", keys: Sequence[str] = (), rows: int = 9, times: float = 6.0, least: int = 3) -> DataFrame:
    """A column <c>_bad for each column of bounds (low, high, greatest step): out of range, too large a step, or a spike as in spike_flag().

    All columns take each step together, so there are two windows however many columns there are.
    """
    w = ordered(order, keys)
    last = w.rowsBetween(1 - rows, 0)
    rolling = lambda c: F.when(F.count(c).over(last) >= least, F.percentile(c, F.lit(0.5)).over(last))
    df = df.withColumns({f"_m_{c}": rolling(c) for c in bounds})
    df = df.withColumns({f"_d_{c}": F.abs(F.col(c) - F.col(f"_m_{c}")) for c in bounds})
    df = df.withColumns({f"_s_{c}": rolling(f"_d_{c}") for c in bounds} | {f"_p_{c}": F.lag(c).over(w) for c in bounds})
    spike = lambda c: F.coalesce((F.col(f"_s_{c}") > 0) & (F.col(f"_d_{c}") > times * F.col(f"_s_{c}")), F.lit(False))
    step = lambda c, most: F.coalesce(F.abs(F.col(c) - F.col(f"_p_{c}")) > most, F.lit(False))
    df = df.withColumns({f"{c}_bad": range_flag(F.col(c), low, high) | step(c, most) | spike(c) for c, (low, high, most) in bounds.items()})
    return df.drop(*[f"_{x}_{c}" for x in "mdsp" for c in bounds])


def repair(df: DataFrame, bounds: dict[str, tuple[float, float, float]], inputs: Sequence[str], limit: int = 6, order: str = "rn", keys: Sequence[str] = ()) -> DataFrame:
    """Flagged values become null; inputs are filled forward before and after, outputs never."""
    filled = forward_fill(df, inputs, limit, order, keys)
    flagged = anomaly_flags(filled, bounds, order, keys)
    flagged = flagged.withColumns({c: F.when(~F.col(f"{c}_bad"), F.col(c)) for c in bounds})
    return forward_fill(flagged, inputs, limit, order, keys)


def hampel(df: DataFrame, column: str, name: str, half: int = 6, times: float = 3.0, order: str = "rn", keys: Sequence[str] = ()) -> DataFrame:
    """Not causal: values further than `times` scaled median deviations from the median of the rows around become that median."""
    w = ordered(order, keys).rowsBetween(-half, half)
    df = df.withColumn("_m", F.percentile(column, F.lit(0.5)).over(w)).withColumn("_l", F.collect_list(column).over(w))
    # deviations are from this row's own median, so they are taken within the collected frame of 2 * half + 1 values
    away = F.array_sort(F.transform("_l", lambda v: F.abs(v - F.col("_m"))))
    df = df.withColumn("_a", away).withColumn("_n", F.size("_a"))
    mad = F.expr("(element_at(_a, cast((_n + 1) div 2 as int)) + element_at(_a, cast(_n div 2 + 1 as int))) / 2")
    df = df.withColumn("_s", F.when(F.col("_n") > 0, mad) * 1.4826)
    return df.withColumn(name, F.when(F.abs(F.col(column) - F.col("_m")) > times * F.col("_s"), F.col("_m")).otherwise(F.col(column))).drop("_m", "_l", "_a", "_n", "_s")


def segments(df: DataFrame, step: int, order: str, keys: Sequence[str] = (), name: str = "segment") -> DataFrame:
    """Numbers maximal runs of rows whose order grows by exactly step."""
    w = ordered(order, keys)
    new = F.when(F.col(order) - F.lag(order).over(w) == step, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def lagged(column: str, k: int, order: str = "rn", keys: Sequence[str] = ("segment",)) -> Column:
    """The value k rows before in the same segment."""
    return F.lag(column, k).over(ordered(order, keys)) if k else F.col(column)


def feature_lags(order: int, delay: int | None) -> list[int]:
    """Lags of an autoregressive term (delay None) or of an input: strictly past rows, never the current one."""
    start = 1 if delay is None else max(1, delay)
    return [start + i for i in range(order)]


def history_mask(df: DataFrame, columns: Sequence[str], guard: int, name: str, order: str = "rn", keys: Sequence[str] = ("segment",)) -> DataFrame:
    """Whether this row and the guard rows before it in its segment have all the columns."""
    whole = F.when(F.lit(True) if not columns else sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0, 1).otherwise(0)
    w = ordered(order, keys).rowsBetween(-guard, 0)
    return df.withColumn("_w", whole).withColumn(name, (F.sum("_w").over(w) == guard + 1)).drop("_w")


def time_split(df: DataFrame, fractions: tuple[float, float] = (0.6, 0.2), order: str = "rn", keys: Sequence[str] = (), name: str = "part") -> DataFrame:
    """train, validation and test by count of rows in time order; frozen before anything else looks at the values."""
    n, place = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(ordered(order, keys)) - 1
    a, b = F.floor(n * fractions[0]), F.floor(n * (fractions[0] + fractions[1]))
    return df.withColumn("_p", place).withColumn("_a", a).withColumn("_b", b).withColumn(name, F.when(F.col("_p") < F.col("_a"), "train").when(F.col("_p") < F.col("_b"), "validation").otherwise("test")).drop("_p", "_a", "_b")


def guard_rows(max_lag: int, validation: Column, test: Column) -> Column:
    return F.greatest(F.lit(4), F.least(F.lit(2 * max_lag + 3), F.floor(F.least(validation, test) / 3)))


def asof_backward(left: DataFrame, right: DataFrame, ts: str, values: Sequence[str], tolerance: int, keys: Sequence[str] = ()) -> DataFrame:
    """left with the last row of right at or before ts, if it is at most tolerance seconds old, and age in minutes.

    Time is cut into blocks as long as the tolerance; a row of right goes to its own block and the next, so all that a
    row of left may take is in its block. Within a block both sides are put in one order and the last value is carried:
    one shuffle, linear, and no block is longer than the tolerance, whether there are keys or not.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    block = F.floor(micros / F.lit(tolerance * 1_000_000)).cast("long")
    a = left.withColumn("_block", block).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(ts, *values)).schema[0].dataType))
    b = right.select(*keys, ts, F.explode(F.array(block, block + 1)).alias("_block"), F.lit(0).alias("_side"), F.struct(ts, *values).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_block").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_l", F.last("_v", True).over(w)).filter("_side = 1")
    age = (micros - F.unix_micros(F.col("_l").getField(ts).cast("timestamp"))) / 1e6
    fresh = age <= tolerance
    return out.select(*left.columns, *[F.when(fresh, F.col("_l").getField(v)).alias(v) for v in values], F.when(fresh, age / 60).alias("age_minutes"))


def in_blocks(df: DataFrame, order: str, block: int, before: int, transform: Callable[[DataFrame, Sequence[str]], DataFrame]) -> DataFrame:
    """transform() of one long series, dealt into blocks of consecutive rows that each bring the `before` rows before them along.

    order must number the rows from 0 without gaps. A causal transform that looks back `before` rows at most gives the
    same rows as on the whole series, but a block is a task of its own. transform gets the keys to partition by.
    """
    own = F.floor(F.col(order) / block)
    shared = F.floor((F.col(order) + before) / block)
    dealt = df.withColumn("_block", F.explode(F.sequence(own, shared)))
    done = transform(dealt, ["_block"])
    return done.filter(F.floor(F.col(order) / block) == F.col("_block")).drop("_block")
