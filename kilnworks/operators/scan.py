"""Running values over one long series, in two levels.

A window without keys puts a series into one task. Here the order's values are cut into blocks of `width`; a block is a
task of its own and leaves one row of totals, the table of blocks is scanned in order, and what came before each block
is joined back to its rows. The table of blocks is shorter than the series by the number of rows in a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order that make a block.
WIDTH = 1 << 16


def _blocks(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / width).cast("long"))


def _within(order: str, keys: Sequence[str]):
    return Window.partitionBy(*keys, "_block").orderBy(order)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _joined(rows: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what came before their block; keys may be null."""
    names = [*keys, "_block"]
    right = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], *[c for c in blocks.columns if c not in names])
    same = F.lit(True)
    for i, k in enumerate(names):
        same = same & rows[k].eqNullSafe(right[f"_k{i}"])
    return rows.join(right, same).drop(*[f"_k{i}" for i in range(len(names))])


def row_numbers(df: DataFrame, order: str, keys: Sequence[str] = (), name: str = "place", total: str | None = None, width: int = WIDTH) -> DataFrame:
    """`name`: a row's place in its series from 0 on, and `total`, if named, the series' number of rows. Rows of equal order follow each other in any order."""
    rows = _blocks(df, order, width)
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({"_ahead": F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    made = _joined(rows.withColumn("_at", F.row_number().over(_within(order, keys)) - 1), counts.drop("_n"), keys)
    out = {name: (F.col("_at") + F.col("_ahead")).cast("long")} | ({total: F.col("_all").cast("long")} if total else {})
    return made.withColumns(out).drop("_block", "_at", "_ahead", "_all")


def segments(df: DataFrame, step: int, order: str, keys: Sequence[str] = (), name: str = "segment", age: str | None = None, width: int = WIDTH) -> DataFrame:
    """`name`: the number, from 1 on, of each maximal run of rows whose order grows by exactly step; `age`, if named, rows since the run began.

    Between blocks goes a state: the last order, the number of runs so far, and the rows of the run that is not over.
    """
    rows = _blocks(df, order, width)
    w = _within(order, keys)
    previous = F.lag(order).over(w)
    # the first row of a block opens a run or not; that is decided when the block before it is known
    rows = rows.withColumns({"_new": F.when(previous.isNull(), 0).when(F.col(order) - previous == step, 0).otherwise(1), "_at": F.row_number().over(w) - 1})
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_runs": F.sum("_new").over(running), "_start": F.max(F.when(F.col("_new") == 1, F.col("_at"))).over(running)})
    blocks = rows.groupBy(*keys, "_block").agg(F.min(order).alias("_first"), F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n"), F.max("_runs").alias("_inner"), F.max("_start").alias("_tail"))
    b = Window.partitionBy(*keys).orderBy("_block")
    opens = F.when(F.col("_first") - F.lag("_last").over(b) == step, 0).otherwise(1)
    blocks = blocks.withColumn("_opens", opens)
    ahead = F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0))
    blocks = blocks.withColumns({"_ahead": ahead, "_before": F.coalesce(F.sum(F.col("_inner") + F.col("_opens")).over(_before(keys)), F.lit(0)) + F.col("_opens")})
    # where the run began that reaches into a block: at its own first row, or where the last run of an earlier block began
    began = F.coalesce(F.col("_ahead") + F.col("_tail"), F.when(F.col("_opens") == 1, F.col("_ahead")))
    blocks = blocks.withColumn("_begun", began)
    reaching = F.when(F.col("_opens") == 1, F.col("_ahead")).otherwise(F.last("_begun", True).over(_before(keys)))
    blocks = blocks.withColumn("_reaching", reaching).select(*keys, "_block", "_before", "_ahead", "_reaching")
    made = _joined(rows, blocks, keys)
    out = {name: (F.col("_before") + F.col("_runs")).cast("long")}
    if age:
        out[age] = (F.col("_ahead") + F.col("_at") - F.coalesce(F.col("_ahead") + F.col("_start"), F.col("_reaching"))).cast("long")
    return made.withColumns(out).drop("_block", "_new", "_at", "_runs", "_start", "_before", "_ahead", "_reaching")


def running_max(df: DataFrame, value: Column, order: str, keys: Sequence[str] = (), name: str = "best", width: int = WIDTH) -> DataFrame:
    """`name`: the greatest value up to each row. Rows of equal order see each other."""
    rows = _blocks(df, order, width).withColumn("_at", value)
    blocks = rows.groupBy(*keys, "_block").agg(F.max("_at").alias("_top"))
    blocks = blocks.withColumn("_ahead", F.max("_top").over(_before(keys))).drop("_top")
    here = F.max("_at").over(_within(order, keys).rangeBetween(Window.unboundedPreceding, 0))
    return _joined(rows.withColumn("_here", here), blocks, keys).withColumn(name, F.greatest("_here", "_ahead")).drop("_block", "_at", "_here", "_ahead")


def time_split(df: DataFrame, fractions: tuple[float, float] = (0.6, 0.2), order: str = "rn", keys: Sequence[str] = (), name: str = "part", width: int = WIDTH) -> DataFrame:
    """train, validation and test by count of rows in time order; frozen before anything else looks at the values."""
    rows = row_numbers(df, order, keys, "_p", "_total", width)
    a, b = F.floor(F.col("_total") * fractions[0]), F.floor(F.col("_total") * (fractions[0] + fractions[1]))
    return rows.withColumn(name, F.when(F.col("_p") < a, "train").when(F.col("_p") < b, "validation").otherwise("test")).drop("_p", "_total")
