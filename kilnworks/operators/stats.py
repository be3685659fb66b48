"""Statistics of frames: profiles, correlations, delays, collinearity, metrics and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from kilnworks.functions.numeric import correlation


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, columns, duplicate rows, missing cells and constant columns, from one pass and one distinct count."""
    whole = F.struct(*columns)
    a = df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(columns)).cast("long").alias("n_columns"), F.count_distinct(whole).alias("_d"), sum((F.sum(F.col(c).isNull().cast("long")) for c in columns), F.lit(0)).alias("n_missing"), *[F.min(c).eqNullSafe(F.max(c)).cast("long").alias(f"_c{i}") for i, c in enumerate(columns)])
    return a.select("n_rows", "n_columns", (F.col("n_rows") - F.col("_d")).alias("n_duplicates"), F.col("n_missing").cast("long").alias("n_missing"), sum((F.col(f"_c{i}") for i in range(len(columns))), F.lit(0)).cast("long").alias("n_constant"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, corr for every pair of columns, all from one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def _lag_sums(rows: pa.Table, keys: Sequence[str], inputs: Sequence[str], output: str, order: str, lags: np.ndarray, block: int, centre: dict[str, tuple[float, float]], schema: pa.Schema) -> pa.Table:
    """Sums over the pairs of one block: the output in the block's own rows, each input `lag` rows before. Nulls are masked, so counts are sums too."""
    place = rows[order].to_numpy()
    place, own = place - place.min(), place // block == rows["_block"][0].as_py()
    size = 1 << int(place.max() + np.abs(lags).max() + 1).bit_length()

    def spectra(column: str, some: np.ndarray | None = None) -> list[np.ndarray]:
        mean, scale = centre[column]
        x = (rows[column].cast(pa.float64()).to_numpy(zero_copy_only=False) - mean) / scale
        known = np.isfinite(x) if some is None else np.isfinite(x) & some
        out = np.zeros((3, size))
        for row, values in zip(out, (known, np.where(known, x, 0), np.where(known, x * x, 0))):
            row[place] = values
        return list(np.fft.rfft(out))

    one_y, y, yy = spectra(output, own)
    wanted = {f.name: [] for f in schema}
    for c in inputs:
        one_x, x, xx = (np.conj(f) for f in spectra(c))
        n, sx, sy, sxx, syy, sxy = np.fft.irfft([one_y * one_x, one_y * x, y * one_x, one_y * xx, yy * one_x, y * x], size)[:, lags]
        n = np.rint(n)
        for name, values in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), (n, *(np.where(n > 0, s, 0.0) for s in (sx, sy, sxx, syy, sxy)))):
            wanted[name].append(values)
        wanted["input"] += [c] * len(lags)
        wanted["lag"].append(lags)
    for k in keys:
        wanted[k] = pa.array([rows[k][0].as_py()] * (len(lags) * len(inputs)), schema.field(k).type)
    return pa.table({k: np.concatenate(v) if isinstance(v, list) and isinstance(v[0], np.ndarray) else v for k, v in wanted.items()}, schema)


def lag_correlations(df: DataFrame, inputs: Sequence[str], output: str, lags: Sequence[int], order: str, keys: Sequence[str] = (), least: int = 20, groups: Sequence[str] = (), block: int = 1 << 14) -> DataFrame:
    """groups, input, lag, corr, pairs: of the output and the input `lag` rows before (after, for negative ones).

    Pairs lie within one series of `keys` and `groups`; series of one group are taken together. order numbers the rows of
    a series, a missing number is a row of nulls. corr is null with fewer than `least` pairs or where a side is constant.

    Series are dealt into blocks of rows that bring the rows within reach of the lags along. A block's sums over all lags
    come from Fourier transforms, once for each input, and are added up, so lags times inputs are rows and no task holds
    more than a block. One more pass takes the columns' means, about which the sums are formed.
    """
    lags = np.array(sorted(set(lags)), np.int64)
    names = list(dict.fromkeys([*inputs, output]))
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double"))
    row = df.agg(*[F.avg(finite(c)) for c in names], *[F.stddev_pop(finite(c)) for c in names]).first()
    centre = {c: (row[i] or 0.0, row[len(names) + i] or 1.0) for i, c in enumerate(names)}
    by = list(dict.fromkeys([*groups, *keys]))
    at = F.col(order).cast("long")
    reach = F.sequence(F.floor((at + F.lit(int(min(0, lags[0])))) / block).cast("long"), F.floor((at + F.lit(int(max(0, lags[-1])))) / block).cast("long"))
    dealt = df.select(*by, at.alias(order), *[F.col(c).cast("double").alias(c) for c in names], F.explode(reach).alias("_block"))
    schema = StructType([*(dealt.schema[g] for g in groups), StructField("input", StringType()), StructField("lag", LongType()), *(StructField(c, DoubleType()) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))])
    arrow = to_arrow_schema(schema)

    def sums(rows: pa.Table) -> pa.Table:
        return _lag_sums(rows, groups, inputs, output, order, lags, block, centre, arrow)

    parts = dealt.groupBy(*by, "_block").applyInArrow(sums, schema)
    total = parts.groupBy(*groups, "input", "lag").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    spread = lambda s, ss: F.col("n") * F.col(ss) - F.col(s) * F.col(s)
    differs = lambda s, ss: (spread(s, ss) > 1e-12 * F.col("n") * F.col("n")) & (spread(s, ss) > 1e-10 * F.col("n") * F.col(ss))
    corr = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    defined = (F.col("n") >= least) & differs("sx", "sxx") & differs("sy", "syy")
    return total.select(*groups, "input", F.col("lag").cast("int").alias("lag"), F.when(defined, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))).alias("corr"), F.col("n").cast("long").alias("pairs"))


def best_lags(found: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """For each input the lag of the largest absolute correlation, the smallest on ties, and whether it is the last that was tried."""
    # nine places: sums in another order make no difference
    size = F.round(F.abs("corr"), 9)
    best = F.max(F.struct(size.alias("s"), (-F.abs("lag")).alias("l"), F.col("lag"), F.col("corr"), F.col("pairs")))
    return found.filter("corr is not null").groupBy(*groups, "input").agg(best.alias("b"), F.max(F.abs("lag")).alias("most")).select(*groups, "input", F.col("b.lag").alias("delay"), F.col("b.corr").alias("corr"), F.abs("b.corr").alias("abs_corr"), F.col("b.pairs").alias("overlap"), (F.abs("b.lag") == F.col("most")).alias("boundary_hit"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Of complete rows, on the driver: len(columns) squared numbers from one aggregate."""
    whole = df.select(*columns).dropna()
    pairs = list(combinations(range(len(columns)), 2))
    row = whole.agg(*[correlation(F.col(columns[i]), F.col(columns[j])).alias(f"_{n}") for n, (i, j) in enumerate(pairs)]).first()
    out = np.eye(len(columns))
    for n, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = row[n] if row[n] is not None else 0.0
    return out


def vif(corr: np.ndarray) -> np.ndarray:
    """Variance inflation factors, the diagonal of the inverse correlation matrix, between 1 and 1e6."""
    return np.clip(np.diag(np.linalg.pinv(corr, hermitian=True)), 1.0, 1e6)


def recommend(corr: np.ndarray, target: np.ndarray, names: Sequence[str], strong: float = 0.9, most: float = 10.0) -> list[tuple[str, bool, str]]:
    """(name, kept, reason): of each strongly correlated pair the one that says less about the target goes, then whatever has the largest factor until all are below `most`."""
    kept, why = list(range(len(names))), {}
    pairs = sorted(((abs(corr[i, j]), i, j) for i, j in combinations(kept, 2) if abs(corr[i, j]) >= strong), key=lambda x: (-x[0], x[1:]))
    for _, i, j in pairs:
        if i in kept and j in kept:
            weak = i if (abs(target[i]), names[j]) < (abs(target[j]), names[i]) else j
            kept.remove(weak)
            why[weak] = "correlated"
    while len(kept) > 1:
        factors = vif(corr[np.ix_(kept, kept)])
        worst = int(np.argmax(factors))
        if factors[worst] < most:
            break
        why[kept.pop(worst)] = "collinear"
    return [(n, i in kept, why.get(i, "kept")) for i, n in enumerate(names)]


def regression_metrics(y: Column, p: Column, parameters: int) -> dict[str, Column]:
    """Aggregates over pairs: sse, mse, rmse, mae, r2, adj_r2, fpe, aic and bic; undefined ones are null."""
    both = y.isNotNull() & p.isNotNull()
    e, t = F.when(both, y - p), F.when(both, y)
    n, sse, total = F.count(e), F.sum(e * e), F.count(t) * F.var_pop(t)
    r2 = 1 - sse / F.nullif(total, F.lit(0.0))
    log = F.ln(F.nullif(sse / n, F.lit(0.0)))
    k = parameters
    return {
        "n": n, "sse": sse, "mse": sse / n, "rmse": F.sqrt(sse / n), "mae": F.avg(F.abs(e)), "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / F.nullif(n - k - 1, F.lit(0)),
        "fpe": sse / n * (n + k) / F.nullif(n - k, F.lit(0)), "aic": n * log + 2 * k, "bic": n * log + k * F.ln(n),
    }


def correlated_groups(corr: np.ndarray, names: Sequence[str], strong: float = 0.9) -> list[list[str]]:
    """Groups of names that strongly correlated pairs connect, by union-find; names and groups in the order given, single ones left out."""
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in combinations(range(len(names)), 2):
        if abs(corr[i, j]) >= strong:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    groups: dict[int, list[str]] = {}
    for i, name in enumerate(names):
        groups.setdefault(find(i), []).append(name)
    return [g for g in groups.values() if len(g) > 1]


def merge_groups(df: DataFrame, groups: Sequence[Sequence[str]], prefix: str = "merged") -> DataFrame:
    """df with a column <prefix>_1, <prefix>_2, ... for each group: the mean of its columns' z-scores, of those that are measured and not constant.

    Deviations are those of all rows (n, not n - 1). One aggregate for all columns, then one select.
    """
    columns = list(dict.fromkeys(c for g in groups for c in g))
    if not columns:
        return df
    row = df.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    z = {c: (F.col(c) - F.lit(row[i])) / F.lit(row[len(columns) + i]) if row[len(columns) + i] else F.lit(None).cast("double") for i, c in enumerate(columns)}
    total = lambda xs: sum(xs[1:], xs[0])
    mean = lambda g: total([F.coalesce(z[c], F.lit(0.0)) for c in g]) / F.nullif(total([z[c].isNotNull().cast("int") for c in g]), F.lit(0))
    return df.withColumns({f"{prefix}_{i + 1}": mean(g) for i, g in enumerate(groups)})
