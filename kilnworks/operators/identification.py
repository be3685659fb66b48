"""Linear identification: fits from aggregates, evaluation, forecasts, simulation and responses."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.operators import series
from kilnworks.sources.files import scratch_dir


def lag_names(order: int, delays: dict[str, int], output: str) -> list[tuple[str, str, int]]:
    """(name, column, lag) of every feature: the output's past, then each input's from its delay on; all strictly past."""
    out = [(f"{output}_{k}", output, k) for k in series.feature_lags(order, None)]
    return out + [(f"{c}_{k}", c, k) for c, delay in delays.items() for k in series.feature_lags(order, delay)]


def feature_frame(df: DataFrame, features: Sequence[tuple[str, str, int]], order: str, keys: Sequence[str] = ("segment",)) -> DataFrame:
    return df.withColumns({name: series.lagged(c, k, order, keys) for name, c, k in features})


def gram(df: DataFrame, features: Sequence[str], output: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and covariances of complete rows' features and output: one aggregate, (p + 1)^2 / 2 numbers to the driver.

    Centred in the aggregate, so its condition is that of the standardised columns, not of raw squares.
    """
    names = [*features, output]
    whole = df.select(*names).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = whole.agg(F.count(F.lit(1)), *[F.avg(c) for c in names], *[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    means = np.array([x if x is not None else np.nan for x in row[1 : 1 + len(names)]], float)
    cov = np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, row[1 + len(names) :]):
        cov[i, j] = cov[j, i] = value if value is not None else np.nan
    return int(row[0]), means, cov


def solve(n: int, means: np.ndarray, cov: np.ndarray, alpha: float = 0.0) -> np.ndarray | None:
    """Intercept and coefficients of ridge regression on standardised features; without alpha the least-norm solution. None with too few rows."""
    p = len(means) - 1
    if n < max(20, 2 * (p + 1)):
        return None
    scale = np.sqrt(np.diag(cov)[:p])
    scale = np.where(scale == 0, 1.0, scale)
    z, zy = cov[:p, :p] / np.outer(scale, scale) * n, cov[:p, p] / scale * n
    beta = np.linalg.pinv(z, hermitian=True) @ zy if alpha == 0 else np.linalg.solve(z + alpha * np.eye(p), zy)
    beta = beta / scale
    return np.concatenate([[means[p] - beta @ means[:p]], beta])


def prediction(coefficients: Sequence[float], features: Sequence[str]) -> Column:
    out = F.lit(float(coefficients[0]))
    for c, name in zip(coefficients[1:], features):
        out = out + float(c) * F.col(name)
    return out


def is_stable(output_coefficients: Sequence[float]) -> bool:
    """Whether all poles of an autoregressive polynomial lie within the unit circle."""
    roots = np.roots([1.0, *[-float(a) for a in output_coefficients]])
    return bool((np.abs(roots) < 1).all())


def ten_steps(df: DataFrame, intercept: float, a: Sequence[float], output: str, steps: int, order: str, keys: Sequence[str] = ("segment",), drive: Column | None = None) -> Column:
    """The forecast of each row's output made `steps` rows before from what was measured then: the recursion is written out as columns.

    drive is added to every step; it stands for inputs that are known, and is lagged with the step.
    """
    p = len(a)
    w = series.ordered(order, keys)
    past = [F.lag(output, steps + i).over(w) for i in range(p)]
    for step in range(steps):
        extra = F.lit(0.0) if drive is None else (F.lag(drive, steps - 1 - step).over(w) if steps - 1 - step else drive)
        new = F.lit(float(intercept)) + extra
        for i in range(p):
            new = new + float(a[i]) * past[i]
        past = [new, *past[: p - 1]]
    return past[0]


def common_targets(df: DataFrame, output: str, inputs: Sequence[str], guard: int, order: str, keys: Sequence[str] = ("segment",), name: str = "common") -> DataFrame:
    """name: whether a row is a target on which every candidate is judged, whatever its order and delays.

    The row is `guard` rows into its segment at least, its output and the three before it are measured, and so are all
    inputs in it and the guard rows before it.
    """
    w = series.ordered(order, keys)
    df = series.history_mask(df, inputs, guard, "_whole", order, keys)
    measured = F.col(output).isNotNull()
    for k in (1, 2, 3):
        measured = measured & F.lag(output, k).over(w).isNotNull()
    return df.withColumn(name, F.coalesce((F.row_number().over(w) - 1 >= guard) & measured & F.col("_whole"), F.lit(False))).drop("_whole")


def target_check(order: str) -> Column:
    """What two candidates share if they were judged on the same targets: their number, and two sums of 60 bits of each target's SHA-256."""
    digest = F.sha2(F.col(order).cast("string"), 256)
    total = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", F.count(order).cast("string"), total(1), total(16))


def free_simulation(
    df: DataFrame, intercept: float, a: Sequence[float], drive: Sequence[tuple[str, int, float]], output: str, guard: int, order: str,
    keys: Sequence[str] = ("segment",), limit: float = 1e12,
) -> DataFrame:
    """keys, order, simulated and diverged of the rows from where each segment's simulation starts.

    a: coefficients of the output's past; drive: (input, lag, coefficient) of the others. It starts on the first row
    after the guard whose whole history was measured, takes the measured output from before that row alone, and is fed
    with itself from there on, never started again: a missing input leaves nulls to the segment's end. diverged: null,
    or not below the limit. A segment is gone through once, in order, by one task.
    """
    p, w = len(a), series.ordered(order, keys)
    push = F.lit(float(intercept))
    for name, lag, c in drive:
        push = push + float(c) * F.lag(name, lag).over(w)
    past = [F.lag(output, i + 1).over(w).cast("double").alias(f"_y{i}") for i in range(p)]
    rows = df.select(*keys, order, push.alias("_push"), *past, (F.row_number().over(w) - 1).alias("_age"))
    names = [f"_y{i}" for i in range(p)]

    def run(segment: pd.DataFrame) -> pd.DataFrame:
        segment = segment.sort_values(order)
        ready = (segment["_age"] >= guard) & segment[["_push", *names]].notna().all(axis=1)
        first = int(np.argmax(ready.to_numpy())) if ready.any() else len(segment)
        used = segment.iloc[first:]
        out, state = np.empty(len(used)), used[names].to_numpy()[0] if len(used) else np.zeros(p)
        with np.errstate(over="ignore", invalid="ignore"):
            for i, x in enumerate(used["_push"].to_numpy()):
                out[i] = x + np.dot(a, state) if p else x
                state = np.concatenate([[out[i]], state[: p - 1]]) if p else state
        return pd.DataFrame({**{c: used[c].to_numpy() for c in (*keys, order)}, "simulated": out})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, order)), "simulated double"])
    found = rows.groupBy(*keys).applyInPandas(run, schema)
    known = F.when(~F.isnan("simulated") & (F.abs("simulated") < float("inf")), F.col("simulated"))
    return found.withColumn("simulated", known).withColumn("diverged", F.coalesce(F.abs("simulated") >= limit, F.lit(True)))


#: One row for each input of a model: its name, delay in samples, the coefficients of its lags from the delay on, and those of the output's past.
CHANNELS = "input string, delay int, b array<double>, a array<double>"


def responses(channels: DataFrame, samples: int = 120) -> DataFrame:
    """channels with k, impulse, step of each of the first `samples` samples, and dc_gain: the deviation that an impulse or a step of one input makes.

    Other inputs stay where they are and the intercept plays no part. dc_gain is null where the model has a pole at 1.
    """
    fold = lambda push: f"""aggregate(sequence(0, {samples - 1}), cast(array() as array<double>), (y, k) -> concat(y, array(
      aggregate(transform(a, (c, i) -> c * coalesce(get(y, k - 1 - i), 0D)), 0D, (s, x) -> s + x) + {push})))"""  # noqa: E731
    impulse = fold("coalesce(get(b, k - delay), 0D)")
    step = fold("aggregate(transform(b, (c, l) -> if(k >= delay + l, c, 0D)), 0D, (s, x) -> s + x)")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rest = 1 - total("a")
    made = channels.withColumn("dc_gain", F.when(F.abs(rest) > 1e-12, total("b") / rest)).withColumn("z", F.arrays_zip(F.expr(impulse).alias("i"), F.expr(step).alias("s")))
    out = made.select(*channels.columns, "dc_gain", F.posexplode("z").alias("k", "z"))
    return out.select(*channels.columns, "dc_gain", "k", F.col("z").getField("i").alias("impulse"), F.col("z").getField("s").alias("step"))


def frequency_responses(channels: DataFrame, seconds: float, points: int = 96) -> DataFrame:
    """channels with k, hz, magnitude_db and phase (degrees) on a grid from 0 to half the sampling rate; null where the model has a pole."""
    grid = channels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("w", F.col("k") * (np.pi / (points - 1)))
    wave = lambda c, f, first: F.aggregate(F.transform(c, lambda x, i: x * f(F.col("w") * (i + first))), F.lit(0.0), lambda s, x: s + x)
    grid = grid.withColumns({"rn": wave("b", F.cos, F.col("delay")), "im_n": -wave("b", F.sin, F.col("delay")), "rd": 1 - wave("a", F.cos, F.lit(1)), "im_d": wave("a", F.sin, F.lit(1))})
    size = F.col("rd") * F.col("rd") + F.col("im_d") * F.col("im_d")
    grid = grid.withColumn("re", (F.col("rn") * F.col("rd") + F.col("im_n") * F.col("im_d")) / size).withColumn("im", (F.col("im_n") * F.col("rd") - F.col("rn") * F.col("im_d")) / size)
    ok = size > 1e-24
    db = 20 * F.log10(F.greatest(F.hypot("re", "im"), F.lit(1e-12)))
    return grid.select(*channels.columns, "k", (F.col("w") / (2 * np.pi * seconds)).alias("hz"), F.when(ok, db).alias("magnitude_db"), F.when(ok, F.degrees(F.atan2("im", "re"))).alias("phase"))


def search(df: DataFrame, output: str, delays: dict[str, int], orders: Sequence[int], alphas: Sequence[float], order: str, part: str = "part", keys: Sequence[str] = ("segment",)) -> list[dict]:
    """Every structure, order and alpha, fitted on train rows and judged on the same validation rows by BIC.

    Unstable ones are not eligible, nor those whose free simulation of the validation rows runs away or ends.

    The frame with the lags of the highest order is written once; one aggregate gives all covariances and one all
    candidates' errors, so the number of Spark jobs does not grow with the candidates.
    """
    most = max(orders)
    features = lag_names(most, delays, output)
    names = [n for n, _, _ in features]
    path = f"{scratch_dir(df.sparkSession)}/lags-{uuid.uuid4().hex}"
    feature_frame(df, features, order, keys).dropna(subset=[*names, output]).select(*dict.fromkeys([*keys, order, part, *names, output])).write.parquet(path)
    frame = df.sparkSession.read.parquet(path)
    n, means, cov = gram(frame.filter(F.col(part) == "train"), names, output)
    found = []
    for p in orders:
        for family, inputs in (("AR", {}), ("ARX", delays)):
            chosen = [x for x, _, _ in lag_names(p, inputs, output)]
            at = [names.index(x) for x in chosen] + [len(names)]
            for alpha in alphas:
                fit = solve(n, means[at], cov[np.ix_(at, at)], alpha)
                if fit is not None:
                    found.append({"family": family, "order": p, "alpha": float(alpha), "features": chosen, "coefficients": fit, "stable": is_stable(fit[1 : 1 + p])})
    if not found:
        return []
    errors = [F.avg((F.col(output) - prediction(c["coefficients"], c["features"])) ** 2) for c in found]
    row = frame.filter(F.col(part) == "validation").agg(F.count(F.lit(1)), *errors).first()
    for c, mse in zip(found, row[1:]):
        c["mse"] = mse
        c["bic"] = float(row[0] * np.log(mse) + len(c["coefficients"]) * np.log(row[0])) if mse else None
    validation = frame.filter(F.col(part) == "validation")
    best = None
    for c in sorted((c for c in found if c["stable"] and c["bic"] is not None), key=lambda c: c["bic"]):
        p, drive = c["order"], [(column, lag, float(b)) for (name, column, lag), b in zip(lag_names(c["order"], delays if c["family"] == "ARX" else {}, output)[c["order"] :], c["coefficients"][1 + c["order"] :])]
        simulated = free_simulation(df.filter(F.col(part) == "validation"), c["coefficients"][0], [float(a) for a in c["coefficients"][1 : 1 + p]], drive, output, max(lag for _, _, lag in features), order, keys)
        c["simulates"] = simulated.filter("diverged").join(validation.select(*keys, order), [*keys, order], "left_semi").isEmpty()
        if c["simulates"]:  # the first that holds is the best; most often one simulation is run
            best = c
            break
    for c in found:
        c["winner"] = c is best
    return found
