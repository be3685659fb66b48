"""Null-safe numeric expressions: undefined results are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over pairs without nulls; null where either side is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def improvement_percent(baseline: Column, value: Column) -> Column:
    """How much value is below a positive baseline, in percent."""
    return F.when(baseline > 0, 100 * (baseline - value) / baseline)
