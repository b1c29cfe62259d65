"""Scalar expressions. Missing is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EPS = 1e-9
INF = float("inf")


def safe_divide(a: Column, b: Column) -> Column:
    """NULL where the divisor is 0 or anything is missing."""
    return F.try_divide(a, b)


def change(now: Column, before: Column) -> Column:
    """Relative change; infinite from a base of 0, NULL for 0 after 0."""
    from_zero = F.when(now > 0, F.lit(INF)).when(now < 0, F.lit(-INF))
    return F.when(before == 0, from_zero).otherwise(now / F.when(before != 0, before) - 1)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def transform(x: Column, kind: str) -> Column:
    return {"positive": F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0)))), "signed": signed_log(x), "plain": x}[kind]


def log_price(x: Column) -> Column:
    """Natural logarithm with prices floored at EPS; NULL stays NULL."""
    return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(EPS))))


def ratio(a: Column, b: Column) -> Column:
    return a / (F.abs(b) + EPS)


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when((F.abs(x) < INF) & ~F.isnan(x), x)


def price_at(entry: Column, pct: Column) -> Column:
    return entry * (1 + pct / 100)


def amplitude_band(x: Column, small: float = 5.0, medium: float = 12.0) -> Column:
    return F.when(x.isNull(), "unknown").when(x < small, "small").when(x <= medium, "medium").otherwise("large")


def interpolate(x: Column, xs: list[Column], ys: list[float], low: float, high: float) -> Column:
    """Piecewise-linear interpolation over knots in ascending order of value; of equal knots the last counts.

    Below the first knot ``low``, above the last ``high``. No knot may be NULL."""
    out = F.lit(float(high))
    out = F.when(x == xs[-1], F.lit(float(ys[-1]))).otherwise(out)
    for i in range(len(xs) - 2, -1, -1):
        slope = (ys[i + 1] - ys[i]) / F.when(xs[i + 1] != xs[i], xs[i + 1] - xs[i])
        out = F.when((x >= xs[i]) & (x < xs[i + 1]), slope * (x - xs[i]) + ys[i]).otherwise(out)
    return F.when(x < xs[0], F.lit(float(low))).otherwise(out)


def register_sql(spark: SparkSession) -> None:
    """SQL functions of the same meaning for users of ``spark.sql``."""
    for text in (
        "tl_signed_log(x DOUBLE) RETURNS DOUBLE RETURN signum(x) * ln(1 + abs(x))",
        "tl_price_at(entry DOUBLE, pct DOUBLE) RETURNS DOUBLE RETURN entry * (1 + pct / 100)",
        "tl_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN a / (abs(b) + 1e-9)",
        "tl_amplitude_band(x DOUBLE) RETURNS STRING RETURN CASE WHEN x IS NULL THEN 'unknown' WHEN x < 5 THEN 'small' WHEN x <= 12 THEN 'medium' ELSE 'large' END",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
