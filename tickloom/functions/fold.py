"""Recursive smoothing as folds over sorted arrays, and robust statistics.

Windows hold few bars once resampled, so arrays stay small and no Python runs. A fold's state is carried
NULL-aware: a missing value lets the old weight decay and emits the last level again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _null() -> Column:
    return F.lit(None).cast("double")


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once, however often and wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ewm_series(xs: Column, alpha: float, least: int = 1) -> Column:
    """Exponential means of an array, recursive from the first value; NULL until ``least`` values came.

    Weights: every step scales the old weight by 1 - alpha; a value enters with weight alpha, and the
    total is reset to 1."""
    start = F.struct(_null().alias("y"), F.lit(1.0).alias("w"), F.lit(0).alias("n"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        w = s["w"] * (1 - alpha)
        y = F.when(x.isNull(), s["y"]).when(s["y"].isNull(), x).otherwise((w * s["y"] + alpha * x) / (w + alpha))
        weight = F.when(x.isNull() & s["y"].isNotNull(), w).otherwise(F.lit(1.0))
        n = s["n"] + F.when(x.isNull(), 0).otherwise(1)
        return F.struct(y.alias("y"), weight.alias("w"), n.alias("n"), F.concat(s["out"], F.array(F.when(n >= least, y))).alias("out"))

    return F.aggregate(xs, start, step, lambda s: s["out"])


def ewm_last(xs: Column, alpha: float, least: int = 1) -> Column:
    """The last of ``ewm_series``, without keeping the others."""
    start = F.struct(_null().alias("y"), F.lit(1.0).alias("w"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        w = s["w"] * (1 - alpha)
        y = F.when(x.isNull(), s["y"]).when(s["y"].isNull(), x).otherwise((w * s["y"] + alpha * x) / (w + alpha))
        weight = F.when(x.isNull() & s["y"].isNotNull(), w).otherwise(F.lit(1.0))
        return F.struct(y.alias("y"), weight.alias("w"), (s["n"] + F.when(x.isNull(), 0).otherwise(1)).alias("n"))

    return F.aggregate(xs, start, step, lambda s: F.when(s["n"] >= least, s["y"]))


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def pairs(xs: Column, fn) -> Column:
    """``fn(x, previous)`` along an array; the first has a NULL previous."""
    return let(xs, lambda v: F.transform(v, lambda x, i: fn(x, F.when(i > 0, F.get(v, i - 1)))))


def rsi(close: Column, period: int = 14) -> Column:
    """Relative strength by Wilder's smoothing; NULL without losses or with too few bars."""
    move = pairs(close, lambda x, p: x - p)
    side = lambda sign: F.transform(move, lambda x: F.when(x.isNotNull(), F.greatest(sign * x, F.lit(0.0))))
    up, down = ewm_last(side(1), 1 / period, period), ewm_last(side(-1), 1 / period, period)
    value = let(F.struct(up.alias("u"), down.alias("d")), lambda s: 100 - 100 / (1 + F.try_divide(s["u"], F.when(s["d"] != 0, s["d"]))))
    return F.when(F.size(close) >= period + 1, value)


def true_ranges(bars: Column) -> Column:
    """Of bar structs (h, l, c): the widest of high - low and the distances to the close before, what is known of them."""
    return pairs(bars, lambda b, p: F.greatest(F.abs(b["h"] - b["l"]), F.abs(b["h"] - p["c"]), F.abs(b["l"] - p["c"])))


def atr(bars: Column, period: int = 14) -> Column:
    """Average true range by Wilder's smoothing over the known ranges; NULL under two bars."""
    return F.when(F.size(bars) >= 2, ewm_last(F.filter(true_ranges(bars), lambda x: x.isNotNull()), 1 / period, period))


def adx(bars: Column, period: int = 14) -> Column:
    """Average directional index: three smoothed series of moves and ranges, then one of their contrast."""
    a = 1 / period
    up = lambda b, p: b["h"] - p["h"]
    down = lambda b, p: p["l"] - b["l"]
    wins = lambda x, y: F.when((x > 0) & F.coalesce(x > y, F.lit(False)), x).otherwise(0.0)
    plus = ewm_series(pairs(bars, lambda b, p: wins(up(b, p), down(b, p))), a, period)
    minus = ewm_series(pairs(bars, lambda b, p: wins(down(b, p), up(b, p))), a, period)
    wide = ewm_series(true_ranges(bars), a, period)
    joined = F.arrays_zip(plus.alias("p"), minus.alias("m"), wide.alias("t"))

    def contrast(x: Column) -> Column:
        p, m = 100 * F.try_divide(x["p"], x["t"]), 100 * F.try_divide(x["m"], x["t"])
        return F.try_divide(100 * F.abs(p - m), p + m)

    return F.when(F.size(bars) >= period + 1, ewm_last(F.transform(joined, contrast), a, period))


def macd(close: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """Struct (ema_fast, ema_slow, macd, signal, histogram) of the last bar."""
    span = lambda n: 2 / (n + 1)
    both = F.struct(ewm_series(close, span(fast)).alias("f"), ewm_series(close, span(slow)).alias("s"))

    def out(e: Column) -> Column:
        line = F.zip_with(e["f"], e["s"], lambda f, s: f - s)
        return let(F.struct(last(line).alias("m"), ewm_last(line, span(signal)).alias("g")), lambda x: F.struct(last(e["f"]).alias("ema_fast"), last(e["s"]).alias("ema_slow"), x["m"].alias("macd"), x["g"].alias("signal"), (x["m"] - x["g"]).alias("histogram")))

    return let(both, out)


def mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median, mad, mad_scaled, mad_pct): median distance from the median, times 1.4826, and in percent of it."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("median"))
    out = df.join(middle, list(keys)).groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return out.withColumns({"mad_scaled": F.col("mad") * 1.4826, "mad_pct": F.try_divide(F.col("mad") * 1.4826, F.abs("median")) * 100})


def robust_scaled(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``{c}_scaled``: distance from the median in interquartile ranges (in units where the range is 0)."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = df.groupBy(*keys).agg(*[q(c).alias(f"__{c}") for c in columns])
    joined = df.join(stats, list(keys))
    width = lambda c: F.when(F.col(f"__{c}")[2] == F.col(f"__{c}")[0], 1.0).otherwise(F.col(f"__{c}")[2] - F.col(f"__{c}")[0])
    return joined.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"__{c}")[1]) / width(c) for c in columns}).drop(*[f"__{c}" for c in columns])
