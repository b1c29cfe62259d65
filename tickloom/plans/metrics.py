"""Indicators of windows of bars, and what is made of several windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import arrays as a
from tickloom.functions import fold
from tickloom.functions.fold import let
from tickloom.functions.scalar import EPS, ratio
from tickloom.operators.grid import floor_time, floor_to, resample
from tickloom.plans.tables import BARS_H, bars_h, table

#: Tag of each tagged metric (fixed values); others have none.
TAGS = {
    **dict.fromkeys(("quote_volume_sum", "rv_close", "parkinson_vol", "garman_klass", "yang_zhang", "squeeze_index", "range_intensity", "vwap_deviation_abs", "dist_to_window_high_abs", "dist_to_window_low_abs", "run_up_max", "run_dn_max"), "mag"),
    **dict.fromkeys(("up_volume_share", "down_volume_share", "vol_spike_share", "bb_position", "ret_share_pos", "vwap_pos_share"), "pos"),
    **dict.fromkeys(("dist_to_window_high", "dist_to_window_low"), "dir"),
}


@dataclass(frozen=True)
class Lookback:
    """Bars that the indicators look back."""

    rsi: int = 14
    fast: int = 12
    slow: int = 26
    signal: int = 9
    band: int = 20
    atr: int = 14

    @staticmethod
    def scaled(bars: int) -> Lookback:
        """In proportion to the bars of a window."""
        part = lambda x, least: max(least, round(bars / x))
        fast = part(6, 2)
        return Lookback(part(4, 2), fast, max(fast + 1, round(bars / 3)), part(4.5, 2), part(3, 5), part(4, 5))


def column_name(metric: str, window: str) -> str:
    return "_".join([metric, window, *([TAGS[metric]] if metric in TAGS else [])])


def collect_windows(bars: DataFrame, window: Column, every: str, bars_each: int, keys: Sequence[str] = ("symbol",), ts: str = "ts", coverage: float = 0.8) -> DataFrame:
    """One row for each window: its bars in order, with NULL for a missing one between the first and last.

    ``window_coverage`` is the share of ``bars_each`` that is there; ``window_ok`` whether it suffices.
    This is the only shuffle of the indicators; the arrays are as long as a window has bars."""
    bar = F.struct(F.col(ts).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    got = bars.groupBy(*keys, window.alias("window_start")).agg(F.sort_array(F.collect_list(bar)).alias("b"))
    return _with_gaps(got, [*keys, "window_start"], every, bars_each, coverage)


def _with_gaps(got: DataFrame, keys: Sequence[str], every: str, bars_each: int, coverage: float) -> DataFrame:
    times = F.sequence(F.col("b")[0]["t"], fold.last(F.col("b"))["t"], F.expr(f"INTERVAL {every}"))
    by_time = F.map_from_entries(F.transform("b", lambda x: F.struct(x["t"].alias("key"), x.alias("value"))))
    filled = let(by_time, lambda m: F.transform(times, lambda t: F.try_element_at(m, t)))
    n = F.size("b")
    return got.select(*keys, (n / bars_each).alias("window_coverage"), (n >= max(1, int(bars_each * coverage))).alias("window_ok"), filled.alias("b"))


def dense_windows(bars: DataFrame, seconds: int, every: str, bars_each: int, coverage: float = 0.8) -> DataFrame:
    """Each bar's trailing window (t - seconds, t] in the shape of ``collect_windows``, stamped with ``ts``.

    Recursive metrics start anew in every window, so each needs its own bars: the work is bars times
    bars per window. Meant for short windows or resampled bars."""
    w = Window.partitionBy("symbol").orderBy("__s").rangeBetween(1 - seconds, 0)
    bar = F.struct(F.col("ts").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    got = bars.withColumn("__s", F.unix_seconds(F.col("ts").cast("timestamp"))).select("symbol", "ts", F.sort_array(F.collect_list(bar).over(w)).alias("b"))
    return _with_gaps(got, ["symbol", "ts"], every, bars_each, coverage)


def _field(name: str):
    return lambda x: x[name]


def indicators(windows: DataFrame, look: Lookback = Lookback(), keep_short: bool = False) -> DataFrame:
    """All metrics of each window. Windows of too few bars go, or with ``keep_short`` stay with NULL metrics."""
    keys = [c for c in windows.columns if c not in ("b", "window_coverage", "window_ok")]
    held = windows.where("window_ok").select(*keys, "window_coverage", "window_ok", "b", *[F.transform("b", _field(f)).alias(f) for f in "ohlc"], F.transform("b", lambda x: F.coalesce(x["v"], F.lit(0.0))).alias("v"))
    price = lambda x: F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(EPS))))
    c, h, l, o, v, b = (F.col(x) for x in "chlovb")  # noqa: E741
    held = held.withColumns({
        "r": fold.pairs(c, lambda x, p: price(x) - price(p)),
        "tp": F.transform(b, lambda x: (x["h"] + x["l"] + x["c"]) / 3),
        "n": F.size("b"),
        "whole": F.forall(b, lambda x: x.isNotNull() & (x["h"] > 0) & (x["l"] > 0) & (x["o"] > 0) & (x["c"] > 0)),
    })
    r, tp, n = F.col("r"), F.col("tp"), F.col("n")
    held = held.withColumns({
        "last": fold.last(c), "first": F.get(c, F.lit(0)), "close_mean": a.mean(c), "close_stddev": a.deviation(c), "close_min": F.array_min(c), "close_max": F.array_max(c),
        "volume_sum": a.total(v), "quote_volume_sum": a.total(F.transform(b, lambda x: x["c"] * x["v"])),
        "vwap": F.try_divide(a.total(F.transform(b, lambda x: (x["h"] + x["l"] + x["c"]) / 3 * x["v"])), F.when(a.total(v) != 0, a.total(v))),
        "top": F.array_max(h), "bottom": F.array_min(l), "macd_": fold.macd(c, look.fast, look.slow, look.signal), "atr": fold.atr(b, look.atr), "rsi": fold.rsi(c, look.rsi), "adx": fold.adx(b),
        "band": a.tail(c, look.band), "vol_med": a.median(v),
    })
    logs = lambda f: F.transform(b, f)
    square = lambda xs: a.mean(F.transform(xs, lambda x: x * x))
    hl2 = square(logs(lambda x: F.log(x["h"] / x["l"])))
    oc2 = square(logs(lambda x: F.log(x["c"] / x["o"])))
    steps = lambda num, den: fold.pairs(b, lambda x, p: F.log(x[num] / p[den]))
    k = 0.34 / (1.34 + (n + 1) / F.when(n > 1, n - 1))
    rs = hl2 - square(steps("o", "c")) - oc2
    yz = F.coalesce(a.variance(steps("o", "o")), F.lit(0.0)) + k * F.coalesce(a.variance(steps("c", "c")), F.lit(0.0)) + (1 - k) * F.greatest(rs, F.lit(0.0))
    full = (F.size("band") >= look.band) & (a.count(F.col("band")) == F.size("band"))
    mu, sigma = F.when(full, a.mean(F.col("band"))).otherwise(F.col("close_mean")), F.when(full, a.deviation(F.col("band"))).otherwise(F.col("close_stddev"))

    def stochastic(back: int) -> Column:
        """%K of the bar so many before the last: its place in the range of the 14 bars up to it."""
        part = F.slice(b, F.greatest(n - 13 - back, F.lit(1)), 14)
        low, high = F.array_min(F.transform(part, lambda x: x["l"])), F.array_max(F.transform(part, lambda x: x["h"]))
        there = (n - back >= 14) & F.forall(part, lambda x: x.isNotNull())
        return F.when(there, F.try_divide(F.get(c, n - 1 - back) - low, F.when(high != low, high - low)) * 100)

    def cci(m: Column) -> Column:
        away = a.mean(F.transform(tp, lambda x: F.abs(x - m)))
        return F.try_divide(fold.last(tp) - m, F.when(away != 0, 0.015 * away))

    up = F.zip_with(r, v, lambda x, y: F.when(x > 0, y))
    moves = F.zip_with(fold.pairs(c, lambda x, p: x - p), v, lambda x, y: F.signum(F.coalesce(x, F.lit(0.0))) * y)
    last, vwap = F.col("last"), F.col("vwap")
    held = held.withColumns({
        "sma": F.col("close_mean"), "price_deviation_vwap": F.try_divide(last - vwap, F.when(vwap != 0, vwap)),
        "roc": F.try_divide(last - F.col("first"), F.when(F.col("first") != 0, F.col("first"))) * 100, "returns_log": a.total(r),
        "ema_fast": F.col("macd_.ema_fast"), "ema_slow": F.col("macd_.ema_slow"), "macd": F.col("macd_.macd"), "macd_signal": F.col("macd_.signal"), "macd_histogram": F.col("macd_.histogram"),
        "bollinger_upper": mu + 2 * sigma, "bollinger_lower": mu - 2 * sigma, "bollinger_width": (mu + 2 * sigma) - (mu - 2 * sigma),
        "stochastic_k": stochastic(0), "stochastic_d": a.mean(F.array(stochastic(0), stochastic(1), stochastic(2))), "obv": a.total(moves), "cci": let(a.mean(tp), cci),
        "rv_close": a.deviation(r), "parkinson_vol": F.when(F.col("whole"), F.sqrt(hl2 / (4 * F.log(F.lit(2.0))))),
        "garman_klass": F.when(F.col("whole"), F.sqrt(F.greatest(0.5 * hl2 - (2 * F.log(F.lit(2.0)) - 1) * oc2, F.lit(0.0)))),
        "yang_zhang": F.when(F.col("whole") & (n > 1), F.sqrt(F.greatest(yz, F.lit(0.0)))),
        "range_intensity": F.try_divide(F.col("top") - F.col("bottom"), vwap + EPS),
        "dist_to_window_high": F.try_divide(last - F.col("close_max"), F.col("atr") + EPS), "dist_to_window_low": F.try_divide(last - F.col("close_min"), F.col("atr") + EPS),
        "up_volume_share": F.try_divide(a.total(up), F.when(F.col("volume_sum") != 0, F.col("volume_sum"))),
        "vol_spike_share": let(F.col("vol_med") + 3 * 1.4826 * let(F.col("vol_med"), lambda m: a.median(F.transform(v, lambda x: F.abs(x - m)))), lambda t: a.share(v, lambda x: x > t)),
        "ret_share_pos": a.share(r, lambda x: x > 0), "run_up_max": a.streak(r, lambda x: x > 0), "run_dn_max": a.streak(r, lambda x: x < 0),
        "vwap_pos_share": let(vwap, lambda m: F.when(m.isNotNull(), a.share(c, lambda x: x > m))),
    })
    position = F.try_divide(last - F.col("bollinger_lower"), F.col("bollinger_width") + EPS)
    held = held.withColumns({
        "vwap_deviation_abs": F.abs("price_deviation_vwap"), "bb_position": F.when(position.isNotNull(), F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0))),
        "squeeze_index": F.try_divide(F.col("bollinger_width"), 4 * F.col("atr") + EPS), "down_volume_share": 1 - F.col("up_volume_share"),
        "dist_to_window_high_abs": F.abs("dist_to_window_high"), "dist_to_window_low_abs": F.abs("dist_to_window_low"),
    })
    out = held.withColumns({f"metrics_valid_{name}": test for name, test in _validity().items()}).select(*keys, "window_coverage", "window_ok", *METRICS, *FLAGS)
    if not keep_short:
        return out
    short = windows.where("NOT window_ok").select(*keys, "window_coverage", "window_ok", *[F.lit(False).alias(f) for f in FLAGS])
    return out.unionByName(short, allowMissingColumns=True)


def _validity() -> dict[str, Column]:
    there = lambda *names: [F.col(n).isNotNull() for n in names]
    some, every = (lambda *x: reduce(lambda p, q: p | q, there(*x))), (lambda *x: reduce(lambda p, q: p & q, there(*x)))
    return {
        "volume": some("quote_volume_sum", "up_volume_share", "down_volume_share"), "volatility": some("rv_close", "parkinson_vol", "garman_klass", "yang_zhang"), "vwap": every("vwap", "price_deviation_vwap"),
        "bbands": every("bollinger_upper", "bollinger_lower", "bollinger_width"), "trend": every("adx"), "range": some("range_intensity", "dist_to_window_high", "dist_to_window_low"), "momentum": some("roc", "ret_share_pos", "run_up_max", "run_dn_max"),
    }


METRICS = (
    "close_mean close_stddev close_min close_max volume_sum vwap price_deviation_vwap roc returns_log sma ema_fast ema_slow macd macd_signal macd_histogram bollinger_upper bollinger_lower bollinger_width rsi atr "
    "stochastic_k stochastic_d obv cci adx quote_volume_sum up_volume_share down_volume_share vol_spike_share rv_close parkinson_vol garman_klass yang_zhang squeeze_index range_intensity vwap_deviation_abs bb_position "
    "dist_to_window_high dist_to_window_low dist_to_window_high_abs dist_to_window_low_abs ret_share_pos run_up_max run_dn_max vwap_pos_share"
).split()
FLAGS = [f"metrics_valid_{x}" for x in ("volume", "volatility", "vwap", "bbands", "trend", "range", "momentum")]


def metrics_series(bars: DataFrame, hours: int, every: str = "1 hour", bar_hours: float = 1.0, look: Lookback = Lookback()) -> DataFrame:
    """Metrics of left-closed epoch-aligned windows, stamped with their end."""
    w = collect_windows(bars, floor_time(F.col("ts"), f"{hours} hours"), every, round(hours / bar_hours))
    return indicators(w, look).withColumn("window", F.lit(f"{hours}h")).withColumn("window_end", F.col("window_start") + F.expr(f"INTERVAL {hours} HOURS"))


def metrics_snapshot(bars: DataFrame, sizes: Sequence[int], every: str = "1 hour", bar_hours: float = 1.0, fine: str | None = None) -> DataFrame:
    """One wide row for each symbol: per size the window (end - size, end] that ends at its last full bin,
    and the close at the earliest of those ends. ``fine`` resamples the bars of a window first."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("__max"))
    ends = last.select("symbol", *[floor_to("__max", s * 3600).alias(f"__e{s}") for s in sizes]).withColumn("timestamp_asof_utc", F.least(*[F.col(f"__e{s}") for s in sizes]) if len(sizes) > 1 else F.col(f"__e{sizes[0]}"))
    joined = bars.join(ends, "symbol")
    out = joined.groupBy("symbol", "timestamp_asof_utc").agg(F.max_by("close", F.when(F.col("ts") <= F.col("timestamp_asof_utc"), F.col("ts"))).alias("close_current"))
    for s in sizes:
        own = joined.where((F.col("ts") > F.col(f"__e{s}") - F.expr(f"INTERVAL {s} HOURS")) & (F.col("ts") <= F.col(f"__e{s}")))
        n = round(s / bar_hours)
        if fine:
            count = own.groupBy("symbol").agg((F.count(F.lit(1)) / n).alias("__cov"))
            w = collect_windows(resample(own, fine), F.lit(None).cast("timestamp_ntz"), fine, n).join(count, "symbol").withColumns({"window_coverage": F.col("__cov"), "window_ok": F.col("__cov") >= 0.8}).drop("__cov")
        else:
            w = collect_windows(own, F.lit(None).cast("timestamp_ntz"), every, n)
        m = indicators(w, keep_short=True)
        names = {x: column_name(x, f"{s}h") for x in METRICS} | {x: f"{x}_{s}h" for x in (*FLAGS, "window_coverage", "window_ok")}
        out = out.join(m.select("symbol", *[F.col(x).alias(y) for x, y in names.items()]), "symbol", "left")
    return out


def rollups(df: DataFrame, short: str = "1h", middle: str = "4h", long: str = "24h", signs: Sequence[str] = ("1h", "4h", "12h", "24h")) -> DataFrame:
    """Agreement of signs over windows, and ratios and differences between windows, each with ``_valid``.

    A value within 1e-9 of 0 has no sign; no sign at all leaves the agreement NULL."""
    made: dict[str, Column] = {}
    for base in ("macd_histogram", "roc", "price_deviation_vwap"):
        parts = [F.when(F.abs(f"{base}_{w}") >= EPS, F.signum(f"{base}_{w}")) for w in signs if f"{base}_{w}" in df.columns]
        some = F.coalesce(*parts).isNotNull()
        made[f"{base}_sign_agree_rollup"] = F.when(some, reduce(lambda p, q: p + q, [F.coalesce(x, F.lit(0.0)) for x in parts])).cast("bigint")
    for a_, b_ in ((short, middle), (middle, long)):
        made[f"rv_close_{a_}_over_{b_}_mag"] = ratio(F.col(f"rv_close_{a_}_mag"), F.col(f"rv_close_{b_}_mag"))
        made[f"adx_{a_}_minus_{b_}_mag"] = F.col(f"adx_{a_}") - F.col(f"adx_{b_}")
    made[f"roc_{middle}_over_{long}_dir"] = ratio(F.col(f"roc_{middle}"), F.col(f"roc_{long}"))
    out = df.withColumns(made)
    return out.withColumns({f"{n}_valid": F.col(n).isNotNull() for n in made})


def coverage_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key combination, averaged."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean_rows"), F.count(F.lit(1)).alias("groups"))


def null_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of missing cells among the columns."""
    missing = reduce(lambda p, q: p + q, [F.col(c).isNull().cast("int") for c in columns])
    return df.agg((F.sum(missing) / (F.count(F.lit(1)) * len(columns))).alias("null_rate"))


def _rounded(df: DataFrame, names: Sequence[str], digits: int = 5) -> DataFrame:
    return df.select("symbol", "window_start", *[F.round(n, digits).alias(n) for n in names])


BASIC = "window_coverage close_mean close_stddev close_min close_max sma volume_sum quote_volume_sum vwap price_deviation_vwap vwap_deviation_abs roc returns_log rv_close range_intensity up_volume_share down_volume_share ret_share_pos vwap_pos_share obv cci vol_spike_share parkinson_vol garman_klass yang_zhang run_up_max run_dn_max bollinger_upper bollinger_lower bollinger_width bb_position stochastic_k stochastic_d".split()


def q_metrics_basic(spark, d):
    return _rounded(metrics_series(bars_h(spark, d), 24), BASIC)


def q_metrics_fold(spark, d):
    return _rounded(metrics_series(bars_h(spark, d), 72), ["rsi", "atr", "adx", "macd", "macd_signal", "macd_histogram", "ema_fast", "ema_slow", "squeeze_index", "dist_to_window_high", "dist_to_window_low"])


def q_metrics_ema(spark, d):
    """The folds that SQL can follow step by step on short windows."""
    return _rounded(metrics_series(bars_h(spark, d), 24, look=Lookback(fast=3, slow=6, signal=4)), ["ema_fast", "ema_slow", "macd", "macd_signal", "macd_histogram"])


def q_metrics_snapshot(spark, d):
    out = metrics_snapshot(bars_h(spark, d), [6, 24, 72])
    return out.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in out.schema])


def q_snapshot_anchor(spark, d):
    return metrics_snapshot(bars_h(spark, d), [6, 24]).select("symbol", "timestamp_asof_utc", F.round("close_current", 6).alias("close_current"), F.round("roc_24h", 6).alias("roc_24h"), "window_ok_24h", F.round("window_coverage_6h", 6).alias("window_coverage_6h"))


def _wide(spark, d):
    p = table(spark, d, "part")
    x = lambda k, m: ((F.col("p_partkey") * k + F.col("p_size")) % m - m // 2) / 7.0
    cols = {f"{b}_{w}": F.when((F.col("p_partkey") + i) % 5 != 0, x(3 + i + j, 13)) for i, b in enumerate(("macd_histogram", "roc", "price_deviation_vwap")) for j, w in enumerate(("1h", "4h", "12h", "24h"))}
    cols |= {f"rv_close_{w}_mag": F.when(F.col("p_partkey") % (j + 6) != 0, x(5 + j, 17)) for j, w in enumerate(("1h", "4h", "24h"))}
    cols |= {f"adx_{w}": F.when(F.col("p_partkey") % (j + 7) != 0, x(9 + j, 19)) for j, w in enumerate(("1h", "4h", "24h"))}
    return p.select("p_partkey", *[c.alias(n) for n, c in cols.items()])


ROLLED = [f"{b}_sign_agree_rollup" for b in ("macd_histogram", "roc", "price_deviation_vwap")] + ["rv_close_1h_over_4h_mag", "rv_close_4h_over_24h_mag", "adx_1h_minus_4h_mag", "adx_4h_minus_24h_mag", "roc_4h_over_24h_dir"]


def q_metrics_dense(spark, d):
    m = indicators(dense_windows(bars_h(spark, d), 86_400, "1 hour", 24), keep_short=True)
    return m.select("symbol", "ts", F.round("window_coverage", 6).alias("window_coverage"), "window_ok", *[F.round(c, 5).alias(c) for c in ("close_mean", "close_stddev", "close_min", "close_max", "volume_sum")])


def q_rollups(spark, d):
    return rollups(_wide(spark, d)).select("p_partkey", *[F.round(c, 5).alias(c) if "rollup" not in c else F.col(c) for c in ROLLED], *[f"{c}_valid" for c in ROLLED])


def q_coverage_summary(spark, d):
    return coverage_summary(bars_h(spark, d).withColumn("day", F.date_trunc("day", "ts")), ["symbol", "day"]).select(F.round("mean_rows", 6).alias("mean_rows"), "groups")


def q_null_rate(spark, d):
    return null_rate(_wide(spark, d), ["roc_1h", "rv_close_1h_mag", "adx_24h"]).select(F.round("null_rate", 9).alias("null_rate"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_WINDOWS = BARS_H + """,
    b1 AS (SELECT *, time_bucket(INTERVAL 24 HOUR, ts, TIMESTAMP '1970-01-01') AS ws FROM bars),
    w AS (SELECT symbol, ws, min(ts) AS a, max(ts) AS z, count(*) AS got FROM b1 GROUP BY 1, 2 HAVING count(*) >= 19),
    t AS (SELECT symbol, ws, got, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM w),
    g AS (SELECT t.symbol, t.ws, got, t.ts, open AS o, high AS h, low AS l, close AS c, coalesce(volume, 0) AS v, (high + low + close) / 3 AS tp, row_number() OVER k AS i, count(*) OVER p AS n, lag(close) OVER k AS pc, lag(open) OVER k AS po
        FROM t LEFT JOIN bars b ON t.symbol = b.symbol AND t.ts = b.ts WINDOW k AS (PARTITION BY t.symbol, t.ws ORDER BY t.ts), p AS (PARTITION BY t.symbol, t.ws))"""
_BASIC = _WINDOWS + """,
    x AS (SELECT *, CASE WHEN c IS NOT NULL AND pc IS NOT NULL THEN ln(greatest(c, 1e-9)) - ln(greatest(pc, 1e-9)) END AS r, sum(tp * v) OVER p / nullif(sum(v) OVER p, 0) AS vwap, avg(tp) OVER p AS mtp, quantile_cont(v, 0.5) OVER p AS vmed,
        c IS NOT NULL AND h > 0 AND l > 0 AND o > 0 AND c > 0 AS sound,
        CASE WHEN count(h) OVER k14 = 14 THEN (c - min(l) OVER k14) / nullif(max(h) OVER k14 - min(l) OVER k14, 0) * 100 END AS k,
        CASE WHEN count(c) OVER k20 = 20 THEN avg(c) OVER k20 END AS mu20, CASE WHEN count(c) OVER k20 = 20 THEN stddev_samp(c) OVER k20 END AS sd20
        FROM g WINDOW p AS (PARTITION BY symbol, ws), k14 AS (PARTITION BY symbol, ws ORDER BY ts ROWS 13 PRECEDING), k20 AS (PARTITION BY symbol, ws ORDER BY ts ROWS 19 PRECEDING)),
    y AS (SELECT *, quantile_cont(abs(v - vmed), 0.5) OVER (PARTITION BY symbol, ws) AS vmad, sum(CASE WHEN r > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, ws ORDER BY ts) AS gu, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, ws ORDER BY ts) AS gd FROM x),
    su AS (SELECT symbol, ws, max(q) AS run_up_max FROM (SELECT symbol, ws, gu, count(*) FILTER (r > 0) AS q FROM y GROUP BY ALL) GROUP BY 1, 2),
    sd AS (SELECT symbol, ws, max(q) AS run_dn_max FROM (SELECT symbol, ws, gd, count(*) FILTER (r < 0) AS q FROM y GROUP BY ALL) GROUP BY 1, 2),
    m AS (SELECT symbol, ws, any_value(got) / 24 AS window_coverage, any_value(n) AS n, avg(c) AS close_mean, stddev_samp(c) AS close_stddev, min(c) AS close_min, max(c) AS close_max, sum(v) AS volume_sum, sum(c * v) AS quote_volume_sum, any_value(vwap) AS vwap,
        max_by(c, ts) AS last, min_by(c, ts) AS first, sum(r) AS returns_log, stddev_samp(r) AS rv_close, max(h) AS top, min(l) AS bottom, sum(v) FILTER (r > 0) AS upv, count(*) FILTER (r > 0) / count(*) AS ret_share_pos,
        count(*) FILTER (c > vwap) / count(*) AS vwap_pos_share, sum(sign(coalesce(c - pc, 0)) * v) AS obv, (max_by(tp, ts) - any_value(mtp)) / nullif(0.015 * avg(abs(tp - mtp)), 0) AS cci,
        count(*) FILTER (v > vmed + 3 * 1.4826 * vmad) / count(*) AS vol_spike_share, bool_and(sound) AS sound, avg(ln(h / l) ** 2) AS hl2, avg(ln(c / o) ** 2) AS oc2, avg(ln(o / pc) ** 2) AS co2, var_samp(ln(o / po)) AS so, var_samp(ln(c / pc)) AS sc,
        max(mu20) FILTER (i = n) AS mu20, max(sd20) FILTER (i = n) AS sd20, max(k) FILTER (i = n) AS stochastic_k, avg(k) FILTER (i >= n - 2) AS stochastic_d FROM y GROUP BY 1, 2),
    f AS (SELECT *, coalesce(mu20, close_mean) + 2 * coalesce(sd20, close_stddev) AS up, coalesce(mu20, close_mean) - 2 * coalesce(sd20, close_stddev) AS dn, 0.34::DOUBLE / (1.34::DOUBLE + (n + 1) / (n - 1)) AS k FROM m)"""
_FIELDS = {
    **{n: n for n in "window_coverage close_mean close_stddev close_min close_max volume_sum quote_volume_sum vwap returns_log rv_close ret_share_pos vwap_pos_share obv cci vol_spike_share run_up_max run_dn_max stochastic_k stochastic_d".split()},
    "sma": "close_mean", "price_deviation_vwap": "(last - vwap) / vwap", "vwap_deviation_abs": "abs((last - vwap) / vwap)", "roc": "(last - first) / first * 100", "range_intensity": "(top - bottom) / (vwap + 1e-9)",
    "up_volume_share": "coalesce(upv, 0) / volume_sum", "down_volume_share": "1 - coalesce(upv, 0) / volume_sum", "parkinson_vol": "CASE WHEN sound THEN sqrt(hl2 / (4 * ln(2))) END",
    "garman_klass": "CASE WHEN sound THEN sqrt(greatest(0.5 * hl2 - (2 * ln(2) - 1) * oc2, 0)) END",
    "yang_zhang": "CASE WHEN sound THEN sqrt(greatest(so + k * sc + (1 - k) * greatest(hl2 - co2 - oc2, 0), 0)) END",
    "bollinger_upper": "up", "bollinger_lower": "dn", "bollinger_width": "up - dn", "bb_position": "least(greatest((last - dn) / (up - dn + 1e-9), 0), 1)",
}


def _wide_sql() -> str:
    x = lambda k, m: f"((p_partkey * {k} + p_size) % {m} - {m // 2}) / 7.0::DOUBLE"
    cols = [f"CASE WHEN (p_partkey + {i}) % 5 <> 0 THEN {x(3 + i + j, 13)} END AS {b}_{w}" for i, b in enumerate(("macd_histogram", "roc", "price_deviation_vwap")) for j, w in enumerate(("1h", "4h", "12h", "24h"))]
    cols += [f"CASE WHEN p_partkey % {j + 6} <> 0 THEN {x(5 + j, 17)} END AS rv_close_{w}_mag" for j, w in enumerate(("1h", "4h", "24h"))]
    cols += [f"CASE WHEN p_partkey % {j + 7} <> 0 THEN {x(9 + j, 19)} END AS adx_{w}" for j, w in enumerate(("1h", "4h", "24h"))]
    return f"wide AS (SELECT p_partkey, {', '.join(cols)} FROM part)"


def _rollups_sql() -> str:
    made = {}
    for b in ("macd_histogram", "roc", "price_deviation_vwap"):
        signs = [f"CASE WHEN abs({b}_{w}) >= 1e-9 THEN sign({b}_{w}) END" for w in ("1h", "4h", "12h", "24h")]
        made[f"{b}_sign_agree_rollup"] = f"CASE WHEN coalesce({', '.join(signs)}) IS NOT NULL THEN CAST({' + '.join(f'coalesce({s}, 0)' for s in signs)} AS BIGINT) END"
    for a_, b_ in (("1h", "4h"), ("4h", "24h")):
        made[f"rv_close_{a_}_over_{b_}_mag"] = f"rv_close_{a_}_mag / (abs(rv_close_{b_}_mag) + 1e-9)"
        made[f"adx_{a_}_minus_{b_}_mag"] = f"adx_{a_} - adx_{b_}"
    made["roc_4h_over_24h_dir"] = "roc_4h / (abs(roc_24h) + 1e-9)"
    cols = [f"{e} AS {n}" if "rollup" in n else f"round({e}, 5) AS {n}" for n, e in made.items()] + [f"({e}) IS NOT NULL AS {n}_valid" for n, e in made.items()]
    return f"WITH {_wide_sql()} SELECT p_partkey, {', '.join(cols)} FROM wide"


SQL = {
    "metrics_basic": f"WITH {_BASIC} SELECT symbol, ws AS window_start, {', '.join(f'round({e}, 5) AS {n}' for n, e in _FIELDS.items())} FROM f JOIN su USING (symbol, ws) JOIN sd USING (symbol, ws)",
    "metrics_ema": f"""WITH RECURSIVE {_WINDOWS},
        e AS (SELECT symbol, ws, i, n, c AS f, c AS s, 1.0::DOUBLE AS wf, 1.0::DOUBLE AS wss, 0.0::DOUBLE AS g FROM g WHERE i = 1
            UNION ALL
            SELECT symbol, ws, i, n, f, s, wf, wss, 0.4::DOUBLE * (f - s) + 0.6::DOUBLE * pg FROM (
                SELECT g.symbol, g.ws, g.i, g.n,
                    CASE WHEN g.c IS NULL THEN e.f ELSE (e.wf * 0.5 * e.f + 0.5 * g.c) / (e.wf * 0.5 + 0.5) END AS f,
                    CASE WHEN g.c IS NULL THEN e.s ELSE (e.wss * (5.0::DOUBLE / 7) * e.s + (2.0::DOUBLE / 7) * g.c) / (e.wss * (5.0::DOUBLE / 7) + 2.0::DOUBLE / 7) END AS s,
                    CASE WHEN g.c IS NULL THEN e.wf * 0.5 ELSE 1 END AS wf, CASE WHEN g.c IS NULL THEN e.wss * (5.0::DOUBLE / 7) ELSE 1 END AS wss, e.g AS pg
                FROM e JOIN g ON g.symbol = e.symbol AND g.ws = e.ws AND g.i = e.i + 1))
        SELECT symbol, ws AS window_start, round(f, 5) AS ema_fast, round(s, 5) AS ema_slow, round(f - s, 5) AS macd, round(g, 5) AS macd_signal, round(f - s - g, 5) AS macd_histogram FROM e WHERE i = n""",
    "snapshot_anchor": f"""WITH {BARS_H}, e AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, max(ts), TIMESTAMP '1970-01-01') AS e6, time_bucket(INTERVAL 24 HOUR, max(ts), TIMESTAMP '1970-01-01') AS e24 FROM bars GROUP BY 1)
        SELECT symbol, least(any_value(e6), any_value(e24)) AS timestamp_asof_utc, round(max_by(close, ts) FILTER (ts <= least(e6, e24)), 6) AS close_current,
            CASE WHEN count(*) FILTER (ts > e24 - INTERVAL 24 HOUR AND ts <= e24) >= 19 THEN round((max_by(close, ts) FILTER (ts > e24 - INTERVAL 24 HOUR AND ts <= e24) / min_by(close, ts) FILTER (ts > e24 - INTERVAL 24 HOUR AND ts <= e24) - 1) * 100, 6) END AS roc_24h,
            count(*) FILTER (ts > e24 - INTERVAL 24 HOUR AND ts <= e24) >= 19 AS window_ok_24h, round(count(*) FILTER (ts > e6 - INTERVAL 6 HOUR AND ts <= e6) / 6, 6) AS window_coverage_6h
        FROM bars JOIN e USING (symbol) GROUP BY symbol""",
    "metrics_dense": f"""WITH {BARS_H}, r AS (SELECT symbol, ts, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s, min(close) OVER w AS lo, max(close) OVER w AS hi, sum(volume) OVER w AS v
            FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW))
        SELECT symbol, ts, round(n / 24, 6) AS window_coverage, n >= 19 AS window_ok, CASE WHEN n >= 19 THEN round(m, 5) END AS close_mean, CASE WHEN n >= 19 THEN round(s, 5) END AS close_stddev,
            CASE WHEN n >= 19 THEN round(lo, 5) END AS close_min, CASE WHEN n >= 19 THEN round(hi, 5) END AS close_max, CASE WHEN n >= 19 THEN round(v, 5) END AS volume_sum FROM r""",
    "rollups": _rollups_sql(),
    "coverage_summary": f"WITH {BARS_H}, n AS (SELECT count(*) AS n FROM bars GROUP BY symbol, date_trunc('day', ts)) SELECT round(avg(n), 6) AS mean_rows, count(*) AS groups FROM n",
    "null_rate": f"WITH {_wide_sql()} SELECT round(sum((roc_1h IS NULL)::INT + (rv_close_1h_mag IS NULL)::INT + (adx_24h IS NULL)::INT) / (count(*) * 3), 9) AS null_rate FROM wide",
}
