"""Slow context from daily bars: trends, dispersion and breakouts over the last days."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import arrays as a
from tickloom.functions import fold
from tickloom.functions.scalar import EPS, log_price
from tickloom.operators.grid import on_grid, resample
from tickloom.plans.tables import BARS_D, bars_d
from tickloom.store import settle


def daily_grid(bars: DataFrame) -> DataFrame:
    """Daily bars on a calendar without gaps; a day without bars has no prices and no volume."""
    return on_grid(resample(bars, "1 day"), "1 day").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def with_history(daily: DataFrame, breakout: int = 20) -> DataFrame:
    """Moving averages over 50 and 200 rows, the breakout range, log returns, and places from the end."""
    w = Window.partitionBy("symbol").orderBy("ts")
    back = lambda n: w.rowsBetween(1 - n, 0)
    return daily.withColumns({
        "ma50": F.avg("close").over(back(50)), "ma200": F.avg("close").over(back(200)), "hi": F.max("close").over(back(breakout)), "lo": F.min("close").over(back(breakout)),
        "r": log_price(F.col("close")) - log_price(F.lag("close").over(w)), "from_end": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))),
        "first_r": F.row_number().over(w) == 1,
    })


def regime_window(history: DataFrame, days: int, suffix: str) -> DataFrame:
    """Metrics of each symbol's last ``days`` rows. One aggregation; the smoothed ranges fold its bars."""
    x = history.where(F.col("from_end") <= days)
    # the first row of the window has no return inside it
    r = F.when(F.col("from_end") < F.least(F.lit(days), F.col("rows")), F.col("r"))
    x = x.withColumn("rows", F.max("from_end").over(Window.partitionBy("symbol")))
    yes = lambda c: F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))
    at = lambda c, f: f(c, "ts")
    sound = lambda *cs: F.bool_and(reduce(lambda p, q: p & q, [F.col(c).isNotNull() & (F.col(c) > 0) for c in cs]))
    bar = F.struct("ts", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))
    g = x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), at("close", F.max_by).alias("last"), at("close", F.min_by).alias("first"), F.stddev_samp(r).alias("rv"), F.stddev_samp(F.abs(r)).alias("vv"), F.count(r).alias("nr"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"),
        F.var_pop(r).alias("m2"), at("ma50", F.min_by).alias("a50"), at("ma50", F.max_by).alias("z50"), at("ma200", F.min_by).alias("a200"), at("ma200", F.max_by).alias("z200"), yes(F.col("close") > F.col("ma50")).alias("above"),
        F.max("high").alias("top"), F.min("low").alias("bottom"), yes(F.col("close") >= F.col("hi")).alias("bh"), yes(F.col("close") <= F.col("lo")).alias("bl"), sound("high", "low").alias("hl_ok"), sound("open", "close").alias("oc_ok"),
        F.avg(F.log(F.col("high") / F.col("low")) ** 2).alias("hl2"), F.avg(F.log(F.col("close") / F.col("open")) ** 2).alias("oc2"), F.sort_array(F.collect_list(bar)).alias("b"),
    )
    slope = lambda p, q: F.when(F.col("n") > 1, (F.col(q) - F.col(p)) / (F.abs(p) + EPS))
    moments = lambda c: F.when((F.col("nr") >= 3) & (F.col("m2") != 0), F.col(c))
    closes = F.transform("b", lambda v: v["c"])
    band = a.tail(closes, 20)
    g = g.withColumns({"atr_": fold.atr(F.col("b")), "adx_": fold.adx(F.col("b")), "width": 4 * F.when((F.size(band) == a.count(band)), a.deviation(band)).otherwise(a.deviation(closes))})
    out: dict[str, Column] = {
        f"roc_{suffix}": F.try_divide(F.col("last") - F.col("first"), F.when(F.col("first") != 0, F.col("first"))) * 100,
        f"rv_close_{suffix}_mag": F.col("rv"), f"vol_of_vol_{suffix}_mag": F.col("vv"), f"ret_skew_{suffix}_dir": moments("skew"), f"ret_kurtosis_{suffix}_mag": moments("kurt"),
        f"ma50_slope_{suffix}_dir": slope("a50", "z50"), f"ma200_slope_{suffix}_dir": slope("a200", "z200"), f"ma50_minus_ma200_{suffix}_dir": (F.col("z50") - F.col("z200")) / (F.abs("z200") + EPS),
        f"above_ma50_share_{suffix}_pos": F.col("above"), f"adx_{suffix}_mag": F.col("adx_"), f"atr_{suffix}_mag": F.col("atr_"),
        f"parkinson_vol_{suffix}_mag": F.when(F.col("hl_ok"), F.sqrt(F.col("hl2") / (4 * F.log(F.lit(2.0))))),
        f"garman_klass_{suffix}_mag": F.when(F.col("oc_ok"), F.sqrt(F.greatest(0.5 * F.col("hl2") - (2 * F.log(F.lit(2.0)) - 1) * F.col("oc2"), F.lit(0.0)))),
        f"squeeze_index_{suffix}_mag": F.col("width") / (4 * F.col("atr_") + EPS), f"range_intensity_{suffix}_mag": (F.col("top") - F.col("bottom")) / (F.abs("last") + EPS),
        f"breakout_hi_share_{suffix}_pos": F.col("bh"), f"breakout_lo_share_{suffix}_pos": F.col("bl"),
    }
    there = lambda *stems: reduce(lambda p, q: p | q, [x.isNotNull() for n, x in out.items() if n.startswith(stems)])
    flags = {"volatility": there("rv_close", "vol_of_vol"), "trend": there("ma50_", "ma200_", "adx"), "range": there("range_intensity"), "breakout": there("breakout")}
    return g.select("symbol", *[x.alias(n) for n, x in out.items()], *[x.alias(f"metrics_valid_{n}_{suffix}") for n, x in flags.items()])


def regime_snapshot(bars: DataFrame, asof: Column, windows: Sequence[int] = (3, 7, 14, 30, 90), breakout: int = 20, filter_asof: bool = True) -> DataFrame:
    """One wide row for each symbol as of a time; bars after it do not count unless ``filter_asof`` is off."""
    # read once for each window
    history = settle(with_history(daily_grid(bars.where(F.col("ts") <= asof) if filter_asof else bars), breakout), "daily-history")
    parts = [regime_window(history, n, f"{n}d") for n in windows]
    return reduce(lambda p, q: p.join(q, "symbol", "full"), parts).withColumn("timestamp_asof_utc", asof)


def regime_series(bars: DataFrame, days: int, suffix: str) -> DataFrame:
    """The same metrics for each epoch-aligned bucket of days, from its own rows only."""
    daily = daily_grid(bars).withColumn("bucket", F.window("ts", f"{days} days")["start"])
    keyed = daily.withColumn("symbol", F.to_json(F.struct("symbol", "bucket")))
    out = regime_window(with_history(keyed), days, suffix)
    key = F.from_json("symbol", "symbol string, bucket timestamp_ntz")
    return out.withColumn("__k", key).select("__k.symbol", F.col("__k.bucket").alias("window_start"), *[c for c in out.columns if c != "symbol"])


PLAIN = ("roc_{s}", "rv_close_{s}_mag", "vol_of_vol_{s}_mag", "ret_skew_{s}_dir", "ret_kurtosis_{s}_mag", "ma50_slope_{s}_dir", "ma200_slope_{s}_dir", "ma50_minus_ma200_{s}_dir", "above_ma50_share_{s}_pos", "parkinson_vol_{s}_mag", "garman_klass_{s}_mag", "range_intensity_{s}_mag", "breakout_hi_share_{s}_pos", "breakout_lo_share_{s}_pos")


def q_regime_daily(spark, d):
    r = regime_snapshot(bars_d(spark, d), F.lit("2000-06-30").cast("timestamp_ntz"), (30, 90))
    return r.select("symbol", *[F.round(n.format(s=s), 5).alias(n.format(s=s)) for s in ("30d", "90d") for n in PLAIN])


def q_regime_full(spark, d):
    r = regime_snapshot(bars_d(spark, d), F.lit("2000-06-30").cast("timestamp_ntz"))
    return r.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in r.schema])


def q_regime_series(spark, d):
    return regime_series(bars_d(spark, d), 30, "30d").select("symbol", "window_start", F.round("roc_30d", 5).alias("roc_30d"), F.round("rv_close_30d_mag", 5).alias("rv_close_30d_mag"), F.round("ma50_slope_30d_dir", 5).alias("ma50_slope_30d_dir"), F.round("range_intensity_30d_mag", 5).alias("range_intensity_30d_mag"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_HIST = BARS_D + """,
    old AS (SELECT * FROM bars WHERE ts <= TIMESTAMP '{asof}'),
    days AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM old GROUP BY 1),
    grid AS (SELECT days.symbol, days.ts, open AS o, high AS h, low AS l, close AS c FROM days LEFT JOIN old ON old.symbol = days.symbol AND old.ts = days.ts)"""


def _window_sql(n: int, key: str = "symbol") -> str:
    """CTE m{n} with the metrics of the last n rows of each key of hist."""
    s = f"{n}d"
    return f"""e{n} AS (SELECT *, CASE WHEN i > min(i) OVER (PARTITION BY {key}) THEN r0 END AS r, min(i) OVER (PARTITION BY {key}) AS mi FROM hist WHERE from_end <= {n}),
    z{n} AS (SELECT *, avg(r) OVER p AS mr FROM e{n} WINDOW p AS (PARTITION BY {key})),
    m{n} AS (SELECT {key}, (max(c) FILTER (from_end = 1) - max(c) FILTER (i = mi)) / max(c) FILTER (i = mi) * 100 AS roc_{s}, stddev_samp(r) AS rv_close_{s}_mag, stddev_samp(abs(r)) AS vol_of_vol_{s}_mag,
        CASE WHEN count(r) >= 3 THEN avg((r - mr) ** 3) / pow(avg((r - mr) ** 2), 1.5) END AS ret_skew_{s}_dir, CASE WHEN count(r) >= 3 THEN avg((r - mr) ** 4) / pow(avg((r - mr) ** 2), 2) - 3 END AS ret_kurtosis_{s}_mag,
        CASE WHEN count(*) > 1 THEN (max(ma50) FILTER (from_end = 1) - max(ma50) FILTER (i = mi)) / (abs(max(ma50) FILTER (i = mi)) + 1e-9) END AS ma50_slope_{s}_dir, CASE WHEN count(*) > 1 THEN (max(ma200) FILTER (from_end = 1) - max(ma200) FILTER (i = mi)) / (abs(max(ma200) FILTER (i = mi)) + 1e-9) END AS ma200_slope_{s}_dir,
        (max(ma50) FILTER (from_end = 1) - max(ma200) FILTER (from_end = 1)) / (abs(max(ma200) FILTER (from_end = 1)) + 1e-9) AS ma50_minus_ma200_{s}_dir, count(*) FILTER (c > ma50) / count(*) AS above_ma50_share_{s}_pos,
        CASE WHEN bool_and(coalesce(h > 0 AND l > 0, false)) THEN sqrt(avg(ln(h / l) ** 2) / (4 * ln(2))) END AS parkinson_vol_{s}_mag,
        CASE WHEN bool_and(coalesce(o > 0 AND c > 0, false)) THEN sqrt(greatest(0.5 * avg(ln(h / l) ** 2) - (2 * ln(2) - 1) * avg(ln(c / o) ** 2), 0)) END AS garman_klass_{s}_mag,
        (max(h) - min(l)) / (abs(max(c) FILTER (from_end = 1)) + 1e-9) AS range_intensity_{s}_mag, count(*) FILTER (c >= hi) / count(*) AS breakout_hi_share_{s}_pos, count(*) FILTER (c <= lo) / count(*) AS breakout_lo_share_{s}_pos FROM z{n} GROUP BY {key})"""


def _hist_sql(part: str) -> str:
    return f"""hist AS (SELECT *, avg(c) OVER (w ROWS 49 PRECEDING) AS ma50, avg(c) OVER (w ROWS 199 PRECEDING) AS ma200, max(c) OVER (w ROWS 19 PRECEDING) AS hi, min(c) OVER (w ROWS 19 PRECEDING) AS lo,
        CASE WHEN c IS NOT NULL AND lag(c) OVER w IS NOT NULL THEN ln(greatest(c, 1e-9)) - ln(greatest(lag(c) OVER w, 1e-9)) END AS r0, row_number() OVER w AS i, row_number() OVER (PARTITION BY {part} ORDER BY ts DESC) AS from_end FROM grid2 WINDOW w AS (PARTITION BY {part} ORDER BY ts))"""


SQL = {
    "regime_daily": f"""WITH {_HIST.replace('{asof}', '2000-06-30')}, grid2 AS (SELECT * FROM grid), {_hist_sql('symbol')}, {_window_sql(30)}, {_window_sql(90)}
        SELECT symbol, {', '.join(f'round({n.format(s=s)}, 5) AS {n.format(s=s)}' for s in ('30d', '90d') for n in PLAIN)} FROM m30 JOIN m90 USING (symbol)""",
    "regime_series": f"""WITH {_HIST.replace('{asof}', '2999-01-01')}, grid2 AS (SELECT *, time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS ws FROM grid), {_hist_sql('symbol, ws')}, {_window_sql(30, 'symbol, ws')}
        SELECT symbol, ws AS window_start, round(roc_30d, 5) AS roc_30d, round(rv_close_30d_mag, 5) AS rv_close_30d_mag, round(ma50_slope_30d_dir, 5) AS ma50_slope_30d_dir, round(range_intensity_30d_mag, 5) AS range_intensity_30d_mag FROM m30""",
}
