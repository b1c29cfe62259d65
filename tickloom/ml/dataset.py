"""Learning tables: features of bars, labels, and splits over time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tickloom.operators.analytic import future_max, rank_pct, rolling, zscore
from tickloom.operators.joins import asof_backward, asof_with_gap



def by_symbol():
    """Rows of a symbol in order of time (a window needs a session, so it is made when asked for)."""
    return Window.partitionBy("symbol").orderBy("ts")

VALIDITY = ("volume", "volatility", "vwap", "bbands", "trend", "range", "momentum")


def attach_metrics(bars: DataFrame, series: DataFrame, windows: Sequence[str], bucket: int | None = None) -> DataFrame:
    """Bars with each window's latest metrics at or before their time. Of a wide series only the columns
    that name the window are taken, so windows never collide."""
    out = bars
    for w in windows:
        own = [c for c in series.columns if re.search(rf"_{w}(_|$)", c)]
        part = series.where(F.lower("window") == w).select("symbol", F.col("window_end").alias("__t"), *own)
        out = asof_backward(out, part, ["symbol"], "ts", "__t", "__m", bucket).select(*out.columns, *[F.col(f"__m.{c}").alias(c) for c in own])
    return out


def hygienic(df: DataFrame, windows: Iterable[str]) -> DataFrame:
    """Rows whose windows are all covered and valid; NULL rejects, absent flags do not."""
    flags = [c for w in windows for c in (f"window_ok_{w}", *(f"metrics_valid_{v}_{w}" for v in VALIDITY)) if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in flags], F.lit(True)))


def with_returns(bars: DataFrame) -> DataFrame:
    """``ret_1m``: log change from the symbol's row before, NULL unless both are positive."""
    log = lambda c: F.when(c > 0, F.log(c))
    return bars.withColumn("ret_1m", log(F.col("close")) - log(F.lag("close").over(by_symbol())))


def with_lags(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    return df.select("*", *[F.lag(c, i).over(by_symbol()).alias(f"{c}_lag{i}") for c in columns if c in df.columns for i in range(1, k + 1)])


def with_calendar(df: DataFrame, extended: bool = False) -> DataFrame:
    """Minute, hour and day of the week (Monday 0) in UTC; extended: day of the month and month."""
    more = {"day_of_month": F.dayofmonth("ts"), "month": F.month("ts")} if extended else {}
    return df.withColumns({"minute_of_hour": F.minute("ts"), "hour_of_day": F.hour("ts"), "day_of_week": F.weekday("ts"), **more})


def universe(df: DataFrame, liquidity: str, top: int | None = None, percentile: float | None = None) -> Column:
    """Whether a row is among its time's ``top`` by liquidity, or at or above its percentile; all rows without either."""
    at = Window.partitionBy("ts")
    if top is not None:
        return F.row_number().over(at.orderBy(F.desc_nulls_last(liquidity), "symbol")) <= top
    if percentile is not None:
        return F.col(liquidity) >= F.percentile(liquidity, F.lit(percentile / 100)).over(at)
    return F.lit(True)


def with_cross_section(df: DataFrame, columns: Sequence[str], inside: Column | None = None) -> DataFrame:
    """Percentile rank inside the universe and standardised value against it, at each time."""
    held = df.withColumn("in_universe", F.lit(True) if inside is None else inside)
    made = {}
    for c in columns:
        made[f"rank_{c}"] = rank_pct(F.when(F.col("in_universe"), F.col(c)), ["ts"])
        made[f"z_{c}"] = zscore(F.col(c), ["ts"], F.col("in_universe"))
    return held.withColumns(made)


def with_spreads(df: DataFrame, base: str, columns: Sequence[str] = ("close",), mode: str = "ffill", max_gap: int = 300, rows: int = 60, least: int = 30) -> DataFrame:
    """Differences to the base symbol's latest values, and the deviation of the change of the close spread."""
    own = [c for c in columns if c in df.columns]
    times = df.select("ts").distinct()
    reference = df.where(F.col("symbol") == base).select(F.col("ts").alias("__t"), *[F.col(c).alias(f"{c}_base") for c in own])
    matched = asof_with_gap(times, reference, "ts", "__t", max_gap, mode, "__m").select("ts", *[F.col(f"__m.{c}_base").alias(f"{c}_base") for c in own])
    out = df.join(matched, "ts", "inner" if mode == "drop" else "left").withColumns({f"spread_{c}": F.col(c) - F.col(f"{c}_base") for c in own})
    if mode == "drop":
        out = out.dropna(subset=[f"{c}_base" for c in own])
    step = out.withColumn("__d", F.col("spread_close") - F.lag("spread_close").over(by_symbol()))
    return step.withColumn("spread_vol_1h", rolling(F.stddev_samp, F.col("__d"), by_symbol(), rows, least)).drop("__d", *[f"{c}_base" for c in own])


def pick_features(columns: Sequence[str], include: str | None = None, exclude: str | None = None) -> list[str]:
    """Names that match ``include`` and not ``exclude``, sorted and distinct."""
    return sorted({c for c in columns if (not include or re.search(include, c)) and not (exclude and re.search(exclude, c))})


def preset_columns(df: DataFrame, preset: str, windows: Sequence[str], lags: int) -> list[str]:
    """min: lags, and RSI and ATR of the shortest window; max: every number but identifiers, open, high, low and hygiene."""
    lag_names = [c for c in df.columns if (m := re.search(r"_lag(\d+)$", c)) and int(m[1]) <= lags]
    if preset == "min":
        return lag_names + [c for c in df.columns if windows and re.fullmatch(rf"(rsi|atr)_{windows[0]}", c)]
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    skip = ("window_", "metrics_valid_")
    return [c for c in numbers if c not in ("open", "high", "low") and not c.startswith(skip) and (not re.search(r"_lag\d+$", c) or c in lag_names)]


@dataclass(frozen=True)
class DatasetSpec:
    windows: tuple[str, ...] = ()
    lags: int = 3
    preset: str = "max"
    include: str | None = None
    exclude: str | None = None
    calendar: bool = True
    extended_calendar: bool = False
    cross_section: tuple[str, ...] = ()
    rank_top: int | None = None
    liquidity_percentile: float | None = None
    liquidity: str = "volume"
    base_symbol: str | None = None
    base_missing: str = "ffill"
    base_max_gap: int = 300


def build_dataset(bars: DataFrame, spec: DatasetSpec, series: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The table of complete rows and its feature names; infinities count as missing."""
    df = bars
    if series is not None and spec.windows:
        df = hygienic(attach_metrics(df, series, spec.windows), spec.windows)
    df = with_returns(df)
    if spec.calendar:
        df = with_calendar(df, spec.extended_calendar)
    if spec.cross_section:
        df = with_cross_section(df, [c for c in spec.cross_section if c in df.columns], universe(df, spec.liquidity, spec.rank_top, spec.liquidity_percentile))
    if spec.base_symbol:
        df = with_spreads(df, spec.base_symbol, mode=spec.base_missing, max_gap=spec.base_max_gap)
    df = with_lags(df, ["close", "volume", "ret_1m"], spec.lags)
    features = pick_features(preset_columns(df, spec.preset, spec.windows, spec.lags), spec.include, spec.exclude)
    numbers = [c for c in features if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    df = df.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in numbers})
    return df.dropna(subset=features), features


def labels(task: str, horizon: int, bps: float = 5.0, classes: int = 3, compat: bool = False) -> Column:
    """price, return, direction or vol of the next ``horizon`` rows.

    A direction without a future row is NULL; with ``compat`` it is the class of no move. vol spreads
    over the returns of rows t+1..t+H; with ``compat`` over t-H+2..t+1, as many rows but mostly past."""
    future = F.lead("close", horizon).over(by_symbol())
    r = F.log((future + 1e-12) / (F.col("close") + 1e-12))
    edge = bps / 10_000
    if task == "price":
        return future
    if task == "return":
        return r
    if task == "direction":
        flat = 0 if classes == 2 else 1
        up, down = (1, 0) if classes == 2 else (2, 0)
        out = F.when(r >= edge, up) if classes == 2 else F.when(r >= edge, up).when(r <= -edge, down)
        return out.otherwise(flat) if compat else F.when(r.isNotNull(), out.otherwise(flat))
    if task == "vol":
        if horizon < 2:
            return F.lit(None).cast("double")
        frame = by_symbol().rowsBetween(2 - horizon, 1) if compat else by_symbol().rowsBetween(1, horizon)
        return F.when(F.count("ret_1m").over(frame) >= max(2, int(horizon * 0.8)), F.stddev_samp("ret_1m").over(frame))
    raise ValueError(f"no label task {task!r}")


def event_label(event: str, horizon: int, window: int = 60, bps: float = 10.0, expand: float = 0.5, column: str | None = None, thresholds: dict[str, float] | None = None) -> Column:
    """1.0 or 0.0 for breakout, squeeze or spike within the next ``horizon`` rows, NULL where it cannot be told.

    ``thresholds`` come from the training part: squeeze_low; spike_ret and spike_vol (or neither)."""
    known = thresholds or {}
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    if event == "breakout":
        high = rolling(F.max, F.col("high"), by_symbol(), window, int(window * 0.8))
        return F.when(high.isNotNull(), number(future_max(F.col("close"), by_symbol(), horizon) >= high * (1 + bps / 10_000)))
    if event == "squeeze":
        low, x = known.get("squeeze_low"), F.col(column)
        if low is None:
            return F.lit(None).cast("double")
        return F.when(x.isNotNull(), number((x <= low) & (future_max(x, by_symbol(), horizon) >= x * (1 + expand))))
    if event == "spike":
        ret, vol = known.get("spike_ret"), known.get("spike_vol")
        move = future_max(F.abs("ret_1m"), by_symbol(), horizon)
        share = future_max(F.col(column), by_symbol(), horizon) if column else F.lit(None).cast("double")
        hit = number(move >= ret if ret is not None else F.lit(False)) + number(share >= vol if vol is not None else F.lit(False))
        return F.when(move.isNotNull() | share.isNotNull(), (hit > 0).cast("double"))
    raise ValueError(f"no event {event!r}")


def training_thresholds(train: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float]:
    """Exact percentiles of the training part: name -> (expression, percentile in 0..100). One row comes back."""
    row = train.agg(*[F.percentile(x, F.lit(p / 100)).alias(n) for n, (x, p) in wanted.items()]).first()
    return {n: row[n] for n in wanted if row[n] is not None}


def split_time(df: DataFrame, train: float = 0.7, validation: float = 0.15, embargo: str = "60 minutes") -> DataFrame:
    """``df`` with ``split``: train, val, test, or NULL inside an embargo.

    The cuts are distinct times at the given shares; with under ten times, rows in order of time and
    symbol are cut instead."""
    times = df.select("ts").distinct()
    # one row of cuts: the k-th of n distinct times, exact and without sorting all in one task
    n = times.count()
    if n < 10:
        place = F.row_number().over(Window.orderBy("ts", "symbol")) - 1
        total = df.count()
        i, j = int(total * train), int(total * (train + validation))
        return df.withColumn("split", F.when(place < i, "train").when(place < j, "val").otherwise("test"))
    t1, t2 = _kth(times, n, [int(n * train), int(n * (train + validation))])
    t, gap = F.col("ts"), F.expr(f"INTERVAL {embargo}")
    return df.withColumn("split", F.when(t <= t1 - gap, "train").when((t > t1) & (t <= t2 - gap), "val").when(t > t2, "test"))


def _kth(times: DataFrame, n: int, wanted: Sequence[int], part: str = "1 day") -> list[Column]:
    """The distinct times of given places, found through counts of each ``part``."""
    counts = times.groupBy(F.window("ts", part)["start"].alias("d")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each part
    upto = counts.select("d", "n", (F.sum("n").over(Window.orderBy("d")) - F.col("n")).alias("before"))
    ranked = times.withColumn("__d", F.window("ts", part)["start"]).join(F.broadcast(upto), F.col("__d") == F.col("d")).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("d").orderBy("ts")) - 1)
    found = {r["place"]: r["ts"] for r in ranked.where(F.col("place").isin(list(wanted))).collect()}
    return [F.lit(found[w]).cast("timestamp_ntz") for w in wanted]


def purged_folds(df: DataFrame, folds: int = 5, embargo: str = "60 minutes") -> DataFrame:
    """``df`` with ``fold`` and ``role`` (train or val), one row for each fold a row takes part in.

    Folds are runs of distinct times, the first ones longer by one where they do not divide evenly;
    training rows keep the embargo's distance to both ends of the validation run."""
    if folds < 2:
        raise ValueError("at least two folds")
    times = df.select("ts").distinct()
    n = times.count()
    begins = [i * (n // folds) + min(i, n % folds) for i in range(min(folds, n))]
    ends = [b - 1 for b in [*begins[1:], n]] if n else []
    at = dict(zip([*begins, *ends], _kth(times, n, [*begins, *ends])))
    runs = F.array(*[F.struct(F.lit(i + 1).alias("fold"), at[a].alias("__a"), at[b].alias("__b")) for i, (a, b) in enumerate(zip(begins, ends))])
    t, gap = F.col("ts"), F.expr(f"INTERVAL {embargo}")
    role = F.when(t.between(F.col("__a"), F.col("__b")), "val").when((t <= F.col("__a") - gap) | (t >= F.col("__b") + gap), "train")
    if not n:
        return df.limit(0).withColumn("fold", F.lit(0)).withColumn("role", F.lit("val"))
    return df.select("*", F.inline(runs)).withColumn("role", role).where("role IS NOT NULL").drop("__a", "__b").withColumn("fold", F.col("fold") - 1)


def fixed_universe(train: DataFrame, liquidity: str, top: int | None = None, percentile: float | None = None) -> DataFrame:
    """Symbols by their median liquidity in training: the first ``top``, or those at or above a percentile."""
    medians = train.groupBy("symbol").agg(F.percentile(liquidity, F.lit(0.5)).alias("median"))
    if top is not None:
        return medians.orderBy(F.desc("median"), "symbol").limit(top)
    cut = medians.agg(F.percentile("median", F.lit((percentile or 0) / 100)).alias("cut"))
    return medians.join(F.broadcast(cut), F.col("median") >= F.col("cut")).drop("cut")
