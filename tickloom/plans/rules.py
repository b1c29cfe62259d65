"""Trade signals from an enriched snapshot, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import price_at
from tickloom.operators.joins import nearest
from tickloom.plans.tables import table


@dataclass(frozen=True)
class RulesConfig:
    """Thresholds and policies (fixed values by default)."""

    timeframes: tuple[str, ...] = ("1h", "4h", "12h", "24h")
    breakout_atr: float = 1.25
    reversion_atr: float = 0.85
    band_buffer_atr: float = 0.1
    reversion_policy: str = "conservative"
    roi_cap_pct: float = 25.0
    default_t1_pct: float = 8.0
    default_hold_min: int = 1440
    squeeze_pctile: float = 30.0
    squeeze_ratio: float = 1.0
    abnormal_pctile: float = 98.0
    abnormal_share: float = 0.30
    adx_min: float = 25.0
    regime_tolerance_days: int = 3
    imf_window: Mapping[str, str] = field(default_factory=lambda: {"1h": "6h", "4h": "12h", "12h": "24h", "24h": "24h"})
    tagged_volume: bool = True


def configure(overrides: Mapping[str, object]) -> RulesConfig:
    """The defaults with some values replaced; KeyError for a name that is none of theirs."""
    names = {f.name for f in fields(RulesConfig)}
    if unknown := set(overrides) - names:
        raise KeyError(", ".join(sorted(unknown)))
    return replace(RulesConfig(), **overrides)


def attach_regime(snapshot: DataFrame, regime: DataFrame, tolerance_days: int = 3) -> DataFrame:
    """``regime``: the symbol's row nearest in time within the tolerance, else its latest, as a struct."""
    right = regime.select("symbol", F.col("timestamp_asof_utc").alias("regime_ts"), "ma50_slope_30d_dir", "ma200_slope_90d_dir", "above_ma50_share_30d_pos")
    return nearest(snapshot, right, ["symbol"], "timestamp_asof_utc", "regime_ts", tolerance_days * 86_400, "regime")


def macro_aligned(regime: str = "regime") -> Column:
    """Rising averages and mostly above them; NULL without a regime row."""
    part = lambda c, x: F.coalesce(F.col(f"{regime}.{c}"), F.lit(0.0)) > x
    return F.when(F.col(regime).isNotNull(), part("ma50_slope_30d_dir", 0.0) & part("ma200_slope_90d_dir", 0.0) & part("above_ma50_share_30d_pos", 0.5))


def dominant_cluster(clusters: DataFrame) -> DataFrame:
    """Of each (symbol, window) the cluster that is not small, then largest, then first; method gmm before dbscan."""
    order = F.struct((~F.coalesce(F.col("small"), F.lit(False))).cast("int"), F.col("count"), (F.col("method") == "gmm").cast("int"), -F.col("place"))
    return clusters.groupBy("symbol", "window").agg(F.max_by(F.struct("median_amplitude_pct", "median_duration_min", "method"), order).alias("c")).select("symbol", "window", "c.*")


def signals(df: DataFrame, cfg: RulesConfig = RulesConfig()) -> DataFrame:
    """Signal rows of a snapshot that may hold ``regime`` (a struct) and ``imf`` (map of window to amp, dur, method).

    Each timeframe gives at most one breakout and one reversion; a condition on a missing value fails."""
    have = set(df.columns)
    col = lambda n, kind="double": F.col(n).cast(kind) if n in have else F.lit(None).cast(kind)
    ok = lambda c: F.coalesce(c, F.lit(False))
    macro = ok(macro_aligned()) if "regime" in have else F.lit(False)
    rows = []
    for tf in cfg.timeframes:
        v = lambda n, tag="": col(f"{n}_{tf}{tag}")  # noqa: E731, B023
        price, upper, lower, atr, rsi = col("close_current"), v("bollinger_upper"), v("bollinger_lower"), v("atr"), v("rsi", "_pctile")
        width, position, window = v("bollinger_width"), v("bb_position", "_pos"), cfg.imf_window.get(tf, "24h")
        imf = F.try_element_at(F.col("imf"), F.lit(window)) if "imf" in have else F.lit(None).cast("struct<amp:double,dur:double,method:string>")
        amp, dur, method = imf["amp"], imf["dur"], F.coalesce(imf["method"], F.lit(""))
        flow = ok(v("quote_volume_sum", "_mag_pctile" if cfg.tagged_volume else "_pctile") > cfg.abnormal_pctile) | ok(v("vol_spike_share", "_pos") > cfg.abnormal_share)
        squeeze = ok(v("squeeze_index", "_mag_pctile") < cfg.squeeze_pctile) | ok((atr > 0) & (width / (atr + 1e-12) < cfg.squeeze_ratio))
        trend = (v("adx") > cfg.adx_min) & (v("macd_histogram") > 0) & ((rsi > 55) | ok(v("roc", "_pctile") > 55)) & rsi.between(60, 85) & atr.isNotNull()
        gap_up, gap_down = upper - price, price - lower
        near = lambda gap: ok((gap >= 0) & (gap <= F.greatest(F.lit(0.0), 0.5 * atr)))  # noqa: E731, B023
        status = lambda hit, gap: F.when(ok(hit), "trigger").when(near(gap), "setup")  # noqa: E731, B023
        up = F.when(ok(trend), status(ok(position > 0.98) | ok(price > upper), gap_up))
        down = F.when(ok(rsi < 20) & atr.isNotNull(), status(ok(position < 0.05) | ok(price < lower), gap_down))
        hold = F.when(dur > 0, dur).otherwise(float(cfg.default_hold_min)).cast("int")
        t1 = F.least(F.coalesce(amp, F.lit(cfg.default_t1_pct)), F.lit(cfg.roi_cap_pct))
        t2 = F.when(macro & ok(amp > 20), 1.5 * t1)
        pick = F.least if cfg.reversion_policy == "wide" else F.greatest
        stop_up = F.least(F.greatest(price - cfg.breakout_atr * atr, upper - cfg.band_buffer_atr * atr), price)
        stop_down = F.least(pick(price - cfg.reversion_atr * atr, lower - cfg.band_buffer_atr * atr), price)
        text = lambda x, c: F.concat(F.lit(f"{x}="), F.coalesce(c.cast("string"), F.lit("nan")))
        used = F.when(method != "", F.concat(F.lit(f"imf_window={window}:"), method))
        ratio_note = F.when(squeeze & (atr > 0), F.format_string("squeeze_ratio=%.2f", width / (atr + 1e-12)))
        notes_up = F.concat_ws("; ", text(f"rsi_{tf}_pctile", rsi), text(f"adx_{tf}", v("adx")), F.lit("macd_hist>0"), ratio_note, used, F.when(up == "trigger", "trigger=above_band").otherwise(F.format_string("setup=within_0.5ATR_upper: gap=%.6f", gap_up)))
        notes_down = F.concat_ws("; ", text(f"rsi_{tf}_pctile", rsi), used, F.when(down == "trigger", "trigger=below_band").otherwise("setup=near_lower"))

        def signal(kind, state, stop, second, tags, notes):
            made = F.struct(
                F.lit(tf).alias("timeframe"), F.lit(kind).alias("signal_type"), state.alias("status"), F.round(price, 8).alias("entry"), F.round(stop, 8).alias("stop"), F.round(price_at(price, t1), 8).alias("target1"),  # noqa: B023
                F.round(price_at(price, second), 8).alias("target2"), hold.alias("expected_hold_min"), F.concat_ws(",", *tags).alias("tags"), notes.alias("notes"), F.lit(window).alias("imf_window_used"), method.alias("imf_method"),  # noqa: B023
            )
            return F.when(state.isNotNull(), made)

        rows.append(signal("long_breakout", up, stop_up, t2, [F.lit("trend"), F.lit("strong_adx"), F.when(flow, "abnormal_flow"), F.when(squeeze, "squeeze"), F.when(up == "setup", "pre_breakout")], notes_up))
        rows.append(signal("long_reversion", down, stop_down, F.lit(None).cast("double"), [F.lit("reversion"), F.when(flow, "abnormal_flow"), F.when(down == "setup", "pre_reversion")], notes_down))
    found = F.filter(F.array(*rows), lambda s: s.isNotNull())
    return df.select("symbol", col("timestamp_asof_utc", "timestamp_ntz").alias("asof"), F.explode(found).alias("s")).select("symbol", "s.*", F.date_format("asof", "yyyy-MM-dd'T'HH:mm:ss").alias("asof"))


_SNAP = {
    "close_current": "100 + p_partkey % 37 - 18 + p_size / 10", "bollinger_upper_{w}": "108 + p_partkey % {a}", "bollinger_lower_{w}": "96 - p_partkey % {b}", "bollinger_width_{w}": "12 + p_partkey % {a} + p_partkey % {b}",
    "bb_position_{w}_pos": "(p_partkey % 101) / 100", "rsi_{w}_pctile": "(p_partkey * {a}) % 100", "adx_{w}": "15 + p_partkey % 40", "atr_{w}": "2 + p_size % 20", "roc_{w}_pctile": "(p_partkey * {b}) % 100",
    "vol_spike_share_{w}_pos": "(p_partkey % 9) / 20", "quote_volume_sum_{w}_mag_pctile": "90 + p_partkey % 11 - 1", "macd_histogram_{w}": "p_partkey % 7 - 2", "squeeze_index_{w}_mag_pctile": "(p_partkey * 3) % 100",
}


def _snapshot_columns() -> dict[str, str]:
    return {name.format(w=w): f"CAST({expr.format(a=a, b=b)} AS DOUBLE)" for w, a, b in (("4h", 7, 5), ("24h", 11, 3)) for name, expr in _SNAP.items()}


def q_rules_signals(spark, d):
    p = table(spark, d, "part")
    snap = p.selectExpr("CAST(p_partkey AS STRING) AS symbol", "p_partkey", "TIMESTAMP_NTZ '2024-01-10 00:00:00' AS timestamp_asof_utc", *[f"{e} AS {n}" for n, e in _snapshot_columns().items()])
    imf = F.when(F.col("p_partkey") % 3 != 0, F.create_map(F.lit("12h"), F.struct((F.col("p_partkey") % 30).cast("double").alias("amp"), (F.col("p_partkey") % 500).cast("double").alias("dur"), F.lit("gmm").alias("method"))))
    regime = p.where("p_partkey % 2 = 0").selectExpr("CAST(p_partkey AS STRING) AS symbol", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(cast(p_partkey % 15 AS INT)) AS timestamp_asof_utc", "CAST(p_partkey % 4 - 1 AS DOUBLE) AS ma50_slope_30d_dir", "0.5D AS ma200_slope_90d_dir", "0.6D AS above_ma50_share_30d_pos")
    return signals(attach_regime(snap.withColumn("imf", imf), regime), configure({"timeframes": ("4h", "24h")})).drop("notes").withColumn("expected_hold_min", F.col("expected_hold_min").cast("bigint"))


QUERIES = {"rules_signals": q_rules_signals}


def _signals_sql() -> str:
    parts = []
    for w, window in (("4h", "12h"), ("24h", "24h")):
        amp, dur, method = ("amp", "dur", "method") if window == "12h" else ("NULL::DOUBLE", "NULL::DOUBLE", "''")
        base = f"""SELECT symbol, '{w}' AS timeframe, close_current AS price, bollinger_upper_{w} AS up, bollinger_lower_{w} AS dn, atr_{w} AS atr, rsi_{w}_pctile AS rsi, bb_position_{w}_pos AS pos, {amp} AS amp, {dur} AS dur, {method} AS imf_method, '{window}' AS imf_window_used, macro,
            adx_{w} > 25 AND macd_histogram_{w} > 0 AND (rsi_{w}_pctile > 55 OR roc_{w}_pctile > 55) AND rsi_{w}_pctile BETWEEN 60 AND 85 AS trend, quote_volume_sum_{w}_mag_pctile > 98 OR vol_spike_share_{w}_pos > 0.3 AS flow,
            squeeze_index_{w}_mag_pctile < 30 OR bollinger_width_{w} / (atr_{w} + 1e-12) < 1 AS squeeze FROM joined"""
        parts.append(base)
    return f"""WITH snap AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 30 AS DOUBLE) END AS amp, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 500 AS DOUBLE) END AS dur,
            CASE WHEN p_partkey % 3 <> 0 THEN 'gmm' ELSE '' END AS method, {', '.join(f'{e} AS {n}' for n, e in _snapshot_columns().items())} FROM part),
        joined AS (SELECT *, p_partkey % 2 = 0 AND p_partkey % 4 - 1 > 0 AS macro FROM snap),
        tf AS ({' UNION ALL '.join(parts)}),
        s AS (SELECT *, CASE WHEN trend THEN CASE WHEN pos > 0.98 OR price > up THEN 'trigger' WHEN up - price >= 0 AND up - price <= 0.5 * atr THEN 'setup' END END AS us,
            CASE WHEN rsi < 20 THEN CASE WHEN pos < 0.05 OR price < dn THEN 'trigger' WHEN price - dn >= 0 AND price - dn <= 0.5 * atr THEN 'setup' END END AS ds, least(coalesce(amp, 8), 25) AS t1, CAST(CASE WHEN dur > 0 THEN dur ELSE 1440 END AS BIGINT) AS hold FROM tf)
        SELECT symbol, timeframe, 'long_breakout' AS signal_type, us AS status, round(price, 8) AS entry, round(least(greatest(price - 1.25 * atr, up - 0.1 * atr), price), 8) AS stop, round(price * (1 + t1 / 100), 8) AS target1,
            CASE WHEN macro AND amp > 20 THEN round(price * (1 + 1.5 * t1 / 100), 8) END AS target2, hold AS expected_hold_min, concat_ws(',', 'trend', 'strong_adx', CASE WHEN flow THEN 'abnormal_flow' END, CASE WHEN squeeze THEN 'squeeze' END, CASE WHEN us = 'setup' THEN 'pre_breakout' END) AS tags,
            imf_window_used, imf_method, '2024-01-10T00:00:00' AS asof FROM s WHERE us IS NOT NULL
        UNION ALL SELECT symbol, timeframe, 'long_reversion', ds, round(price, 8), round(least(greatest(price - 0.85 * atr, dn - 0.1 * atr), price), 8), round(price * (1 + t1 / 100), 8), NULL, hold,
            concat_ws(',', 'reversion', CASE WHEN flow THEN 'abnormal_flow' END, CASE WHEN ds = 'setup' THEN 'pre_reversion' END), imf_window_used, imf_method, '2024-01-10T00:00:00' FROM s WHERE ds IS NOT NULL"""


SQL = {"rules_signals": _signals_sql()}
