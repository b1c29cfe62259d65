"""Modes of price and volume series, their cycles and clusters. One group of one series at a time runs in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import cluster, decompose
from tickloom.operators.cycles import fuse_cycles, peak_cycles
from tickloom.operators.grid import fill_bars, on_grid
from tickloom.plans.imf_post import relabel
from tickloom.plans.tables import bars_h


@dataclass(frozen=True)
class StageConfig:
    bar_days: float = 1 / 24
    trials: int = 100
    seed: int = 1337
    least_period: float = 3
    most_share: float = 2 / 3
    least_depth: float = 2.0
    winsor: tuple[float, float] = (1, 99)


MODES = "symbol string, series string, imf_id int, ts timestamp_ntz, value double, original double"


def decompose_series(bars: DataFrame, ensemble: bool = False, cfg: StageConfig = StageConfig()) -> DataFrame:
    """(symbol, series, imf_id, ts, value, original) of each symbol's price and volume modes."""
    long = bars.select("symbol", "ts", F.explode(F.array(F.struct(F.lit("price").alias("series"), F.col("close").alias("y")), F.struct(F.lit("volume").alias("series"), F.col("volume").alias("y")))).alias("s")).select("symbol", "ts", "s.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        y = pdf["y"].to_numpy(float)
        modes, _ = decompose.ceemdan(y, cfg.trials, seed=cfg.seed) if ensemble else decompose.emd(y)
        parts = [pd.DataFrame({"symbol": pdf["symbol"], "series": pdf["series"], "imf_id": k, "ts": pdf["ts"], "value": m, "original": y}) for k, m in enumerate(modes)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["symbol", "series", "imf_id", "ts", "value", "original"])

    return long.where("y IS NOT NULL").groupBy("symbol", "series").applyInPandas(run, MODES)


def cohort_cycles(bars: DataFrame, least_pct: float = 2.0) -> DataFrame:
    """Price cycles of each mode with the volume of overlapping volume cycles."""
    modes = decompose_series(bars)
    cut = lambda s, least: peak_cycles(modes.where(F.col("series") == s), ["symbol", "imf_id"], "ts", "value", "original", least)
    volume = cut("volume", None).drop("imf_id")
    return fuse_cycles(cut("price", least_pct), volume, bars)


CLUSTERED = "symbol string, method string, cluster int, n bigint, median_amplitude_pct double, mad_amplitude_pct double, median_duration_min double, mad_duration_min double, median_volume double, mad_volume double, small boolean"


def cluster_cycles(cycles: DataFrame, most: int = 5, least: int = 5, seed: int = 0) -> DataFrame:
    """Summaries of each symbol's cycles, clustered by mixture and by density on robustly scaled features.

    Clusters under ``least`` members are marked small; symbols with under three cycles have none."""
    columns = ["amplitude_pct", "duration_min", "total_volume"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_time", "end_time"], ignore_index=True)
        x = pdf[columns].to_numpy(float)
        rows = []
        if len(x) >= 3:
            q = np.percentile(x, [25, 50, 75], axis=0)
            scaled = (x - q[1]) / np.where(q[2] > q[0], q[2] - q[0], 1)
            for method, labels in (("gmm", cluster.best_mixture(scaled, most, seed)), ("dbscan", cluster.best_dbscan(scaled))):
                for k in sorted(set(labels) - {cluster.NOISE}):
                    part = x[labels == k]
                    med = np.median(part, axis=0)
                    mad = np.median(np.abs(part - med), axis=0)
                    rows.append((pdf["symbol"][0], method, int(k), len(part), med[0], mad[0], med[1], mad[1], med[2], mad[2], len(part) < least))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CLUSTERED.split(", ")])

    return cycles.groupBy("symbol").applyInPandas(run, CLUSTERED)


FEATURES = "symbol string, series string, imf_id int, period_days double, amp_pct double, energy double, cycles_count int, pct_cycles_ge_2pct double, phase_var double, vol_amp_corr double, vol_period_ratio double, all_energy double"


def stage_features(bars: DataFrame, cfg: StageConfig = StageConfig()) -> DataFrame:
    """Features of the modes that pass, of each symbol's log price and winsorised log volume, detrended.

    Price modes carry their best volume partner's correlation and period ratio. The energy share is taken
    over all modes, passing or not."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        price, volume = pdf["close"].to_numpy(float), pdf["volume"].to_numpy(float)
        low, high = np.percentile(volume, cfg.winsor)
        series = {"price": (price, np.log(np.maximum(price, 1e-9))), "volume": (volume, np.log1p(np.clip(volume, low, high)))}
        found, total = {}, {}
        for name, (original, y) in series.items():
            modes, _ = decompose.ceemdan(decompose.detrend(y), cfg.trials, seed=cfg.seed)
            total[name] = float(np.var(modes, axis=1).sum()) if len(modes) else 0.0
            found[name] = [(k, f) for k, m in enumerate(modes) if (f := decompose.mode_features(m, original, cfg.least_period, cfg.most_share, cfg.least_depth))]
        partners = decompose.pair_modes([f for _, f in found["price"]], [f for _, f in found["volume"]])
        rows = []
        for name, modes in found.items():
            for i, (k, (info, _, _)) in enumerate(modes):
                mate = partners[i] if name == "price" else None
                ratio = found["volume"][mate[0]][1][0]["period_bars"] / info["period_bars"] if mate else math.nan
                rows.append((pdf["symbol"][0], name, k, info["period_bars"] * cfg.bar_days, info["amp_pct"], info["energy"], info["cycles_count"], info["pct_cycles_ge_2pct"], info["phase_var"], mate[1] if mate else math.nan, ratio, total[name]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    out = bars.select("symbol", "ts", "close", "volume").groupBy("symbol").applyInPandas(run, FEATURES)
    clean = out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("vol_amp_corr", "vol_period_ratio")})
    return clean.withColumn("energy_share", F.col("energy") / (F.col("all_energy") + 1e-9)).drop("all_energy").withColumn("status", F.lit("ok"))


def cluster_modes(features: DataFrame, least: int = 8) -> DataFrame:
    """``cluster_id`` (GP or GV and four digits) of each mode among its series' modes of all symbols, by log period and amplitude."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["symbol", "imf_id"], ignore_index=True)
        x = np.log(np.maximum(pdf[["period_days", "amp_pct"]].to_numpy(float), 1e-9))
        spread = x.std(axis=0)
        return pdf[["symbol", "series", "imf_id"]].assign(label=cluster.global_clusters((x - x.mean(axis=0)) / np.where(spread > 0, spread, 1), least))

    labels = features.groupBy("series").applyInPandas(run, "symbol string, series string, imf_id int, label int")
    prefix = F.when(F.col("series") == "price", "GP").otherwise("GV")
    return relabel(features.join(labels, ["symbol", "series", "imf_id"]), "label", prefix, ["series"]).drop("label")


def asset_clusters(features: DataFrame, limit: float = 0.10) -> DataFrame:
    """``asset_cluster_id``, such as A:SYM:0001, of each symbol's modes by log period; ids by size, then period."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["period_days", "series", "imf_id"], ignore_index=True)
        labels = cluster.ward_1d(np.log(np.maximum(pdf["period_days"].to_numpy(float), 1e-9)), limit)
        sizes = {k: (-(labels == k).sum(), np.median(pdf["period_days"][labels == k])) for k in set(labels)}
        rank = {k: i + 1 for i, k in enumerate(sorted(sizes, key=lambda k: sizes[k]))}
        return pdf[["symbol", "series", "imf_id"]].assign(asset_cluster_id=[f"A:{s}:{rank[k]:04d}" for s, k in zip(pdf["symbol"], labels)])

    ids = features.groupBy("symbol").applyInPandas(run, "symbol string, series string, imf_id int, asset_cluster_id string")
    return features.join(ids, ["symbol", "series", "imf_id"])


def dominant_lines(clusters: DataFrame) -> DataFrame:
    """(symbol, line): the cluster of largest amplitude as "symbol, minutes, percent"; mixtures before density."""
    order = F.struct("median_amplitude_pct", (F.col("method") == "gmm").cast("int"), -F.col("cluster"))
    top = clusters.groupBy("symbol").agg(F.max_by(F.struct("median_duration_min", "median_amplitude_pct"), order).alias("t"))
    return top.select("symbol", F.format_string("%s, %.2f, %.2f", "symbol", "t.median_duration_min", "t.median_amplitude_pct").alias("line"))


def _bars(spark, d):
    return fill_bars(on_grid(bars_h(spark, d), "1 hour"))


def q_emd_modes(spark, d):
    return decompose_series(_bars(spark, d)).groupBy("symbol", "series", "imf_id").agg(F.round(F.var_pop("value"), 6).alias("energy"), F.count(F.lit(1)).alias("bars"))


def q_emd_cycles(spark, d):
    return cohort_cycles(_bars(spark, d))


def q_cluster_cycles(spark, d):
    return cluster_cycles(cohort_cycles(_bars(spark, d)))


def q_dominant_cycles(spark, d):
    return dominant_lines(cluster_cycles(cohort_cycles(_bars(spark, d))))


def q_imf_stage(spark, d):
    return asset_clusters(cluster_modes(stage_features(_bars(spark, d), StageConfig(trials=10)), least=4))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
SQL: dict = {}
