"""Whole jobs from source to sink, as functions of keyword parameters. No job reads the clock: times are parameters."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.ml import dataset as ds
from tickloom.ml import models, scoring
from tickloom.operators import grid
from tickloom.plans import baseline, imf, imf_post, leaderboard, metrics, regime, rules
from tickloom.plans.tables import BARS_D, bars_d, bars_h
from tickloom.sources import sinks
from tickloom.sources.bars import history_months
from tickloom.store import settle


def run_leaderboards(bars: DataFrame, out: str, top_n: int = 20, sizes: Sequence[int] = leaderboard.SIZES) -> dict[str, DataFrame]:
    """Cohorts with their summaries as JSON and the full history of each as CSV; what was written."""
    stats = settle(leaderboard.window_stats(bars, sizes), "window-stats")
    movers = settle(leaderboard.top_movers(stats, top_n), "movers")
    counts, members = leaderboard.tallies(movers), settle(leaderboard.cohorts(movers, top_n, sizes), "cohorts")
    found = {}
    for cohort in ("losers", "gainers", "overlaps"):
        own = members.where(F.col("cohort") == cohort)
        summary = leaderboard.section_summary(stats, counts, own)
        summary.write.mode("overwrite").json(f"{out}/{cohort}_summary")
        found[cohort] = bars.join(own.select("symbol"), "symbol", "left_semi")
        sinks.write_csv(found[cohort], f"{out}/{cohort}_bars", skip_empty=True)
    return found


def state_snapshot(bars: DataFrame, out: str, past: DataFrame | None = None, sizes: Sequence[int] = (1, 4, 12, 24), every: str = "1 minute", bar_hours: float = 1 / 60, fine: str | None = None, impute: bool = True, compression: str = "snappy", compare: Sequence[str] = tuple(metrics.METRICS)) -> DataFrame:
    """The intraday snapshot, its metrics ``compare`` set against baselines of ``past`` (the same bars unless given), imputed and written by day."""
    snap = settle(metrics.metrics_snapshot(bars, sizes, every, bar_hours, fine), "snapshot")
    names = [metrics.column_name(m, f"{s}h") for s in sizes for m in compare]
    series = [metrics.metrics_series(past if past is not None else bars, s, every, bar_hours) for s in sizes]
    long = [baseline.to_long(x.select("symbol", *[F.col(m).alias(metrics.column_name(m, f"{s}h")) for m in compare]), [metrics.column_name(m, f"{s}h") for m in compare]) for s, x in zip(sizes, series)]
    every_one = long[0]
    for x in long[1:]:
        every_one = every_one.unionByName(x)
    snap = settle(baseline.enrich_wide(snap, settle(baseline.build_baseline(every_one), "baseline"), names), "enriched")
    snap = baseline.impute_neutral(snap, "state") if impute else snap
    sinks.write_snapshot(snap, out, compression=compression)
    return snap


def regime_job(bars: DataFrame, out: str, asof: Column, windows: Sequence[int] = (3, 7, 14, 30, 90), impute: bool = True, compression: str = "snappy") -> DataFrame:
    snap = settle(regime.regime_snapshot(bars, asof, windows), "regime")
    snap = baseline.impute_neutral(snap, "regime") if impute else snap
    sinks.write_snapshot(snap, out, compression=compression)
    return snap


def imf_job(bars: DataFrame, out: str, asof: Column, months: int, every: str = "1 minute", cfg: imf.StageConfig = imf.StageConfig()) -> DataFrame:
    """Mode features of a look-back in calendar months, clustered over all symbols and within each, with cards."""
    symbols = bars.select("symbol").distinct()
    recent = history_months(bars.withColumnRenamed("ts", "timestamp"), symbols, asof, months).withColumnRenamed("timestamp", "ts")
    features = settle(imf.stage_features(grid.fill_bars(grid.on_grid(recent, every)), cfg), "mode-features")
    done = settle(imf.asset_clusters(imf.cluster_modes(features)), "mode-clusters").withColumn("asof", asof)
    full = imf_post.with_stubs(symbols, done)
    full.write.mode("overwrite").parquet(f"{out}/summary")
    imf_post.cluster_cards(done, "cluster_id").write.mode("overwrite").json(f"{out}/cluster_cards")
    sinks.cards_json(done.select("symbol", "series", "imf_id", "period_days", "amp_pct", "asset_cluster_id"), "symbol").write.mode("overwrite").json(f"{out}/asset_cards")
    return full


def rules_job(snapshot: DataFrame, out: str, regime_rows: DataFrame | None = None, clusters: DataFrame | None = None, overrides: Mapping[str, object] | None = None) -> DataFrame:
    """Signals as CSV and cards as text."""
    cfg = rules.configure(overrides or {})
    df = snapshot
    if clusters is not None:
        best = rules.dominant_cluster(clusters).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct(F.col("median_amplitude_pct").alias("amp"), F.col("median_duration_min").alias("dur"), "method")))).alias("imf"))
        df = df.join(best, "symbol", "left")
    if regime_rows is not None:
        df = rules.attach_regime(df, regime_rows, cfg.regime_tolerance_days)
    found = rules.signals(df, cfg)
    sinks.write_csv(found, f"{out}/signals")
    sinks.write_text_lines(sinks.play_cards(found), "line", f"{out}/cards")
    return found


def train_job(bars: DataFrame, out: str, spec: ds.DatasetSpec, task: str = "direction", horizon: int = 60, bps: float = 5, classes: int = 2, model: str = "rf", preset: str = "light", embargo: str = "60 minutes", series: DataFrame | None = None, folds: int = 0, seed: int = 42, **sizes: float) -> dict:
    """Build, split, fit, score on the test part, choose a threshold on the validation part, write; the scores."""
    df, features = ds.build_dataset(bars, spec, series)
    labelled = df.withColumn("label", ds.labels(task, horizon, bps, classes).cast("double")).where("label IS NOT NULL")
    kind = "regression" if task in ("price", "return", "vol") else "binary" if classes == 2 else "multiclass"
    t = models.Task(kind, tuple(features), classes=classes, weight=None if kind == "regression" else "weight", seed=seed)

    def fitted(train: DataFrame):
        return models.build(model, t, preset, **sizes).fit(models.with_class_weight(train, "label") if t.weight else train)

    def scores(m, part: DataFrame) -> DataFrame:
        p = models.predict(m, part, t, ["symbol", "ts", "label"])
        if kind == "regression":
            return scoring.regression_scores(p, "label", "prediction")
        return scoring.binary_scores(p, "label", "prediction", "prob") if kind == "binary" else scoring.macro_f1(p, "label", "prediction")

    parts = ds.split_time(labelled, embargo=embargo)
    of = lambda name: parts.where(F.col("split") == name)
    result: dict = {}
    if folds:
        cut = ds.purged_folds(of("train"), folds, embargo)
        each = [scores(fitted(cut.where((F.col("fold") == k) & (F.col("role") == "train"))), cut.where((F.col("fold") == k) & (F.col("role") == "val"))).first().asDict() for k in range(folds)]
        result["cv"] = {n: [e[n] for e in each] for n in each[0]}
    m = fitted(of("train"))
    result["test"] = scores(m, of("test")).first().asDict()
    if kind == "binary":
        table = scoring.threshold_table(models.predict(m, of("val"), t, ["label"]), "label", "prob", [round(0.05 * k, 2) for k in range(1, 20)])
        best = scoring.best_threshold(table, "f1").first()
        result["threshold"] = best and best["tau"]
    models.predict(m, of("test"), t, ["symbol", "ts", "label"]).write.mode("overwrite").parquet(f"{out}/predictions")
    models.save_artifacts(m, f"{out}/artifacts", features, result, {"task": task, "horizon": horizon, "model": model, "preset": preset, "seed": seed})
    return result


def predict_job(df: DataFrame, artifacts: str, out: str, kind: str = "binary", classes: int = 2) -> DataFrame:
    """Predictions of saved artifacts; ValueError names features that the table lacks."""
    m, notes = models.load_artifacts(df.sparkSession, artifacts)
    features = notes["features_used"].split("\n")
    if lacking := models.missing_features(df, features):
        raise ValueError(f"features missing: {', '.join(lacking)}")
    p = models.predict(m, df, models.Task(kind, tuple(features), classes=classes), ["symbol", "ts"])
    p.write.mode("overwrite").parquet(out)
    return p


def run_config(**values: object) -> str:
    """Parameters and library versions of a run as JSON."""
    import numpy
    import pyspark

    return json.dumps({**values, "versions": {"pyspark": pyspark.__version__, "numpy": numpy.__version__}}, sort_keys=True, default=str)


def run_all(bars: DataFrame, out: str, asof: Column, every: str, bar_hours: float, months: int = 1, sizes: Sequence[int] = (1, 4, 12, 24), top_n: int = 20, cfg: imf.StageConfig = imf.StageConfig()) -> dict[str, DataFrame]:
    """Leaderboards, then for each cohort that has bars its state, regime, modes and signals, in one session."""
    found = {}
    for cohort, own in run_leaderboards(bars, str(Path(out) / "leaderboards") if "://" not in out else f"{out}/leaderboards", top_n).items():
        if own.isEmpty():
            continue
        state = state_snapshot(own, f"{out}/{cohort}/state", sizes=sizes, every=every, bar_hours=bar_hours)
        context = regime_job(own, f"{out}/{cohort}/regime", asof)
        imf_job(own, f"{out}/{cohort}/imf", asof, months, every, cfg)
        found[cohort] = rules_job(state, f"{out}/{cohort}/rules", context, overrides={"timeframes": tuple(f"{s}h" for s in sizes)})
    return found


def q_bars_coverage(spark, d):
    c = grid.bars_coverage(bars_h(spark, d), "1 hour", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return c.select("symbol", "before", "after", F.round("missing_share", 9).alias("missing_share"))


def q_history_months(spark, d):
    b = bars_d(spark, d).withColumnRenamed("ts", "timestamp")
    out = history_months(b, b.where("symbol < 'N'").select("symbol"), F.lit("2000-03-31").cast("timestamp_ntz"), 1)
    return out.select("symbol", "timestamp", F.round("close", 6).alias("close"))


def q_section_summary(spark, d):
    s = settle(leaderboard._stats(spark, d), "window-stats")
    m = settle(leaderboard.top_movers(s), "movers")
    return leaderboard.section_summary(s, leaderboard.tallies(m), leaderboard.cohorts(m).where("cohort = 'overlaps'"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
SQL = {
    "bars_coverage": """SELECT event_type AS symbol, count(DISTINCT date_trunc('hour', ts)) AS before, CAST(360 AS BIGINT) AS after, round(1 - count(DISTINCT date_trunc('hour', ts)) / 360, 9) AS missing_share
        FROM events WHERE date_trunc('hour', ts) > TIMESTAMP '2024-01-05' AND date_trunc('hour', ts) <= TIMESTAMP '2024-01-20' GROUP BY 1""",
    "history_months": f"WITH {BARS_D} SELECT symbol, ts AS timestamp, round(close, 6) AS close FROM bars WHERE symbol < 'N' AND ts > TIMESTAMP '2000-02-29' AND ts <= TIMESTAMP '2000-03-31'",
}
