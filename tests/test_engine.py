import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.functions import arrays, cluster, decompose, fold, registry, scalar
from tickloom.ml import dataset as ds
from tickloom.ml import models, scoring
from tickloom.operators import analytic, cycles, grid, joins, sets
from tickloom.plans import baseline, imf, leaderboard, metrics, rules
from tickloom.sources import bars as src
from tickloom.sources import exchange, sinks
from tickloom.streaming import windows as stream

T0 = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def make_bars(n=60, seed=0, gaps=(), symbol="A"):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    o = c * np.exp(rng.normal(0, 0.005, n))
    h, low = np.maximum(o, c) * 1.01, np.minimum(o, c) * 0.99
    return [(symbol, at(i), float(o[i]), float(h[i]), float(low[i]), float(c[i]), float(rng.integers(1, 50))) for i in range(n) if i not in gaps]


def one_array(spark, xs, kind="double"):
    return spark.createDataFrame([(xs,)], f"x array<{kind}>")


@pytest.mark.parametrize("seed", range(6))
def test_smoothing_equals_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    xs = [None if rng.random() < 0.25 else float(rng.normal()) for _ in range(40)]
    df = one_array(spark, xs)
    for alpha, least in ((0.3, 1), (1 / 14, 5)):
        want = pd.Series(xs, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        got = df.select(fold.ewm_series(F.col("x"), alpha, least).alias("s"), fold.ewm_last(F.col("x"), alpha, least).alias("e")).first()
        assert [None if math.isnan(w) else w for w in want] == [None if g is None else pytest.approx(g) for g in got["s"]]
        assert got["e"] == (None if math.isnan(want.iloc[-1]) else pytest.approx(want.iloc[-1]))


@pytest.mark.parametrize("gaps", [(), (20, 21, 40)])
def test_fold_indicators_equal_pandas(spark, gaps):
    rows = make_bars(72, 3, gaps)
    got = metrics.indicators(metrics.collect_windows(spark.createDataFrame(rows, BAR), F.lit(T0), "1 hour", 72)).first()
    x = pd.DataFrame(rows, columns=["s", "ts", "o", "h", "l", "c", "v"]).set_index("ts").reindex(pd.date_range(T0, periods=72, freq="h"))
    ew = lambda s, a, m=0: s.ewm(alpha=a, adjust=False, min_periods=m).mean()
    move = x.c.diff()
    up, down = ew(move.clip(lower=0), 1 / 14, 14), ew(-move.clip(upper=0), 1 / 14, 14)
    assert got["rsi"] == pytest.approx((100 - 100 / (1 + up / down)).iloc[-1])
    tr = pd.concat([x.h - x.l, (x.h - x.c.shift()).abs(), (x.l - x.c.shift()).abs()], axis=1).max(axis=1)
    assert got["atr"] == pytest.approx(ew(tr.dropna(), 1 / 14, 14).iloc[-1])
    ups, downs = x.h.diff(), -x.l.diff()
    plus, minus = ups.where((ups > 0) & (ups > downs), 0.0), downs.where((downs > 0) & (downs > ups), 0.0)
    wide = ew(tr, 1 / 14, 14)
    p, m = 100 * ew(plus, 1 / 14, 14) / wide, 100 * ew(minus, 1 / 14, 14) / wide
    assert got["adx"] == pytest.approx(ew((100 * (p - m).abs() / (p + m)).replace(np.inf, np.nan), 1 / 14, 14).iloc[-1])
    line = ew(x.c, 2 / 13) - ew(x.c, 2 / 27)
    assert got["macd_histogram"] == pytest.approx((line - ew(line, 0.2)).iloc[-1])
    assert (got["parkinson_vol"] is None) == bool(gaps)


def test_awkward_windows(spark):
    flat = [("F", at(i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(24)]
    rising = [("U", at(i), 1.0 + i, 1.0 + i, 1.0 + i, 1.0 + i, 1.0) for i in range(24)]
    single = [("S", at(0), 1.0, 1.0, 1.0, 1.0, 1.0)]
    w = metrics.collect_windows(spark.createDataFrame(flat + rising + single, BAR), grid.floor_time(F.col("ts"), "24 hours"), "1 hour", 24)
    out = {r["symbol"]: r for r in metrics.indicators(w, keep_short=True).collect()}
    assert out["F"]["rsi"] is None and out["F"]["cci"] is None and out["F"]["stochastic_k"] is None and out["F"]["vwap"] is None and out["F"]["up_volume_share"] is None
    assert out["U"]["rsi"] is None and out["U"]["run_up_max"] == 23 and out["U"]["up_volume_share"] + out["U"]["down_volume_share"] == 1
    assert out["S"]["window_ok"] is False and out["S"]["close_mean"] is None and out["S"]["metrics_valid_vwap"] is False


def test_changes_from_zero(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.0, 0.0), (2.0, 3.0), (None, 1.0)], "b double, a double")
    assert [r[0] for r in df.select(scalar.change(F.col("a"), F.col("b"))).collect()] == [math.inf, None, 0.5, None]


def test_leaderboard_ties_and_top(spark):
    rows = [(s, at(6 * w), p) for s, ps in {"A": (10, 8), "B": (10, 8), "C": (10, 12)}.items() for w, p in enumerate(ps)]
    b = spark.createDataFrame([(s, t, float(p), 1.0) for s, t, p in rows], "symbol string, ts timestamp_ntz, close double, volume double")
    movers = leaderboard.top_movers(leaderboard.window_stats(b, (6,)), 1)
    assert sorted((r["symbol"], r["move"]) for r in movers.where("kind = 'price'").collect()) == [("A", "loss"), ("C", "gain")]


def test_asof_against_a_loop(spark):
    rng = np.random.default_rng(5)
    left = [(int(rng.integers(3)), at(int(x)), i) for i, x in enumerate(rng.integers(0, 500, 80))]
    right = [(k, at(int(x)), None if x % 3 else float(x)) for k in range(2) for x in sorted(set(rng.integers(0, 500, 25)))]
    l = spark.createDataFrame(left, "k int, ts timestamp_ntz, i int")  # noqa: E741
    r = spark.createDataFrame(right, "k int, rt timestamp_ntz, v double")
    for bucket in (None, 86_400):
        for row in joins.asof_backward(l, r, ["k"], "ts", "rt", bucket=bucket).collect():
            best = max(((t, v) for k, t, v in right if k == row["k"] and t <= row["ts"]), default=None, key=lambda x: x[0])
            assert (row["match"] and tuple(row["match"])) == best


def test_asof_gap_modes(spark):
    l = spark.createDataFrame([(at(0),), (at(2),), (at(50),)], "ts timestamp_ntz")  # noqa: E741
    r = spark.createDataFrame([(at(1), 7.0)], "rt timestamp_ntz, v double")
    got = {x["ts"]: x["match"] and x["match"]["v"] for x in joins.asof_with_gap(l, r, "ts", "rt", 3600).collect()}
    assert got == {at(0): None, at(2): 7.0, at(50): None}
    assert joins.asof_with_gap(l, r, "ts", "rt", 3600, "drop").count() == 2
    with pytest.raises(Exception, match="no base row"):
        joins.asof_with_gap(l, r, "ts", "rt", 3600, "error").collect()
    with pytest.raises(ValueError):
        joins.asof_with_gap(l, r, "ts", "rt", 3600, "other")


def test_nearest_against_a_loop(spark):
    left, right = [(1, at(x)) for x in (0, 30, 100, 400)], [(1, at(x), x) for x in (10, 50, 120)]
    out = joins.nearest(spark.createDataFrame(left, "k int, ts timestamp_ntz"), spark.createDataFrame(right, "k int, rt timestamp_ntz, x int"), ["k"], "ts", "rt", 24 * 3600)
    assert {r["ts"]: r["match"]["x"] for r in out.collect()} == {at(0): 10, at(30): 10, at(100): 120, at(400): 120}


def test_interval_overlaps_against_a_loop(spark):
    rng = np.random.default_rng(2)
    spans = lambda n: [("s", at(int(a)), at(int(a + b))) for a, b in zip(rng.integers(0, 200, n), rng.integers(0, 90, n))]
    a, b = sorted(set(spans(25))), sorted(set(spans(25)))
    x, y = spark.createDataFrame(a, "k string, s timestamp_ntz, e timestamp_ntz"), spark.createDataFrame(b, "k string, vs timestamp_ntz, ve timestamp_ntz")
    for full in (False, True):
        got = sorted((r["s"], r["e"], r["vs"], r["ve"]) for r in joins.interval_overlaps(x, y, ["k"], ("s", "e"), ("vs", "ve"), full_overlap=full).collect())
        assert got == sorted((s, e, p, q) for _, s, e in a for _, p, q in b if s <= p <= e or s <= q <= e or full and p <= s and q >= e)


def test_interval_sums(spark):
    b = spark.createDataFrame([("A", at(i), float(i)) for i in range(10)], "symbol string, ts timestamp_ntz, volume double")
    i = spark.createDataFrame([("A", at(2), at(5)), ("A", at(9), at(9))], "symbol string, s timestamp_ntz, e timestamp_ntz")
    assert sorted(r["x"] for r in joins.interval_sums(i, b, ["symbol"], ("s", "e"), "ts", "volume", "x").collect()) == [9.0, 14.0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25))
def test_peaks_in_numpy_are_strict_with_plateaus(xs):
    x, want = np.asarray(xs, float), []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            want.append((i + j) // 2)
    assert decompose.local_peaks(x).tolist() == want


def test_peaks_in_spark_equal_numpy(spark):
    xs = [0, 1, 1, 0, 2, 3, 3, 3, 1, 1, 2, 0, 0, 5]
    df = spark.createDataFrame([("A", at(i), float(x)) for i, x in enumerate(xs)], "symbol string, ts timestamp_ntz, x double")
    got = sorted(r["ts"] for r in analytic.peaks(df, ["symbol"], "ts", "x").collect())
    assert got == [at(int(i)) for i in decompose.local_peaks(np.asarray(xs, float))]


def test_cycle_depth_around_zero(spark):
    assert spark.range(1).select(cycles.cycle_depth(F.lit(1.0), F.lit(-1.0)), cycles.cycle_depth(F.lit(3.0), F.lit(1.0))).first()[:] == (0.0, 100.0)


def test_streak_rank_and_future(spark):
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate([1.0, 2.0, None, 3.0, 3.0, 4.0])], "k string, i int, x double")
    assert analytic.longest_streak(df, ["k"], "i", F.col("x") > 1, "n").first()["n"] == 3
    got = [r[0] for r in df.orderBy("i").select("i", analytic.rank_pct(F.col("x"), ["k"]).alias("r")).orderBy("i").select("r").collect()]
    assert got == [0.2, 0.4, None, 0.7, 0.7, 1.0]
    from pyspark.sql.window import Window

    future = [r[0] for r in df.select("i", analytic.future_max(F.col("x"), Window.partitionBy("k").orderBy("i"), 2).alias("f")).orderBy("i").select("f").collect()]
    assert future == [2.0, 3.0, 3.0, 4.0, 4.0, None]


def test_arrays(spark):
    got = one_array(spark, [3.0, None, 1.0, 2.0]).select(arrays.mean(F.col("x")), arrays.variance(F.col("x")), arrays.median(F.col("x")), arrays.share(F.col("x"), lambda v: v > 1), arrays.streak(F.col("x"), lambda v: v > 0)).first()
    assert got[:] == (2.0, 1.0, 2.0, 0.5, 2.0)
    assert one_array(spark, []).select(arrays.mean(F.col("x")), arrays.median(F.col("x")), arrays.share(F.col("x"), lambda v: v > 1)).first()[:] == (None, None, None)


def test_sets(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "z")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in sets.keep_last(df, ["k"], F.col("o")).collect()} == {("a", None), ("b", "z")}
    assert [r["k"] for r in sets.distinct_in_order(df, ["k"], -F.col("o")).orderBy("place").collect()] == ["a", "b"]


def test_registry_names():
    assert registry.window_minutes("90m") == 90 and registry.window_minutes("4h") == 240 and registry.window_minutes("7d") == 10080 and registry.window_minutes("15") == 15
    with pytest.raises(ValueError):
        registry.window_minutes("soon")
    assert not registry.is_signal("macd_signal_1h") and registry.is_signal("macd_histogram_1h") and not registry.is_signal("window_ok_1h")
    assert (registry.transform_kind("rv_close_1h_mag"), registry.transform_kind("atr_1h"), registry.transform_kind("dist_to_window_low_4h_dir")) == ("positive", "plain", "signed")
    assert registry.neutral_value("roc_4h_over_24h_dir", "core").value == 0 and registry.neutral_value("roc_4h_over_24h_dir", "state").value == 1
    assert registry.neutral_value("metrics_valid_vwap_1h") is None and registry.neutral_value("metrics_valid_vwap_1h", "regime").value == 0
    assert registry.describe_column("rv_close_1h_over_4h_mag")["tag"] == "mag" and registry.describe_column("bb_position_1h_pos") == {"family": "bb_position", "window": "1h", "tag": "pos"}


def test_interpolation(spark):
    xs = [F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(4.0)]
    for x in (0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0):
        want = np.interp(x, [1, 2, 2, 4], [10, 20, 30, 40], left=1, right=99)
        assert spark.range(1).select(scalar.interpolate(F.lit(x), xs, [10.0, 20.0, 30.0, 40.0], 1.0, 99.0)).first()[0] == pytest.approx(want)


def test_enrichment_of_a_flat_baseline(spark):
    long = spark.createDataFrame([("A", "roc_24h", 2.0)] * 4, "symbol string, metric string, value double")
    e = baseline.enrich(long.limit(1), baseline.build_baseline(long), ["roc_24h"]).first()
    assert (e["pctile"], e["quintile"], e["direction"], e["rz"], e["n"]) == (50.0, 1, "over", 0.0, 4)


def test_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Ticker,DateTime,Open,High,Low,Close,Qty\nA,2024-01-01 00:00:00,1,2,0.5,1.5,9\nA,not a time,1,1,1,1,1\nB,2024-01-01 01:00:00,x,2,NaN,1.5,9\n")
    rows = src.read_csv_bars(spark, str(tmp_path / "b.csv")).orderBy("symbol").collect()
    assert [(r["symbol"], r["open"], r["low"], r["volume"]) for r in rows] == [("A", 1.0, 0.5, 9.0), ("B", None, None, 9.0)]
    with pytest.raises(ValueError, match="close"):
        src.normalize_columns(spark.createDataFrame([("a",)], "symbol string"), ["symbol", "close"])
    (tmp_path / "d.txt").write_text("AAA, 12.5, 3.1\nBBB, NA, NA\n")
    assert [tuple(r) for r in src.read_dominant_cycles(spark, str(tmp_path / "d.txt")).orderBy("symbol").collect()] == [("AAA", 12.5, 3.1), ("BBB", None, None)]
    assert [r["symbol"] for r in src.leaders(spark, ["X", "A", "X"], spark.createDataFrame([("A",), ("B",)], "Sym string")).orderBy("place").collect()] == ["A", "B", "X"]
    doc = json.dumps({"A": {"24h": {"gmm": [{"cluster": 0, "count": 3, "median_amplitude_pct": 2.0, "median_duration_min": 5.0, "small": True}, {"cluster": 1, "count": 9, "median_amplitude_pct": 4.0, "median_duration_min": 6.0, "small": False}], "dbscan": []}}})
    clusters = src.read_cluster_summary(spark.createDataFrame([(doc,)], "j string"), F.col("j"))
    assert rules.dominant_cluster(clusters).first()["median_amplitude_pct"] == 4.0


def test_exchange_documents(spark):
    docs = spark.createDataFrame([(json.dumps({"error": [], "result": {"XXBTZUSD": {"wsname": "BTC/USD"}, "ETHEUR": {"wsname": "ETH/EUR"}}}),)], "j string")
    assert [r["pair"] for r in src.quoted_in(docs, F.col("j")).collect()] == ["XXBTZUSD"]
    with pytest.raises(Exception, match="exchange error"):
        src.quoted_in(spark.createDataFrame([('{"error": ["EGeneral:Internal error"]}',)], "j string"), F.col("j")).collect()
    ticks = spark.createDataFrame([(json.dumps({"BTCUSD": {"o": "10", "c": ["8", "1"], "v": ["1", "20000"]}, "USDTUSD": {"o": "1", "c": ["0.5"], "v": ["1", "90000"]}, "ZERO": {"o": "0", "c": ["1"], "v": ["1", "1"]}, "BAD": {"o": "x", "c": [], "v": []}}),)], "j string")
    got = leaderboard.ticker_losers(src.parse_ticker(ticks, F.col("j")), 100).collect()
    assert [(r["symbol"], r["pct_change"]) for r in got] == [("BTCUSD", -20.0)]
    assert leaderboard.ticker_losers(src.parse_ticker(ticks.limit(0), F.col("j"))).count() == 0


def test_exchange_calls():
    asked = []

    def fetch(url):
        asked.append(url)
        return json.dumps({"error": [], "result": {p: {"o": "1"} for p in url.split("pair=")[1].split(",")}})

    assert len(exchange.fetch_tickers([f"P{i}" for i in range(250)], "u", fetch)) == 250 and len(asked) == 3
    with pytest.raises(RuntimeError, match="Internal"):
        exchange.call("u", lambda _: '{"error": ["EGeneral:Internal error"]}')

    def broken(_):
        raise OSError("no route")

    with pytest.raises(RuntimeError, match="no route"):
        exchange.call("u", broken)


def test_path_resolver(tmp_path):
    (tmp_path / "Overlaps.csv").write_text("x")
    assert exchange.resolve_path("overlaps.CSV", str(tmp_path)).endswith("Overlaps.csv") and exchange.resolve_path("overlap.csv", str(tmp_path)).endswith("Overlaps.csv")
    with pytest.raises(FileNotFoundError):
        exchange.resolve_path("zzz.parquet", str(tmp_path))


def test_sinks(spark, tmp_path):
    snap = spark.createDataFrame([("A", at(0), 1.0), ("B", at(30), 2.0)], "symbol string, timestamp_asof_utc timestamp_ntz, roc_1h double")
    sinks.write_snapshot(snap, str(tmp_path / "s"))
    sinks.write_snapshot(snap.where("symbol = 'B'"), str(tmp_path / "s"), compression="zstd")
    assert spark.read.parquet(str(tmp_path / "s")).where("dt = '2024-01-02'").count() == 1 and spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert json.loads(sinks.schema_sidecar(snap))["roc_1h"] == {"dtype": "double", "family": "roc", "window": "1h", "tag": None}
    assert not sinks.write_csv(snap.limit(0), str(tmp_path / "c"), skip_empty=True) and sinks.write_csv(snap, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert sinks.cards_json(snap, "symbol").count() == 2


def test_splits(spark):
    b = spark.createDataFrame([("A", at(i)) for i in range(100)] + [("B", at(i)) for i in range(100)], "symbol string, ts timestamp_ntz")
    parts = {s: sorted({r["ts"] for r in ds.split_time(b, embargo="5 hours").where(F.col("split") == s).collect()}) for s in ("train", "val", "test")}
    assert parts["train"][-1] == at(65) and parts["val"][0] == at(71) and parts["val"][-1] == at(80) and parts["test"][0] == at(86)
    assert {r["split"]: r["count"] for r in ds.split_time(b.where(F.col("ts") < F.lit(at(5)))).groupBy("split").count().collect()} == {"train": 7, "val": 1, "test": 2}
    folds = ds.purged_folds(b, 3, "5 hours")
    for k in range(3):
        val = sorted({r["ts"] for r in folds.where((F.col("fold") == k) & (F.col("role") == "val")).collect()})
        train = {r["ts"] for r in folds.where((F.col("fold") == k) & (F.col("role") == "train")).collect()}
        assert len(val) == (34 if k == 0 else 33) and all(t <= val[0] - dt.timedelta(hours=5) or t >= val[-1] + dt.timedelta(hours=5) for t in train)


def test_hygiene_and_presets(spark):
    df = spark.createDataFrame([(1, True, True), (2, None, True), (3, True, False)], "i int, window_ok_1h boolean, metrics_valid_vwap_1h boolean")
    assert [r["i"] for r in ds.hygienic(df, ["1h", "4h"]).collect()] == [1]
    wide = spark.createDataFrame([], "symbol string, open double, close double, rsi_1h double, close_lag1 double, close_lag9 double, window_coverage_1h double")
    assert ds.preset_columns(wide, "max", ["1h"], 3) == ["close", "rsi_1h", "close_lag1"] and ds.preset_columns(wide, "min", ["1h"], 3) == ["close_lag1", "rsi_1h"]
    assert ds.pick_features(["b", "a", "a", "c1"], "^[ab]", "b") == ["a"]


def test_attach_metrics_keeps_windows_apart(spark):
    b = spark.createDataFrame(make_bars(30), BAR)
    series = spark.createDataFrame([("A", "1h", at(5), 1.0, None), ("A", "4h", at(8), None, 4.0)], "symbol string, window string, window_end timestamp_ntz, roc_1h double, roc_4h double")
    got = {r["ts"]: (r["roc_1h"], r["roc_4h"]) for r in ds.attach_metrics(b, series, ["1h", "4h"]).collect()}
    assert got[at(4)] == (None, None) and got[at(6)] == (1.0, None) and got[at(9)] == (1.0, 4.0)


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1)], "y int, g int, s double")
    r = scoring.binary_scores(df, "y", "g", "s").first()
    assert r["f1"] == 0.5 and r["roc_auc"] == pytest.approx((3 + 1 + 0.5) / 6) and r["pr_auc"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 4)
    table = {round(x["tau"], 2): x["f1"] for x in scoring.threshold_table(df, "y", "s", [0.05, 0.5, 0.95]).collect()}
    assert table[0.95] == 0 and table[0.05] == pytest.approx(4 / 7)
    assert scoring.macro_curves(df.select("y", (1 - F.col("s")).alias("p0"), F.col("s").alias("p1")), "y", ["p0", "p1"]).first()["roc_auc_macro"] == pytest.approx(0.75)
    assert scoring.cv_summary(spark.createDataFrame([(1.0,), (3.0,)], "m double"), ["m"]).first()[:] == (2.0, 1.0)


def test_models_and_artifacts(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(a + 0.1 * b > 0)) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    task = models.Task("binary", ("a", "b"), weight="weight")
    model = models.build("rf", task, "light", trees=10, depth=3).fit(models.with_class_weight(df, "label"))
    out = models.predict(model, df, task, ["label"])
    assert out.where("label = prediction").count() > 280 and out.where("prob < 0 OR prob > 1").count() == 0
    assert list(json.loads(models.importances(model, task.features))) == ["a", "b"]
    score = lambda p: p.where("label = prediction").count() / 300
    fall = models.permutation_importance(model, df.withColumn("weight", F.lit(1.0)), task, score)
    assert fall["a"] > 0.2 > abs(fall["b"])
    models.save_artifacts(model, str(tmp_path / "m"), task.features, {"f1": 1.0}, {"seed": 1})
    loaded, notes = models.load_artifacts(spark, str(tmp_path / "m"))
    assert notes["features_used"] == "a\nb" and loaded.transform(df).where("label = prediction").count() > 280
    assert models.missing_features(df, ["a", "z"]) == ["z"] and models.positive_weight(df, "label").first()[0] > 0
    for method in ("platt", "isotonic"):
        assert models.calibrate(out, "prob", "label", method).transform(out).count() == 300
    with pytest.raises(ValueError):
        models.build("none", task)
    assert models.config_hash({"b": 1, "a": 2}) == models.config_hash({"a": 2, "b": 1})


def test_modes_add_up():
    t = np.arange(400)
    x = np.sin(t / 3) + 2 * np.sin(t / 20) + 0.01 * t
    modes, rest = decompose.emd(x)
    assert np.allclose(modes.sum(axis=0) + rest, x) and len(modes) >= 2
    _, _, period = decompose.analytic(modes[0])
    assert np.median(period) == pytest.approx(2 * np.pi * 3, rel=0.1)
    a = decompose.ceemdan(x, trials=5)
    b = decompose.ceemdan(x, trials=5)
    assert np.allclose(a[0], b[0]) and np.allclose(a[0].sum(axis=0) + a[1], x)
    assert decompose.emd(np.ones(50))[0].shape == (0, 50)


def test_spline_and_detrend():
    xs = np.asarray([0.0, 1, 2, 3.5, 5])
    line = decompose.spline(xs, 2 * xs + 1, np.linspace(0, 5, 30))
    assert np.allclose(line, 2 * np.linspace(0, 5, 30) + 1)
    y = 3.0 * np.arange(100) + 5
    y[50] += 1000
    rest = decompose.detrend(y)
    assert np.allclose(np.delete(rest, 50), 0, atol=1e-6)


def test_clusterings():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(3, 0.1, (30, 2))])
    truth = np.repeat([0, 1], 30)
    same = lambda labels: len({(a, b) for a, b in zip(labels, truth)}) == 2
    assert same(cluster.best_mixture(x, 2)) and same(cluster.kmeans(x, 2)) and same(cluster.hdbscan(x, 8))
    got = cluster.best_dbscan(x)
    assert len(set(got) - {-1}) == 2
    assert cluster.silhouette(cluster.distances(x), truth) > 0.9
    assert cluster.ward_1d(np.asarray([1.0, 1.01, 2.0, 2.02, 5.0])).tolist() == [0, 0, 1, 1, 2]
    assert cluster.global_clusters(x[:2]).tolist() == [0, 0]


def test_stage_features_of_a_clean_wave(spark):
    rows = [("A", at(i), 0.0, 0.0, 0.0, 100 + 10 * math.sin(i / 4), 50 + 20 * math.sin(i / 4 + 0.5)) for i in range(300)]
    out = imf.stage_features(spark.createDataFrame(rows, BAR), imf.StageConfig(trials=4)).collect()
    best = max((r for r in out if r["series"] == "price"), key=lambda r: r["energy_share"])
    assert best["period_days"] == pytest.approx(2 * math.pi * 4 / 24, rel=0.15) and best["amp_pct"] > 10


def test_rules_config():
    assert rules.configure({"adx_min": 30.0}).adx_min == 30.0
    with pytest.raises(KeyError):
        rules.configure({"adx": 1})


def test_streams(spark, tmp_path):
    rows = make_bars(40, 7) + make_bars(40, 8, symbol="B")
    spark.createDataFrame(rows, BAR).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(BAR).parquet(str(tmp_path / "in"))
    from tickloom.plans.learning import run_stream

    ema = run_stream(spark, stream.stream_ewm(source(), 5)).orderBy("ts").toPandas()
    for s in "AB":
        close = pd.Series([r[5] for r in rows if r[0] == s])
        assert np.allclose(ema[ema.symbol == s].ema.to_numpy(), close.ewm(span=5, adjust=False).mean().to_numpy())
    assert run_stream(spark, stream.stream_latest(source(), ["symbol"])).count() == 80


def test_smoothed_streams_count_every_bar_of_a_time(spark, tmp_path):
    """Three copies of each event, as DuckDB smooths them; and bars that come in a later batch."""
    import duckdb

    from tickloom.plans import learning

    rows = [(k * 100 + i, at(i), f"type{i % 2}", float(i * 37 % 11) + 0.25) for k in range(3) for i in range(20)]
    (tmp_path / "d").mkdir()
    pd.DataFrame(rows, columns=["event_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "d" / "events.parquet")
    want = duckdb.connect().sql(learning.SQL["stream_ewm"].replace("FROM events", f"FROM '{tmp_path}/d/events.parquet'")).fetchall()
    got = learning.q_stream_ewm(spark, str(tmp_path / "d")).collect()
    assert len(got) == 60 and sorted(map(tuple, got)) == sorted(want)

    source = lambda: spark.readStream.schema(BAR).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, hours in enumerate([(0, 1), (1, 2), (0, 2)]):
        made = [("A", at(h), 0.0, 0.0, 0.0, float(10 * k + h), 0.0) for h in hours]
        spark.createDataFrame(made, BAR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from tickloom.plans.learning import run_stream

    assert sorted(r["ts"] for r in run_stream(spark, stream.stream_ewm(source(), 5)).collect()) == [at(0), at(1), at(1), at(2), at(2)]


def test_sql_functions(spark):
    scalar.register_sql(spark)
    assert spark.sql("SELECT tl_price_at(100, 8), tl_amplitude_band(5), tl_amplitude_band(NULL), tl_signed_log(-1)").first()[:3] == (108.0, "medium", "unknown")


def test_jobs_from_bars_to_signals(spark, tmp_path):
    from tickloom.plans import jobs

    rows = [r for k, s in enumerate("AB") for r in make_bars(24 * 20, 20 + k, symbol=s)]
    b = spark.createDataFrame(rows, BAR)
    asof = F.lit(at(24 * 20)).cast("timestamp_ntz")
    found = jobs.run_leaderboards(b, str(tmp_path / "l"))
    assert set(found) == {"losers", "gainers", "overlaps"} and spark.read.json(str(tmp_path / "l" / "overlaps_summary")).count() == 2
    state = jobs.state_snapshot(b, str(tmp_path / "s"), sizes=(24,), every="1 hour", bar_hours=1.0, compare=("roc", "rsi", "rv_close"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2 and {"roc_24h_pctile", "roc_24h_imputed"} <= set(state.columns)
    context = jobs.regime_job(b, str(tmp_path / "r"), asof, (7,))
    jobs.imf_job(b, str(tmp_path / "i"), asof, 1, "1 hour", imf.StageConfig(trials=2))
    assert spark.read.parquet(str(tmp_path / "i" / "summary")).select("symbol").distinct().count() == 2
    jobs.rules_job(state, str(tmp_path / "x"), context.withColumns({"ma50_slope_30d_dir": F.lit(1.0), "ma200_slope_90d_dir": F.lit(1.0), "above_ma50_share_30d_pos": F.lit(1.0)}), overrides={"timeframes": ("24h",)})
    assert (tmp_path / "x" / "signals").exists()


def test_train_and_predict_jobs(spark, tmp_path):
    from tickloom.plans import jobs

    b = spark.createDataFrame([r for k, s in enumerate("AB") for r in make_bars(400, 30 + k, symbol=s)], BAR)
    spec = ds.DatasetSpec(lags=2, preset="min")
    result = jobs.train_job(b, str(tmp_path), spec, horizon=3, bps=50, model="logreg", embargo="5 hours", folds=2, rounds=10)
    assert set(result) == {"cv", "test", "threshold"} and 0 <= result["test"]["roc_auc"] <= 1
    df, _ = ds.build_dataset(b, spec)
    assert jobs.predict_job(df, str(tmp_path / "artifacts"), str(tmp_path / "p")).count() == df.count()
    with pytest.raises(ValueError, match="close_lag1"):
        jobs.predict_job(df.drop("close_lag1"), str(tmp_path / "artifacts"), str(tmp_path / "p"))
    assert json.loads(jobs.run_config(seed=1))["seed"] == 1


def test_predictions_come_for_every_row(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), float(i > 20)) for i in range(40)], "a double, b double, label double")
    odd = df.unionByName(spark.createDataFrame([(None, 1.0, 0.0), (float("nan"), 1.0, 0.0), (30.0, None, 1.0)], "a double, b double, label double"))
    for name in ("rf", "hgbt", "logreg"):
        task = models.Task("binary", ("a", "b"))
        out = models.predict(models.build(name, task, trees=5, depth=3, rounds=3).fit(odd), odd, task, ["a", "b"]).collect()
        assert len(out) == 43
        assert sum(r["prediction"] is None and r["prob"] is None for r in out) == 3 and all(0 <= r["prob"] <= 1 for r in out if r["prob"] is not None)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tickloom import store

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        store.shared_dir(bare)


def test_places_and_curves_do_not_need_one_task(spark):
    from tickloom.ml import scoring
    from tickloom.operators import sets

    rows = [(i * 7919 % 1000, i) for i in range(1000)] + [(5, 2000)]
    df = spark.createDataFrame(rows, "k bigint, t bigint").repartition(6)
    wanted = {k: p for p, k in enumerate(dict.fromkeys(k for k, t in sorted(rows, key=lambda r: r[1])))}
    assert {r["k"]: r["place"] for r in sets.distinct_in_order(df, ["k"], F.col("t")).collect()} == wanted
    assert sets.distinct_in_order(df.limit(0), ["k"], F.col("t")).count() == 0
    scores = spark.createDataFrame([(i % 3 == 0, (i * 31 % 97) / 97) for i in range(600)], "y boolean, s double").select(F.col("y").cast("int").alias("y"), "s")
    found = scoring.binary_scores(scores, "y", "y", "s").first()
    plain = [(r["y"], r["s"]) for r in scores.collect()]
    good, bad = ([s for y, s in plain if y == v] for v in (1, 0))
    assert found["roc_auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad))
