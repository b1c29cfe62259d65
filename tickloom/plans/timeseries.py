"""Queries on grids, time joins, cross sections, labels, splits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.fold import robust_scaled
from tickloom.ml import dataset as ds
from tickloom.ml import scoring
from tickloom.operators import cycles, grid, sets
from tickloom.operators.analytic import rolling
from tickloom.operators.joins import asof_backward, asof_with_gap, nearest
from tickloom.plans.tables import BARS_D, BARS_H, bars_d, bars_h, table

def r6(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _grid(spark, d):
    return grid.fill_bars(grid.on_grid(bars_h(spark, d), "1 hour"))


def q_ohlcv_resample(spark, d):
    return grid.resample(bars_h(spark, d), "6 hours").select("symbol", "ts", *r6("open", "high", "low", "close", "volume"))


def q_ohlcv_grid_ffill(spark, d):
    return _grid(spark, d).select("symbol", "ts", *r6("open", "high", "low", "close", "volume"))


def _views(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").select("user_id", "ts", "event_id")


def q_asof_backward(spark, d):
    bought = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("bought_at")).agg(F.max("event_id").alias("purchase_id"), F.max_by("value", "event_id").alias("paid"))
    out = asof_backward(_views(spark, d), bought, ["user_id"], "ts", "bought_at", bucket=7 * 86_400)
    return out.select("event_id", "user_id", "ts", F.col("match.bought_at").alias("bought_at"), F.col("match.purchase_id").alias("purchase_id"), F.round("match.paid", 6).alias("paid"))


def q_asof_gap_guard(spark, d):
    base = table(spark, d, "events").where("event_type = 'click'").select(F.col("ts").alias("base_ts"), F.col("value").alias("base"))
    base = base.groupBy("base_ts").agg(F.max("base").alias("base"))
    out = asof_with_gap(_views(spark, d), base, "ts", "base_ts", 900, "ffill")
    return out.select("event_id", F.col("match.base_ts").alias("base_ts"), F.round("match.base", 6).alias("base"))


def q_nearest_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("k"), F.col("o_orderdate").alias("ts"))
    daily = table(spark, d, "orders").where("day(o_orderdate) IN (1, 11, 25)").groupBy(F.col("o_orderstatus").alias("k"), F.col("o_orderdate").alias("snap_ts")).agg(F.count(F.lit(1)).alias("n"))
    out = nearest(o, daily, ["k"], "ts", "snap_ts", 3 * 86_400)
    return out.select("o_orderkey", F.col("match.snap_ts").alias("snap_ts"), F.col("match.n").alias("n"))


def _cycles(spark, d, least=None):
    b = bars_h(spark, d)
    return b, cycles.peak_cycles(b, ["symbol"], "ts", "close", "close", least), cycles.peak_cycles(b, ["symbol"], "ts", "volume")


def q_peaks_cycles(spark, d):
    return _cycles(spark, d)[1].select("symbol", "start_time", "end_time", *r6("amplitude_pct"), "duration_min")


def q_interval_overlap_sum(spark, d):
    b, price, volume = _cycles(spark, d, 2.0)
    return cycles.fuse_cycles(price, volume, b).select("symbol", "start_time", "end_time", *r6("amplitude_pct", "total_volume"))


def q_extrema_brackets(spark, d):
    return cycles.extrema_brackets(_grid(spark, d), ["symbol"], "ts", "close").select("symbol", "a", "b", "c", *r6("depth_pct"))


def q_circular_variance(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.groupBy("l_returnflag").agg(F.round(cycles.circular_variance(F.col("l_quantity") / 10), 6).alias("circular_variance"))


def q_robust_scale(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity")  # noqa: E741
    return robust_scaled(l, ["l_returnflag"], ["l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", *r6("l_extendedprice_scaled", "l_quantity_scaled"))


def q_cross_section_rank(spark, d):
    g = _grid(spark, d)
    top = ds.with_cross_section(g, ["close", "high"], ds.universe(g, "volume", top=3))
    pct = ds.with_cross_section(g, ["close"], ds.universe(g, "volume", percentile=40)).select("symbol", "ts", F.col("in_universe").alias("in_pct"), F.col("rank_close").alias("rank_pct_close"))
    return top.join(pct, ["symbol", "ts"]).select("symbol", "ts", "in_universe", "in_pct", *r6("rank_close", "z_close", "rank_high", "z_high", "rank_pct_close", digits=5))


def q_lags_calendar(spark, d):
    x = ds.with_calendar(ds.with_lags(ds.with_returns(bars_h(spark, d)), ["close", "volume", "ret_1m"], 2), True)
    return x.select("symbol", "ts", *r6("ret_1m", "close_lag1", "close_lag2", "volume_lag1", "volume_lag2", "ret_1m_lag1", "ret_1m_lag2"), *big("minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "month"))


def q_labels_return_direction(spark, d):
    x = bars_h(spark, d)
    return x.select("symbol", "ts", F.round(ds.labels("price", 4), 6).alias("price_4"), F.round(ds.labels("return", 4), 6).alias("return_4"), ds.labels("direction", 4, 500).cast("bigint").alias("dir3"), ds.labels("direction", 4, 500, 2).cast("bigint").alias("dir2"), ds.labels("direction", 4, 500, 3, True).cast("bigint").alias("dir3_compat"))


def q_label_price(spark, d):
    return bars_h(spark, d).select("symbol", "ts", F.round(ds.labels("price", 4), 6).alias("price_4"))


def q_training_cuts(spark, d):
    train = ds.with_returns(bars_h(spark, d)).where("ts < '2024-01-20'")
    cuts = ds.training_thresholds(train, {"low_volume": (F.col("volume"), 30), "spike_ret": (F.abs("ret_1m"), 97), "spike_close": (F.col("close"), 99.5)})
    return spark.createDataFrame([(n, round(x, 6)) for n, x in cuts.items()], "name string, cut double")


def q_hygienic(spark, d):
    """Flags made of the bars: a window is covered with two events or more, unknown at midnight, and valid if it closes below its open."""
    flags = {"window_ok_1h": F.when(F.hour("ts") > 0, (F.col("volume") >= 2).cast("int")), f"metrics_valid_{ds.VALIDITY[0]}_1h": F.col("close") < F.col("open")}
    return ds.hygienic(bars_h(spark, d).withColumns(flags), ["1h", "4h"]).select("symbol", "ts", "volume")


def q_labels_vol_event(spark, d):
    x = ds.with_returns(bars_h(spark, d)).withColumn("width", rolling(F.stddev_samp, F.col("close"), ds.by_symbol(), 12, 12))
    train = x.where("ts < '2024-01-20'")
    cut = ds.training_thresholds(train, {"squeeze_low": (F.col("width"), 30), "spike_ret": (F.abs("ret_1m"), 97)})
    event = lambda *a, **k: ds.event_label(*a, thresholds=cut, **k)
    return x.select("symbol", "ts", F.round(ds.labels("vol", 6), 5).alias("vol_6"), F.round(ds.labels("vol", 6, compat=True), 5).alias("vol_6_compat"), event("breakout", 6, 12).alias("breakout"), event("squeeze", 6, column="width").alias("squeeze"), event("spike", 6).alias("spike"))


def q_spread_vol(spark, d):
    x = ds.with_spreads(bars_h(spark, d), "view", mode="ffill", max_gap=7200, rows=12, least=6)
    return x.select("symbol", "ts", *r6("spread_close", "spread_vol_1h", digits=5))


def q_time_split(spark, d):
    return ds.split_time(bars_h(spark, d).select("symbol", "ts"), embargo="6 hours")


def q_purged_kfold(spark, d):
    return ds.purged_folds(bars_h(spark, d).select("symbol", "ts"), 4, "6 hours").select("symbol", "ts", *big("fold"), "role")


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.round(1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0)), 2)).alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").withColumn("guess", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def q_score_metrics(spark, d):
    s = _scored(spark, d)
    parts = scoring.binary_scores(s, "y", "guess", "score").join(scoring.regression_scores(s, "y", "score")).join(scoring.macro_f1(s, "y", "guess"))
    return parts.select(*r6("f1", "mcc", "roc_auc", "pr_auc", "brier", "mae", "rmse", "r2", "f1_macro"))


TAUS = [round(0.05 * k, 2) for k in range(1, 20)]


def q_threshold_search(spark, d):
    return scoring.threshold_table(_scored(spark, d), "y", "score", TAUS).select("tau", *r6("f1", "mcc"))


def q_best_threshold(spark, d):
    return scoring.best_threshold(scoring.threshold_table(_scored(spark, d), "y", "score", TAUS), "mcc").select("tau", *r6("f1", "mcc"))


def q_expected_value(spark, d):
    return scoring.expected_value(_scored(spark, d), "score", TAUS, F.col("y") - 0.5, 0.01).select("tau", *r6("ev"))


def q_dense_rolling(spark, d):
    """Trailing 24-hour windows (t - W, t] of every bar: time frames, so that gaps do not stretch them."""
    b = bars_h(spark, d).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("symbol").orderBy("s").rangeBetween(1 - 86_400, 0)
    n = F.count(F.lit(1)).over(w)
    ok = n >= 19
    part = lambda f, c: F.when(ok, f(c).over(w))
    out = b.select("symbol", "ts", (n / 24).alias("window_coverage"), ok.alias("window_ok"), part(F.avg, "close").alias("close_mean"), part(F.stddev_samp, "close").alias("close_stddev"), part(F.min, "close").alias("close_min"), part(F.max, "close").alias("close_max"), part(F.sum, "volume").alias("volume_sum"))
    return out.select("symbol", "ts", *r6("window_coverage"), "window_ok", *r6("close_mean", "close_stddev", "close_min", "close_max", "volume_sum", digits=5))


def q_dedupe_keep_last(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return sets.keep_last(e, ["user_id", "event_type"], F.struct("ts", "event_id"))


def q_union_by_name(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'view'").select("event_id", "value")
    return sets.union_all(a, e.where("event_type = 'error'").select("event_id", "user_id"))


def q_distinct_keys(spark, d):
    e = table(spark, d, "events")
    return sets.distinct_in_order(e, ["user_id"], F.struct("ts", "event_id")).select("user_id", *big("place"))


def q_window_filter(spark, d):
    """Bars of windows that hold enough of their bars."""
    out = grid.windowed(bars_h(spark, d), "12 hours", 12)
    return out.select("symbol", "ts", "window_start", *big("window_bars"))


def q_fixed_universe(spark, d):
    b = bars_d(spark, d).where("ts < '1999-01-01'")
    return ds.fixed_universe(b, "volume", top=4).select("symbol", *r6("median"))


def q_dataset_min(spark, d):
    """Complete rows of lag features after cross-section and calendar."""
    df, features = ds.build_dataset(bars_h(spark, d), ds.DatasetSpec(lags=2, preset="min", include="close|ret", cross_section=("close",)))
    return df.select("symbol", "ts", *r6(*features))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_GRID = BARS_H + """,
    times AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY symbol),
    grid AS (SELECT * FROM times LEFT JOIN bars USING (symbol, ts)),
    filled AS (SELECT symbol, ts, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low,
        last_value(close IGNORE NULLS) OVER w AS close, coalesce(volume, 0) AS volume FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def _peaks_sql(value: str, source: str, name: str, ref: str) -> str:
    """CTEs that end in {name}(symbol, ts, x) with plateau peaks of a value."""
    return f"""{name}_r AS (SELECT symbol, ts, {value} AS x, {ref} AS ref, row_number() OVER w AS i, CASE WHEN lag({value}) OVER w IS NOT DISTINCT FROM {value} THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    {name}_g AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY i) AS run FROM {name}_r),
    {name}_s AS (SELECT symbol, run, any_value(x) AS x, min(i) AS a, max(i) AS b FROM {name}_g GROUP BY ALL),
    {name}_t AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM {name}_s WINDOW w AS (PARTITION BY symbol ORDER BY run)),
    {name} AS (SELECT r.symbol, r.ts, r.x, r.ref FROM {name}_r r JOIN {name}_t t ON r.symbol = t.symbol AND r.i = (t.a + t.b) // 2 WHERE t.x > t.p AND t.x > t.q)"""


_CYCLES = f"""{BARS_H}, {_peaks_sql('close', 'bars', 'pp', 'close')}, {_peaks_sql('volume', 'bars', 'vp', 'volume')},
    pc AS (SELECT symbol, ts AS start_time, lead(ts) OVER w AS end_time, (lead(ref) OVER w - ref) / nullif(ref, 0) * 100 AS amplitude_pct FROM pp WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    vc AS (SELECT symbol, ts AS vs, lead(ts) OVER w AS ve, (lead(x) OVER w - x) / nullif(abs(x), 0) * 100 AS amplitude_pct FROM vp WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
_SCORED = """s AS (SELECT round(1 / (1 + exp(-(n_chars - 1500) / 1000.0::DOUBLE)), 2) AS score, quality AS y FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS guess FROM s)"""
_F1 = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"
_MCC = "coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE), 0), 0)"
_TAUS = f"""{_SCORED}, taus AS (SELECT round(0.05::DOUBLE * k, 2) AS tau FROM range(1, 20) t(k)),
    c AS (SELECT tau, count(*) FILTER (y = 1 AND score >= tau) AS tp, count(*) FILTER (y = 0 AND score >= tau) AS fp, count(*) FILTER (y = 1 AND score < tau) AS fn, count(*) FILTER (y = 0 AND score < tau) AS tn FROM g, taus GROUP BY tau),
    m AS (SELECT tau, {_F1} AS f1, {_MCC} AS mcc FROM c)"""
_RET = BARS_H + """,
    x AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close) - ln(lag(close) OVER w) END AS ret_1m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""

SQL = {
    "ohlcv_resample": f"""WITH {BARS_H} SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, round(min_by(open, bars.ts), 6) AS open, round(max(high), 6) AS high,
        round(min(low), 6) AS low, round(max_by(close, bars.ts), 6) AS close, round(sum(volume), 6) AS volume FROM bars GROUP BY symbol, 2""",
    "ohlcv_grid_ffill": f"WITH {_GRID} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM filled",
    "asof_backward": """WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'),
        p AS (SELECT user_id, ts AS bought_at, max(event_id) AS purchase_id, max_by(value, event_id) AS paid FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
        SELECT event_id, v.user_id, ts, bought_at, purchase_id, round(paid, 6) AS paid FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.bought_at""",
    "asof_gap_guard": """WITH v AS (SELECT ts, event_id FROM events WHERE event_type = 'view'), b AS (SELECT ts AS base_ts, max(value) AS base FROM events WHERE event_type = 'click' GROUP BY 1),
        j AS (SELECT event_id, ts, base_ts, base FROM v ASOF LEFT JOIN b ON v.ts >= b.base_ts)
        SELECT event_id, CASE WHEN ts - base_ts <= INTERVAL 900 SECOND THEN base_ts END AS base_ts, CASE WHEN ts - base_ts <= INTERVAL 900 SECOND THEN round(base, 6) END AS base FROM j""",
    "nearest_join": """WITH s AS (SELECT o_orderstatus AS k, o_orderdate AS snap_ts, count(*) AS n FROM orders WHERE day(o_orderdate) IN (1, 11, 25) GROUP BY 1, 2),
        near AS (SELECT o_orderkey, o_orderstatus AS k, snap_ts, n, abs(epoch(o_orderdate) - epoch(snap_ts)) AS away, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(epoch(o_orderdate) - epoch(snap_ts)), snap_ts) AS r
            FROM orders JOIN s ON o_orderstatus = k QUALIFY r = 1),
        late AS (SELECT k, max(snap_ts) AS l_ts, max_by(n, snap_ts) AS l_n FROM s GROUP BY k)
        SELECT o.o_orderkey, CASE WHEN away <= 259200 THEN snap_ts ELSE l_ts END AS snap_ts, CASE WHEN away <= 259200 THEN n ELSE l_n END AS n
        FROM orders o LEFT JOIN near USING (o_orderkey) LEFT JOIN late ON o.o_orderstatus = late.k""",
    "peaks_cycles": f"WITH {_CYCLES} SELECT symbol, start_time, end_time, round(amplitude_pct, 6) AS amplitude_pct, (epoch(end_time) - epoch(start_time)) / 60 AS duration_min FROM pc WHERE end_time IS NOT NULL AND amplitude_pct IS NOT NULL",
    "interval_overlap_sum": f"""WITH {_CYCLES}, v AS (SELECT * FROM vc WHERE ve IS NOT NULL AND amplitude_pct <> 0),
        pairs AS (SELECT pc.*, vs, ve FROM pc JOIN v ON pc.symbol = v.symbol AND (vs BETWEEN start_time AND end_time OR ve BETWEEN start_time AND end_time) WHERE end_time IS NOT NULL AND pc.amplitude_pct >= 2)
        SELECT p.symbol, start_time, end_time, round(amplitude_pct, 6) AS amplitude_pct, round(sum(volume), 6) AS total_volume FROM pairs p JOIN bars b ON b.symbol = p.symbol AND b.ts BETWEEN vs AND ve GROUP BY ALL""",
    "extrema_brackets": f"""WITH {_GRID},
        m AS (SELECT symbol, ts, close, list_sort([coalesce(lag(close) OVER w, 0), close, coalesce(lead(close) OVER w, 0)])[2] AS y FROM filled WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
        {_peaks_sql('y', 'm', 'hi', 'close')}, {_peaks_sql('-y', 'm', 'lo', 'close')},
        e AS (SELECT symbol, ts, ref, 'p' AS k FROM hi UNION ALL SELECT symbol, ts, ref, 't' FROM lo),
        t AS (SELECT symbol, ts AS a, lead(ts) OVER w AS b, lead(ts, 2) OVER w AS c, k AS k0, lead(k) OVER w AS k1, lead(k, 2) OVER w AS k2, ref AS v0, lead(ref) OVER w AS v1, lead(ref, 2) OVER w AS v2 FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts))
        SELECT symbol, a, b, c, round(greatest(coalesce(abs(v0 - v1) / nullif(abs((v0 + v1) / 2), 0) * 100, 0), coalesce(abs(v1 - v2) / nullif(abs((v1 + v2) / 2), 0) * 100, 0)), 6) AS depth_pct FROM t WHERE k0 <> k1 AND k1 <> k2""",
    "circular_variance": "SELECT l_returnflag, round(1 - sqrt(avg(cos(l_quantity / 10)) ** 2 + avg(sin(l_quantity / 10)) ** 2), 6) AS circular_variance FROM lineitem GROUP BY 1",
    "robust_scale": """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS p, quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS v FROM lineitem GROUP BY 1)
        SELECT l_orderkey, l_linenumber, round((l_extendedprice - p[2]) / CASE WHEN p[3] = p[1] THEN 1 ELSE p[3] - p[1] END, 6) AS l_extendedprice_scaled,
            round((l_quantity - v[2]) / CASE WHEN v[3] = v[1] THEN 1 ELSE v[3] - v[1] END, 6) AS l_quantity_scaled FROM lineitem JOIN q USING (l_returnflag)""",
    "cross_section_rank": f"""WITH {_GRID},
        u AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol) <= 3 AS in_universe, volume >= quantile_cont(volume, 0.4) OVER (PARTITION BY ts) AS in_pct FROM filled),
        y AS (SELECT *, CASE WHEN in_universe THEN close END AS c, CASE WHEN in_universe THEN high END AS h, CASE WHEN in_pct THEN close END AS p FROM u),
        r AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY c NULLS LAST) AS rc, count(*) OVER (PARTITION BY ts, c) AS tc, count(c) OVER t AS nc, avg(c) OVER t AS mc, stddev_samp(c) OVER t AS sc,
            rank() OVER (PARTITION BY ts ORDER BY h NULLS LAST) AS rh, count(*) OVER (PARTITION BY ts, h) AS th, count(h) OVER t AS nh, avg(h) OVER t AS mh, stddev_samp(h) OVER t AS sh,
            rank() OVER (PARTITION BY ts ORDER BY p NULLS LAST) AS rp, count(*) OVER (PARTITION BY ts, p) AS tp, count(p) OVER t AS np FROM y WINDOW t AS (PARTITION BY ts))
        SELECT symbol, ts, in_universe, in_pct, round(CASE WHEN c IS NOT NULL THEN (rc + (tc - 1) / 2) / nc END, 5) AS rank_close, round(CASE WHEN mc IS NOT NULL AND sc IS NOT NULL THEN least(greatest((close - mc) / (sc + 1e-12), -3), 3) END, 5) AS z_close,
            round(CASE WHEN h IS NOT NULL THEN (rh + (th - 1) / 2) / nh END, 5) AS rank_high, round(CASE WHEN mh IS NOT NULL AND sh IS NOT NULL THEN least(greatest((high - mh) / (sh + 1e-12), -3), 3) END, 5) AS z_high,
            round(CASE WHEN p IS NOT NULL THEN (rp + (tp - 1) / 2) / np END, 5) AS rank_pct_close FROM r""",
    "lags_calendar": f"""WITH {_RET} SELECT symbol, ts, round(ret_1m, 6) AS ret_1m, round(lag(close) OVER w, 6) AS close_lag1, round(lag(close, 2) OVER w, 6) AS close_lag2, lag(volume) OVER w AS volume_lag1, lag(volume, 2) OVER w AS volume_lag2,
        round(lag(ret_1m) OVER w, 6) AS ret_1m_lag1, round(lag(ret_1m, 2) OVER w, 6) AS ret_1m_lag2, minute(ts) AS minute_of_hour, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, month(ts) AS month
        FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "labels_return_direction": f"""WITH {BARS_H}, f AS (SELECT *, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) AS fut FROM bars), r AS (SELECT *, ln((fut + 1e-12) / (close + 1e-12)) AS r FROM f)
        SELECT symbol, ts, round(fut, 6) AS price_4, round(r, 6) AS return_4, CAST(CASE WHEN r >= 0.05 THEN 2 WHEN r <= -0.05 THEN 0 WHEN r IS NOT NULL THEN 1 END AS BIGINT) AS dir3,
            CAST(CASE WHEN r >= 0.05 THEN 1 WHEN r IS NOT NULL THEN 0 END AS BIGINT) AS dir2, CAST(CASE WHEN r >= 0.05 THEN 2 WHEN r <= -0.05 THEN 0 ELSE 1 END AS BIGINT) AS dir3_compat FROM r""",
    "label_price": f"""WITH {BARS_H} SELECT symbol, ts, round(lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts), 6) AS price_4 FROM bars""",
    "training_cuts": f"""WITH {_RET}, t AS (SELECT * FROM x WHERE ts < TIMESTAMP '2024-01-20') SELECT 'low_volume' AS name, round(quantile_cont(volume, 0.3), 6) AS cut FROM t
        UNION ALL SELECT 'spike_ret', round(quantile_cont(abs(ret_1m), 0.97), 6) FROM t UNION ALL SELECT 'spike_close', round(quantile_cont(close, 0.995), 6) FROM t""",
    "hygienic": f"""WITH {BARS_H} SELECT symbol, ts, volume FROM bars WHERE hour(ts) > 0 AND volume >= 2 AND close < open""",
    "labels_vol_event": f"""WITH {_RET}, y AS (SELECT *, CASE WHEN count(close) OVER k >= 12 THEN stddev_samp(close) OVER k END AS width FROM x WINDOW k AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
        cut AS (SELECT quantile_cont(width, 0.3) AS low, quantile_cont(abs(ret_1m), 0.97) AS jump FROM y WHERE ts < TIMESTAMP '2024-01-20'),
        z AS (SELECT *, CASE WHEN count(ret_1m) OVER f >= 4 THEN stddev_samp(ret_1m) OVER f END AS vol_6, CASE WHEN count(ret_1m) OVER c >= 4 THEN stddev_samp(ret_1m) OVER c END AS vol_6_compat,
            CASE WHEN count(high) OVER k >= 9 THEN max(high) OVER k END AS ref, max(close) OVER f AS fc, max(width) OVER f AS fw, max(abs(ret_1m)) OVER f AS fr FROM y
            WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 FOLLOWING), k AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
        SELECT symbol, ts, round(vol_6, 5) AS vol_6, round(vol_6_compat, 5) AS vol_6_compat, CASE WHEN ref IS NOT NULL THEN CAST(coalesce(fc >= ref * 1.001::DOUBLE, false) AS DOUBLE) END AS breakout,
            CASE WHEN width IS NOT NULL THEN CAST(coalesce(width <= cut.low AND fw >= width * 1.5, false) AS DOUBLE) END AS squeeze, CASE WHEN fr IS NOT NULL THEN CAST(fr >= jump AS DOUBLE) END AS spike FROM z, cut""",
    "spread_vol": f"""WITH {BARS_H}, b AS (SELECT ts AS bts, close AS base FROM bars WHERE symbol = 'view'), t AS (SELECT DISTINCT ts FROM bars),
        m AS (SELECT ts, CASE WHEN ts - bts <= INTERVAL 7200 SECOND THEN base END AS base FROM t ASOF LEFT JOIN b ON t.ts >= b.bts),
        s AS (SELECT symbol, ts, close - base AS spread_close FROM bars JOIN m USING (ts)), e AS (SELECT *, spread_close - lag(spread_close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM s)
        SELECT symbol, ts, round(spread_close, 5) AS spread_close, round(CASE WHEN count(d) OVER k >= 6 THEN stddev_samp(d) OVER k END, 5) AS spread_vol_1h FROM e WINDOW k AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "time_split": f"""WITH {BARS_H}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)),
        c AS (SELECT max(ts) FILTER (k = CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) AS t1, max(ts) FILTER (k = CAST(floor(n * 0.85::DOUBLE) AS BIGINT)) AS t2 FROM t)
        SELECT symbol, ts, CASE WHEN ts <= t1 - INTERVAL 6 HOUR THEN 'train' WHEN ts > t1 AND ts <= t2 - INTERVAL 6 HOUR THEN 'val' WHEN ts > t2 THEN 'test' END AS split FROM bars, c""",
    "purged_kfold": f"""WITH {BARS_H}, t AS (SELECT ts, ntile(4) OVER (ORDER BY ts) - 1 AS fold FROM (SELECT DISTINCT ts FROM bars)), r AS (SELECT fold, min(ts) AS a, max(ts) AS b FROM t GROUP BY fold),
        j AS (SELECT symbol, ts, fold, CASE WHEN ts BETWEEN a AND b THEN 'val' WHEN ts <= a - INTERVAL 6 HOUR OR ts >= b + INTERVAL 6 HOUR THEN 'train' END AS role FROM bars, r) SELECT * FROM j WHERE role IS NOT NULL""",
    "score_metrics": f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (y = 1 AND guess = 1) AS tp, count(*) FILTER (y = 0 AND guess = 1) AS fp, count(*) FILTER (y = 1 AND guess = 0) AS fn, count(*) FILTER (y = 0 AND guess = 0) AS tn FROM g),
        k AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM g GROUP BY 1), u AS (SELECT *, sum(p) OVER w AS ctp, sum(n) OVER w AS cfp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM k WINDOW w AS (ORDER BY score DESC)),
        a AS (SELECT sum(n * (ctp - p / 2)) / max(ap * an) AS roc_auc, sum(p / ap * ctp / (ctp + cfp)) AS pr_auc FROM u),
        e AS (SELECT avg((score - y) ** 2) AS brier, avg(abs(y - score)) AS mae, sqrt(avg((y - score) ** 2)) AS rmse, 1 - sum((y - score) ** 2) / (var_pop(y) * count(*)) AS r2 FROM g)
        SELECT round({_F1}, 6) AS f1, round({_MCC}, 6) AS mcc, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2,
            round(({_F1} + coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS f1_macro FROM c, a, e""",
    "threshold_search": f"WITH {_TAUS} SELECT tau, round(f1, 6) AS f1, round(mcc, 6) AS mcc FROM m",
    "best_threshold": f"WITH {_TAUS} SELECT tau, round(f1, 6) AS f1, round(mcc, 6) AS mcc FROM m ORDER BY m.mcc DESC, tau LIMIT 1",
    "expected_value": f"WITH {_SCORED}, taus AS (SELECT round(0.05::DOUBLE * k, 2) AS tau FROM range(1, 20) t(k)) SELECT tau, round(avg(score * (y - 0.5::DOUBLE) - 0.01::DOUBLE), 6) AS ev FROM g, taus WHERE score >= tau GROUP BY tau",
    "dense_rolling": f"""WITH {BARS_H}, r AS (SELECT symbol, ts, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s, min(close) OVER w AS lo, max(close) OVER w AS hi, sum(volume) OVER w AS v
            FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW))
        SELECT symbol, ts, round(n / 24, 6) AS window_coverage, n >= 19 AS window_ok, CASE WHEN n >= 19 THEN round(m, 5) END AS close_mean, CASE WHEN n >= 19 THEN round(s, 5) END AS close_stddev,
            CASE WHEN n >= 19 THEN round(lo, 5) END AS close_min, CASE WHEN n >= 19 THEN round(hi, 5) END AS close_max, CASE WHEN n >= 19 THEN round(v, 5) END AS volume_sum FROM r""",
    "dedupe_keep_last": "SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "union_by_name": "SELECT event_id, value, NULL::BIGINT AS user_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL, user_id FROM events WHERE event_type = 'error'",
    "distinct_keys": "WITH f AS (SELECT user_id, min({'t': ts, 'i': event_id}) AS o FROM events GROUP BY 1) SELECT user_id, row_number() OVER (ORDER BY o, user_id) - 1 AS place FROM f",
    "window_filter": f"WITH {BARS_H}, w AS (SELECT symbol, ts, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) OVER (PARTITION BY symbol, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01')) AS window_bars FROM bars) SELECT * FROM w WHERE window_bars >= 9",
    "fixed_universe": f"WITH {BARS_D} SELECT symbol, round(quantile_cont(volume, 0.5), 6) AS median FROM bars WHERE ts < TIMESTAMP '1999-01-01' GROUP BY symbol ORDER BY quantile_cont(volume, 0.5) DESC, symbol LIMIT 4",
    "dataset_min": f"""WITH {_RET}, l AS (SELECT symbol, ts, lag(close) OVER w AS a, lag(close, 2) OVER w AS b, lag(ret_1m) OVER w AS c, lag(ret_1m, 2) OVER w AS d FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts))
        SELECT symbol, ts, round(a, 6) AS close_lag1, round(b, 6) AS close_lag2, round(c, 6) AS ret_1m_lag1, round(d, 6) AS ret_1m_lag2 FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL""",
}
