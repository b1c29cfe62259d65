"""Leaderboards: disjoint windows, top movers of each, how often a symbol appears, and its profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.scalar import change
from tickloom.operators.analytic import first_rows
from tickloom.plans.tables import table
from tickloom.sources.bars import history, parse_ticker, quoted_in, recent_symbols
from tickloom.store import settle

SIZES = (6, 24, 72, 168)


def window_stats(bars: DataFrame, sizes: Sequence[int] = SIZES, ts: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """(symbol, window_hours, window_start, price_change, total_volume, pct_vol_change), percent against the
    window before among those that hold bars. Changes from 0 are infinite; 0 after 0 and firsts have no row.

    Bars go into bins of the smallest size first where all sizes are its multiples, so that the fan-out
    over sizes reads one row for each bin."""
    last = F.struct(ts, *order)
    base = min(sizes)
    if all(s % base == 0 for s in sizes):
        bars = bars.groupBy("symbol", F.window(ts, f"{base} hours")["start"].alias("__w")).agg(F.max_by("close", last).alias("close"), F.sum("volume").alias("volume"), F.max(last).alias("__last"))
        ts, last = "__w", F.col("__last")
    parts = [bars.select("symbol", F.lit(s).alias("window_hours"), F.window(F.col(ts), f"{s} hours")["start"].alias("window_start"), "close", "volume", last.alias("__o")) for s in sizes]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    stats = rows.groupBy("symbol", "window_hours", "window_start").agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("__o"))).alias("close"), F.sum("volume").alias("total_volume")).where("close IS NOT NULL AND total_volume IS NOT NULL")
    w = Window.partitionBy("symbol", "window_hours").orderBy("window_start")
    out = stats.withColumns({"price_change": change(F.col("close"), F.lag("close").over(w)) * 100, "pct_vol_change": change(F.col("total_volume"), F.lag("total_volume").over(w)) * 100})
    return out.where("price_change IS NOT NULL AND pct_vol_change IS NOT NULL").select("symbol", "window_hours", "window_start", "price_change", "total_volume", "pct_vol_change")


def top_movers(stats: DataFrame, top_n: int = 20) -> DataFrame:
    """The first ``top_n`` symbols of each window by each of four measures, with their rank. Ties go by symbol."""
    p, v = F.col("price_change"), F.col("pct_vol_change")
    one = lambda kind, move, x: F.when(x < 0, F.struct(F.lit(kind).alias("kind"), F.lit(move).alias("move"), x.alias("x")))
    measures = F.filter(F.array(one("price", "loss", p), one("price", "gain", -p), one("vol", "drop", v), one("vol", "spike", -v)), lambda m: m.isNotNull())
    rows = stats.select("symbol", "window_hours", "window_start", F.explode(measures).alias("m")).select("symbol", "window_hours", "window_start", "m.*")
    return first_rows(rows, ["window_hours", "window_start", "kind", "move"], ["x", "symbol"], top_n, "rk").drop("x")


def tallies(movers: DataFrame) -> DataFrame:
    """(symbol, bucket, n): appearances, such as price_24h_loss."""
    bucket = F.concat_ws("_", "kind", F.concat(F.col("window_hours").cast("string"), F.lit("h")), "move")
    return movers.groupBy("symbol", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def cohorts(movers: DataFrame, top_n: int = 20, sizes: Sequence[int] = SIZES) -> DataFrame:
    """(cohort, rk, symbol, score). Losers and gainers by appearances, first seen first; overlaps by the
    smaller of the two shares of the maximum, then by symbol."""
    place = F.array_position(F.array(*map(F.lit, sizes)), F.col("window_hours"))
    seen = movers.where("kind = 'price'").groupBy("symbol", "move").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(place.alias("p"), "window_start", "rk")).alias("first"))
    sides = [first_rows(seen.where(F.col("move") == m), ["move"], [F.desc("n"), "first"], top_n, "rk").select(F.lit(c).alias("cohort"), "rk", "symbol", F.col("n").cast("double").alias("score")) for c, m in (("losers", "loss"), ("gainers", "gain"))]
    n_of = lambda m: F.coalesce(F.sum(F.when(F.col("move") == m, F.col("n"))), F.lit(0))
    both = seen.groupBy("symbol").agg(n_of("gain").alias("g"), n_of("loss").alias("l"))
    top = both.agg(F.max("g").alias("max_g"), F.max("l").alias("max_l"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    # one row of maxima
    scored = both.join(F.broadcast(top)).withColumn("score", F.least(share("g", "max_g"), share("l", "max_l")))
    overlap = first_rows(scored.withColumn("cohort", F.lit("overlaps")), ["cohort"], [F.desc("score"), "symbol"], top_n, "rk").select("cohort", "rk", "symbol", "score")
    return sides[0].unionByName(sides[1]).unionByName(overlap)


def skew(counts: DataFrame) -> DataFrame:
    """(symbol, bucket, deviation_pct, level, distance) against the centroid of all symbols' bucket shares.

    Levels by the 95th, 75th and 50th percentile of all absolute deviations, absent buckets included."""
    buckets = counts.select("bucket").distinct()
    # at most four measures of each window size
    grid = counts.select("symbol").distinct().join(F.broadcast(buckets))
    whole = Window.partitionBy("symbol")
    cells = grid.join(counts, ["symbol", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("x", F.col("n") / F.sum("n").over(whole))
    centre = cells.groupBy("bucket").agg(F.avg("x").alias("c"))
    away = cells.join(F.broadcast(centre), "bucket").withColumn("deviation_pct", F.coalesce(F.try_divide(F.col("x") - F.col("c"), F.col("c")) * 100, F.lit(0.0)))
    cuts = away.agg(F.percentile(F.abs("deviation_pct"), F.array(F.lit(0.95), F.lit(0.75), F.lit(0.5))).alias("cut"))
    far = F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2).over(whole))
    size = F.abs("deviation_pct")
    level = F.when(size >= F.col("cut")[0], "heavy").when(size >= F.col("cut")[1], "moderate").when(size >= F.col("cut")[2], "slight")
    return away.withColumn("distance", far).join(F.broadcast(cuts)).select("symbol", "bucket", "deviation_pct", level.alias("level"), "distance")


def profile_tags(counts: DataFrame, skewed: DataFrame, vol_ratio: float = 1.5, term_ratio: float = 1.5) -> DataFrame:
    """(symbol, tags): Vol Mover, Short-Term or Long-Term, Balanced, joined by commas."""
    hours = F.split("bucket", "_")[1]
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = counts.groupBy("symbol").agg(part(F.startswith("bucket", F.lit("vol_"))).alias("v"), part(F.startswith("bucket", F.lit("price_"))).alias("p"), part(hours.isin("6h", "24h")).alias("s"), part(hours.isin("72h", "168h")).alias("l"))
    distance = skewed.groupBy("symbol").agg(F.first("distance").alias("distance"))
    limit = distance.agg((F.avg("distance") + F.stddev_pop("distance")).alias("limit"))
    rows = sums.join(distance, "symbol", "left").join(F.broadcast(limit))
    v, p, s, l = map(F.col, "vpsl")
    term = F.when(s > term_ratio * l, "Short-Term").when(l > term_ratio * s, "Long-Term")
    return rows.select("symbol", F.concat_ws(",", F.when(v > vol_ratio * p, "Vol Mover"), term, F.when(F.col("distance") < F.col("limit"), "Balanced")).alias("tags"))


def latest(stats: DataFrame, hours: int = 24) -> DataFrame:
    """Each symbol's last window of a size."""
    rest = [c for c in stats.columns if c != "symbol"]
    return stats.where(F.col("window_hours") == hours).groupBy("symbol").agg(F.max_by(F.struct(*rest), "window_start").alias("r")).select("symbol", "r.*")


def section_summary(stats: DataFrame, counts: DataFrame, members: DataFrame) -> DataFrame:
    """Cohort members with their last 24 hours, tags and skewed buckets as JSON."""
    own = counts.join(members.select("symbol").distinct(), "symbol", "left_semi")
    skewed = skew(own)
    detail = skewed.where("level IS NOT NULL").groupBy("symbol").agg(F.to_json(F.sort_array(F.collect_list(F.struct("bucket", "level", "deviation_pct")))).alias("skew"))
    return members.join(latest(stats).drop("window_hours"), "symbol", "left").join(profile_tags(own, skewed), "symbol", "left").join(detail, "symbol", "left")


def ticker_losers(tickers: DataFrame, least_volume: float = 0.0, n: int = 20, stable: Sequence[str] = ("USDT", "USDC", "DAI")) -> DataFrame:
    """(symbol, open, last, volume, pct_change): the largest 24-hour falls, stable coins left out."""
    rows = tickers.withColumnRenamed("pair", "symbol").withColumn("pct_change", (F.col("last") - F.col("open")) / F.col("open") * 100)
    base = F.expr("left(symbol, length(symbol) - 3)")
    return rows.where(~base.isin(*stable) & (F.col("volume") >= least_volume)).orderBy("pct_change", "symbol").limit(n)


def _ticks(spark: SparkSession, d: str, by: str = "event_type") -> DataFrame:
    return table(spark, d, "events").select(F.col(by).cast("string").alias("symbol"), "ts", F.col("value").alias("close"), F.lit(1.0).alias("volume"), "event_id")


def _stats(spark, d, by="user_id"):
    return window_stats(_ticks(spark, d, by), order=["event_id"])


def _movers(spark, d):
    return top_movers(_stats(spark, d))


def q_recent_symbols(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("timestamp"))
    return recent_symbols(e, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


def q_history_slice(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("timestamp"), "event_id", "value")
    return history(e, recent_symbols(e, F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"), "6 hours"), F.lit("2024-01-20").cast("timestamp_ntz"))


def q_window_stats(spark, d):
    s = _stats(spark, d, "event_type")
    return s.withColumns({c: F.round(c, 6) for c in ("price_change", "pct_vol_change")}).withColumn("window_hours", F.col("window_hours").cast("bigint"))


def q_leaderboard_appearances(spark, d):
    return tallies(_movers(spark, d))


def q_habitual_cohorts(spark, d):
    return cohorts(settle(_movers(spark, d), "movers")).select("cohort", F.col("rk").cast("bigint").alias("rk"), "symbol", F.round("score", 9).alias("score"))


def _counts(spark, d):
    """The tallies are read several times and are tiny against the ticks, so they are written once."""
    return settle(tallies(_movers(spark, d)), "tallies")


def q_bucket_skew(spark, d):
    return skew(_counts(spark, d)).select("symbol", "bucket", F.round("deviation_pct", 6).alias("deviation_pct"), "level", F.round("distance", 9).alias("distance"))


def q_profile_tags(spark, d):
    counts = _counts(spark, d)
    return profile_tags(counts, skew(counts))


def q_latest_24h(spark, d):
    return latest(_stats(spark, d)).select("symbol", "window_start", F.round("price_change", 6).alias("price_change"), "total_volume", F.round("pct_vol_change", 6).alias("pct_vol_change"))


def q_ticker_losers(spark, d):
    p = table(spark, d, "part")
    pair = F.when(F.col("p_partkey") % 50 == 0, F.lit("USDTUSD")).otherwise(F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("USD")))
    entry = F.struct(F.col("p_retailprice").cast("string").alias("o"), F.array((F.col("p_retailprice") * (F.lit(0.5) + F.col("p_size") / 50)).cast("string"), F.lit("1")).alias("c"), F.array(F.lit("0"), (F.col("p_size") * 100).cast("string")).alias("v"))
    docs = p.select(F.to_json(F.create_map(pair, entry)).alias("json"))
    return ticker_losers(parse_ticker(docs, F.col("json")), 500.0, 20).select("symbol", "open", F.round("last", 6).alias("last"), "volume", F.round("pct_change", 6).alias("pct_change"))


def q_usd_pairs(spark, d):
    n = table(spark, d, "nation")
    entry = F.map_from_arrays(F.array(F.col("n_name")), F.array(F.struct(F.concat(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "/USD").otherwise("/EUR")).alias("wsname"))))
    docs = n.select(F.to_json(F.struct(F.array().cast("array<string>").alias("error"), entry.alias("result"))).alias("json"))
    return quoted_in(docs, F.col("json"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_STATS = """
    ticks AS (SELECT CAST({by} AS VARCHAR) AS symbol, ts, event_id, value AS close FROM events),
    sizes AS (SELECT * FROM (VALUES (1, 6), (2, 24), (3, 72), (4, 168)) t(place, window_hours)),
    binned AS (
        SELECT symbol, place, window_hours, time_bucket(to_hours(window_hours), ts, TIMESTAMP '1970-01-01') AS window_start,
               max_by(close, {{'ts': ts, 'id': event_id}}) AS close, CAST(count(*) AS DOUBLE) AS total_volume
        FROM ticks, sizes GROUP BY ALL),
    lagged AS (SELECT *, lag(close) OVER w AS pc, lag(total_volume) OVER w AS pv FROM binned WINDOW w AS (PARTITION BY symbol, window_hours ORDER BY window_start)),
    stats AS (
        SELECT symbol, place, window_hours, window_start, total_volume,
               CASE WHEN pc = 0 THEN CASE WHEN close > 0 THEN 'inf'::DOUBLE WHEN close < 0 THEN '-inf'::DOUBLE END ELSE (close / pc - 1) * 100 END AS price_change,
               CASE WHEN pv = 0 THEN CASE WHEN total_volume > 0 THEN 'inf'::DOUBLE END ELSE (total_volume / pv - 1) * 100 END AS pct_vol_change
        FROM lagged),
    good AS (SELECT * FROM stats WHERE price_change IS NOT NULL AND pct_vol_change IS NOT NULL)"""
_MOVERS = _STATS.format(by="user_id") + """,
    measured AS (
        SELECT *, 'price' AS kind, 'loss' AS move, price_change AS x FROM good WHERE price_change < 0
        UNION ALL SELECT *, 'price', 'gain', -price_change FROM good WHERE price_change > 0
        UNION ALL SELECT *, 'vol', 'drop', pct_vol_change FROM good WHERE pct_vol_change < 0
        UNION ALL SELECT *, 'vol', 'spike', -pct_vol_change FROM good WHERE pct_vol_change > 0),
    movers AS (SELECT *, row_number() OVER (PARTITION BY window_hours, window_start, kind, move ORDER BY x, symbol) AS rk FROM measured QUALIFY rk <= 20),
    counts AS (SELECT symbol, kind || '_' || window_hours || 'h_' || move AS bucket, count(*) AS n FROM movers GROUP BY ALL)"""
_SKEW = _MOVERS + """,
    cells AS (
        SELECT s.symbol, b.bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT symbol FROM counts) s CROSS JOIN (SELECT DISTINCT bucket FROM counts) b
        LEFT JOIN counts c ON c.symbol = s.symbol AND c.bucket = b.bucket),
    shares AS (SELECT symbol, bucket, n / sum(n) OVER (PARTITION BY symbol) AS x FROM cells),
    centred AS (SELECT *, avg(x) OVER (PARTITION BY bucket) AS c FROM shares),
    away AS (SELECT symbol, bucket, coalesce((x - c) / nullif(c, 0) * 100, 0) AS dev, sqrt(sum((x - c) * (x - c)) OVER (PARTITION BY symbol)) AS distance FROM centred),
    cuts AS (SELECT quantile_cont(abs(dev), 0.95) AS a, quantile_cont(abs(dev), 0.75) AS b, quantile_cont(abs(dev), 0.5) AS c FROM away)"""

SQL = {
    "recent_symbols": "SELECT CAST(user_id AS VARCHAR) AS symbol, max(ts) AS last_ts FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-29 12:00:00'",
    "history_slice": """SELECT CAST(user_id AS VARCHAR) AS symbol, ts AS timestamp, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-20'
        AND user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-30 14:00:00')""",
    "window_stats": f"WITH {_STATS.format(by='event_type')} SELECT symbol, CAST(window_hours AS BIGINT) AS window_hours, window_start, round(price_change, 6) AS price_change, total_volume, round(pct_vol_change, 6) AS pct_vol_change FROM good",
    "leaderboard_appearances": f"WITH {_MOVERS} SELECT * FROM counts",
    "habitual_cohorts": f"""WITH {_MOVERS},
        seen AS (SELECT symbol, move, count(*) AS n, min({{'p': place, 'w': window_start, 'r': rk}}) AS first FROM movers WHERE kind = 'price' GROUP BY ALL),
        sides AS (SELECT CASE move WHEN 'loss' THEN 'losers' ELSE 'gainers' END AS cohort, row_number() OVER (PARTITION BY move ORDER BY n DESC, first) AS rk, symbol, CAST(n AS DOUBLE) AS score FROM seen),
        both_ AS (SELECT symbol, coalesce(sum(n) FILTER (move = 'gain'), 0) AS g, coalesce(sum(n) FILTER (move = 'loss'), 0) AS l FROM seen GROUP BY 1),
        scored AS (SELECT symbol, least(coalesce(g / nullif(max(g) OVER (), 0), 0), coalesce(l / nullif(max(l) OVER (), 0), 0)) AS score FROM both_)
        SELECT * FROM sides WHERE rk <= 20 UNION ALL
        SELECT 'overlaps', row_number() OVER (ORDER BY score DESC, symbol) AS rk, symbol, round(score, 9) FROM scored QUALIFY rk <= 20""",
    "bucket_skew": f"""WITH {_SKEW} SELECT symbol, bucket, round(dev, 6) AS deviation_pct,
        CASE WHEN abs(dev) >= a THEN 'heavy' WHEN abs(dev) >= b THEN 'moderate' WHEN abs(dev) >= c THEN 'slight' END AS level, round(distance, 9) AS distance FROM away, cuts""",
    "profile_tags": f"""WITH {_SKEW},
        sums AS (SELECT symbol, coalesce(sum(n) FILTER (bucket LIKE 'vol%'), 0) AS v, coalesce(sum(n) FILTER (bucket LIKE 'price%'), 0) AS p,
            coalesce(sum(n) FILTER (split_part(bucket, '_', 2) IN ('6h', '24h')), 0) AS s, coalesce(sum(n) FILTER (split_part(bucket, '_', 2) IN ('72h', '168h')), 0) AS l FROM counts GROUP BY 1),
        far AS (SELECT symbol, any_value(distance) AS distance FROM away GROUP BY 1),
        lim AS (SELECT avg(distance) + stddev_pop(distance) AS x FROM far)
        SELECT symbol, concat_ws(',', CASE WHEN v > 1.5 * p THEN 'Vol Mover' END, CASE WHEN s > 1.5 * l THEN 'Short-Term' WHEN l > 1.5 * s THEN 'Long-Term' END, CASE WHEN distance < x THEN 'Balanced' END) AS tags
        FROM sums JOIN far USING (symbol), lim""",
    "latest_24h": f"""WITH {_STATS.format(by='user_id')} SELECT symbol, window_start, round(price_change, 6) AS price_change, total_volume, round(pct_vol_change, 6) AS pct_vol_change
        FROM good WHERE window_hours = 24 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY window_start DESC) = 1""",
    "ticker_losers": """WITH t AS (SELECT 'P' || p_partkey || 'USD' AS symbol, p_retailprice AS open, p_retailprice * (0.5::DOUBLE + p_size / 50) AS last, CAST(p_size * 100 AS DOUBLE) AS volume FROM part WHERE p_partkey % 50 <> 0)
        SELECT symbol, open, round(last, 6) AS last, volume, round((last - open) / open * 100, 6) AS pct_change FROM t WHERE volume >= 500 ORDER BY (last - open) / open * 100, symbol LIMIT 20""",
    "usd_pairs": "SELECT n_name AS pair FROM nation WHERE n_nationkey % 2 = 0",
}
