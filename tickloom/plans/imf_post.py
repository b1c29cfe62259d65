"""Post-processing of cycle tables: reliability, selection, dominant cycles, clusters' statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.scalar import amplitude_band
from tickloom.operators.analytic import first_rows
from tickloom.plans.tables import table



def with_reliability(rows: DataFrame, window_days: float, bands: tuple[float, float] = (5.0, 12.0), least_energy: float = 0.0) -> DataFrame:
    """Flags, reliability, selection score and amplitude band of rows with status ok and enough energy."""
    d = rows.where((F.col("status") == "ok") & (F.col("energy_share") >= least_energy))
    cycles = F.try_divide(F.lit(float(window_days)), F.when(F.col("period_days") > 0, F.col("period_days")))
    d = d.withColumns({
        "singleton_global_flag": F.coalesce(F.col("cluster_id_global").rlike("^G[PVM]9"), F.lit(False)), "expected_cycles": cycles,
        "undersampled_flag": F.coalesce(cycles < 1.5, F.lit(False)), "long_cycle_flag": F.coalesce(F.col("period_days") > 2 / 3 * window_days, F.lit(False)),
    })
    steady = lambda c: F.coalesce(F.exp(-F.col(c) / 25), F.lit(0.5))
    base = 0.6 * steady("cluster_mad_pct_period_global") + 0.4 * steady("cluster_mad_pct_amp_global")
    # least() passes over NULL, so each use says what a missing value gives
    at_most = lambda limit, c: F.when(c.isNotNull(), F.least(F.lit(limit), c))
    trust = at_most(1.0, F.col("expected_cycles") / 2)
    boost = F.coalesce(at_most(0.15, F.log1p("cluster_size_global") / F.log(F.lit(50.0)) * 0.15), F.lit(0.0))
    d = d.withColumn("reliability", F.when(trust.isNotNull(), F.least(F.lit(1.0), trust * base + (1 - trust) * 0.4 + boost)))
    score = F.col("reliability") * (0.6 * F.col("energy_share") + 0.4 * at_most(1.0, F.col("amp_pct") / 20))
    return d.withColumns({"selection_score": score, "amp_band": amplitude_band(F.col("amp_pct"), *bands)})


def _ranked(scored: DataFrame, n: int) -> DataFrame:
    order = [F.desc_nulls_last("selection_score"), F.desc_nulls_last("amp_pct"), F.asc_nulls_last("period_days"), "imf_id"]
    return first_rows(scored, ["symbol", "series"], order, n, "rank")


def top_cycles(scored: DataFrame, n: int = 3) -> DataFrame:
    """The first rows of each symbol and series by score, amplitude, and shorter period."""
    return _ranked(scored, n)


def summarise(scored: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """One row for each symbol and series: energy-weighted means, spread of periods, the dominant cycle and a sentence."""
    w = F.col("energy_share")
    mean = lambda c: F.when(F.sum(w) > 0, F.sum(w * F.col(c)) / F.when(F.sum(w) > 0, F.sum(w)))
    middle = scored.groupBy("symbol", "series").agg(F.median("period_days").alias("med"))
    spread = scored.join(middle, ["symbol", "series"]).groupBy("symbol", "series").agg(F.try_divide(1.4826 * F.median(F.abs(F.col("period_days") - F.col("med"))), F.abs(F.first("med"))).alias("m"))
    parts = scored.groupBy("symbol", "series").agg(mean("period_days").alias("agg_period_days"), mean("amp_pct").alias("agg_amp_pct"))
    top = _ranked(scored, 3)
    of = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    dom = ("period_days", "amp_pct", "energy_share", "reliability", "cluster_id_global", "cluster_size_global", "selection_score", "amp_band", "expected_cycles", "singleton_global_flag", "undersampled_flag", "long_cycle_flag")
    wide = top.groupBy("symbol", "series").agg(*[of(c, 1).alias(f"dom_{c}") for c in dom], of("period_days", 2).alias("alt1"), of("period_days", 3).alias("alt2"))
    one = lambda c: F.format_string("%.1f", c)
    alts = F.concat_ws("/", *[F.when(F.col(c).isNotNull(), one(F.col(c))) for c in ("alt1", "alt2")])
    text = F.concat(
        F.format_string("Cycle ~%.1fd, %s (%.1f%%). ", "dom_period_days", "dom_amp_band", "dom_amp_pct"), F.when(alts != "", F.concat(F.lit("Alt: "), alts, F.lit("d. "))).otherwise(""),
        F.format_string("Rel %.2f", "dom_reliability"), F.when(F.col("dom_singleton_global_flag"), F.concat(F.lit(" ("), F.col("dom_cluster_id_global"), F.lit(")"))).otherwise(""),
        F.lit("; undersampled: "), F.when(F.col("dom_undersampled_flag"), "yes").otherwise("no"), F.lit("."),
    )
    out = wide.join(parts, ["symbol", "series"]).join(spread, ["symbol", "series"]).withColumns({"mad_pct_period_all": F.col("m") * 100, "text_summary": text}).drop("m", "alt1", "alt2")
    return out if missing is None else out.join(missing.select("symbol", "missing_share"), "symbol", "left")


def cluster_stats(rows: DataFrame, cluster: str, period: str = "period_days", amp: str = "amp_pct") -> DataFrame:
    """(cluster, n, medians, MAD in percent, reliabilities): exp(-MAD% / 25), and 0 for a single member."""
    med = rows.groupBy(cluster).agg(F.median(period).alias("median_period"), F.median(amp).alias("median_amp"))
    away = rows.join(med, cluster)
    pct = lambda c, m: F.try_divide(1.4826 * F.median(F.abs(F.col(c) - F.col(m))), F.abs(F.first(m))) * 100
    out = away.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.first("median_period").alias("median_period"), F.first("median_amp").alias("median_amp"), pct(period, "median_period").alias("mad_pct_period"), pct(amp, "median_amp").alias("mad_pct_amp"))
    trust = lambda c: F.when(F.col("n") == 1, 0.0).otherwise(F.exp(-F.col(c) / 25))
    return out.withColumns({"reliability_period": trust("mad_pct_period"), "reliability_amp": trust("mad_pct_amp")})


def cluster_cards(rows: DataFrame, cluster: str, examples: int = 5) -> DataFrame:
    """Cluster statistics with the symbols of its strongest rows by energy share."""
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc_nulls_last("energy_share"), "symbol"))
    first = rows.select(cluster, "symbol", place.alias("k")).where(F.col("k") <= examples)
    best = first.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("k", "symbol")))["symbol"].alias("example_symbols"))
    return cluster_stats(rows, cluster).join(best, cluster)


def relabel(rows: DataFrame, cluster: str, prefix: Column, by: Sequence[str] = (), period: str = "period_days", noise: int = -1) -> DataFrame:
    """``cluster_id``: prefix and four digits by size, then median period; each noise row a cluster of its own from 9001."""
    sizes = rows.where(F.col(cluster) != noise).groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"), F.median(period).alias("m"))
    within = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ids = sizes.select(*by, cluster, F.row_number().over(within.orderBy(F.desc("n"), "m", cluster)).alias("k"))
    alone = 9000 + F.row_number().over(Window.partitionBy(*by, cluster).orderBy(period, "symbol", "imf_id"))
    return rows.join(ids, [*by, cluster], "left").withColumn("k", F.coalesce("k", alone)).withColumn("cluster_id", F.concat(prefix, F.format_string("%04d", "k"))).drop("k")


def energy_shares(rows: DataFrame, keys: Sequence[str] = ("symbol", "series")) -> DataFrame:
    """Each component's variance as a share of all components'."""
    return rows.withColumn("energy_share", F.col("energy") / (F.sum("energy").over(Window.partitionBy(*keys)) + 1e-9))


def with_stubs(symbols: DataFrame, rows: DataFrame, status: str = "no_imfs", series: Sequence[str] = ("price", "volume")) -> DataFrame:
    """Rows of every symbol and series; those without any get one row that says so."""
    grid = symbols.select("symbol", F.explode(F.array(*map(F.lit, series))).alias("series"))
    return grid.join(rows, ["symbol", "series"], "left").withColumn("status", F.coalesce("status", F.lit(status)))


def _imf_rows(spark, d):
    p = table(spark, d, "part")
    return p.selectExpr(
        "concat('S', cast(p_partkey % 40 AS string)) AS symbol", "CASE WHEN p_partkey % 3 = 0 THEN 'volume' ELSE 'price' END AS series", "p_partkey AS imf_id", "CASE WHEN p_partkey % 17 = 0 THEN 'no_imfs' ELSE 'ok' END AS status",
        "CASE WHEN p_partkey % 29 <> 0 THEN (p_partkey * 7 % 97) / 2D END AS period_days", "CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey * 11 % 83) / 3D END AS amp_pct", "(p_partkey * 13 % 71) / 71D AS energy_share",
        "concat('G', CASE WHEN p_partkey % 3 = 0 THEN 'V' ELSE 'P' END, cast(1000 + (p_partkey % 10) * 1000 + p_size AS string)) AS cluster_id_global", "cast(p_size AS double) AS cluster_size_global",
        "CASE WHEN p_partkey % 5 <> 0 THEN p_size / 2D END AS cluster_mad_pct_period_global", "CASE WHEN p_partkey % 7 <> 0 THEN p_size / 3D END AS cluster_mad_pct_amp_global",
    )


def q_imf_post_reliability(spark, d):
    s = with_reliability(_imf_rows(spark, d), 90)
    return s.select("imf_id", "singleton_global_flag", "undersampled_flag", "long_cycle_flag", "amp_band", *[F.round(c, 6).alias(c) for c in ("expected_cycles", "reliability", "selection_score")])


def q_imf_topk(spark, d):
    return top_cycles(with_reliability(_imf_rows(spark, d), 90)).select("symbol", "series", F.col("rank").cast("bigint").alias("rank"), "imf_id", F.round("selection_score", 6).alias("selection_score"))


def q_imf_summary(spark, d):
    s = summarise(with_reliability(_imf_rows(spark, d).where("period_days IS NOT NULL AND amp_pct IS NOT NULL AND period_days > 0"), 90))
    return s.select("symbol", "series", *[F.round(c, 5).alias(c) for c in ("agg_period_days", "agg_amp_pct", "mad_pct_period_all", "dom_period_days", "dom_amp_pct", "dom_reliability")], "dom_cluster_id_global", "dom_undersampled_flag")


def q_cluster_stats(spark, d):
    c = cluster_stats(_imf_rows(spark, d).where("period_days > 0 AND amp_pct IS NOT NULL"), "cluster_size_global")
    return c.select(F.col("cluster_size_global").alias("cluster"), "n", *[F.round(x, 6).alias(x) for x in ("median_period", "median_amp", "mad_pct_period", "mad_pct_amp", "reliability_period", "reliability_amp")])


def q_cluster_cards(spark, d):
    rows = _imf_rows(spark, d).where("period_days > 0 AND amp_pct IS NOT NULL")
    return cluster_cards(rows, "cluster_size_global").select(F.col("cluster_size_global").alias("cluster"), "n", F.array_join("example_symbols", ",").alias("example_symbols"))


def q_cluster_relabel(spark, d):
    rows = _imf_rows(spark, d).where("period_days IS NOT NULL").withColumn("c", F.when(F.col("imf_id") % 50 == 0, -1).otherwise(F.col("cluster_size_global").cast("int")))
    return relabel(rows, "c", F.lit("GP")).select("imf_id", "cluster_id")


def q_energy_stubs(spark, d):
    """Every symbol of the modes, and some that have none."""
    rows = energy_shares(_imf_rows(spark, d).withColumn("energy", F.col("energy_share") + 1).drop("energy_share"))
    symbols = _imf_rows(spark, d).select("symbol").distinct().unionByName(spark.range(40, 45).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("symbol")))
    return with_stubs(symbols, rows.select("symbol", "series", "imf_id", "status", F.round("energy_share", 8).alias("energy_share")))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_ROWS = """rows0 AS (SELECT 'S' || p_partkey % 40 AS symbol, CASE WHEN p_partkey % 3 = 0 THEN 'volume' ELSE 'price' END AS series, p_partkey AS imf_id, CASE WHEN p_partkey % 17 = 0 THEN 'no_imfs' ELSE 'ok' END AS status,
        CASE WHEN p_partkey % 29 <> 0 THEN (p_partkey * 7 % 97) / 2.0::DOUBLE END AS period_days, CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey * 11 % 83) / 3.0::DOUBLE END AS amp_pct, (p_partkey * 13 % 71) / 71.0::DOUBLE AS energy_share,
        'G' || CASE WHEN p_partkey % 3 = 0 THEN 'V' ELSE 'P' END || (1000 + (p_partkey % 10) * 1000 + p_size) AS cid, p_size::DOUBLE AS csize, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 2.0::DOUBLE END AS mp, CASE WHEN p_partkey % 7 <> 0 THEN p_size / 3.0::DOUBLE END AS ma FROM part)"""
_SCORED = _ROWS + """,
    e AS (SELECT *, 90 / CASE WHEN period_days > 0 THEN period_days END AS ec FROM rows0 WHERE status = 'ok' {more}),
    f AS (SELECT *, CASE WHEN ec IS NOT NULL THEN least(1, least(1, ec / 2) * (0.6 * coalesce(exp(-mp / 25), 0.5) + 0.4 * coalesce(exp(-ma / 25), 0.5)) + (1 - least(1, ec / 2)) * 0.4 + least(0.15, ln(1 + csize) / ln(50) * 0.15)) END AS rel FROM e),
    s AS (SELECT *, rel * (0.6 * energy_share + 0.4 * CASE WHEN amp_pct IS NOT NULL THEN least(1, amp_pct / 20) END) AS score FROM f),
    k AS (SELECT *, row_number() OVER (PARTITION BY symbol, series ORDER BY score DESC NULLS LAST, amp_pct DESC NULLS LAST, period_days ASC NULLS LAST, imf_id) AS rank FROM s)"""

SQL = {
    "imf_post_reliability": f"""WITH {_SCORED.format(more='')} SELECT imf_id, regexp_matches(cid, '^G[PVM]9') AS singleton_global_flag, coalesce(ec < 1.5, false) AS undersampled_flag, coalesce(period_days > 60, false) AS long_cycle_flag,
        CASE WHEN amp_pct IS NULL THEN 'unknown' WHEN amp_pct < 5 THEN 'small' WHEN amp_pct <= 12 THEN 'medium' ELSE 'large' END AS amp_band, round(ec, 6) AS expected_cycles, round(rel, 6) AS reliability, round(score, 6) AS selection_score FROM s""",
    "imf_topk": f"WITH {_SCORED.format(more='')} SELECT symbol, series, rank, imf_id, round(score, 6) AS selection_score FROM k WHERE rank <= 3",
    "imf_summary": f"""WITH {_SCORED.format(more='AND period_days > 0 AND amp_pct IS NOT NULL')}, m AS (SELECT symbol, series, median(period_days) AS med FROM s GROUP BY ALL),
        a AS (SELECT symbol, series, 1.4826 * median(abs(period_days - med)) / abs(any_value(med)) * 100 AS mad FROM s JOIN m USING (symbol, series) GROUP BY ALL),
        g AS (SELECT symbol, series, sum(energy_share * period_days) / nullif(sum(energy_share), 0) AS p, sum(energy_share * amp_pct) / nullif(sum(energy_share), 0) AS q FROM s GROUP BY ALL)
        SELECT symbol, series, round(p, 5) AS agg_period_days, round(q, 5) AS agg_amp_pct, round(mad, 5) AS mad_pct_period_all, round(period_days, 5) AS dom_period_days, round(amp_pct, 5) AS dom_amp_pct, round(rel, 5) AS dom_reliability, cid AS dom_cluster_id_global, ec < 1.5 AS dom_undersampled_flag
        FROM k JOIN a USING (symbol, series) JOIN g USING (symbol, series) WHERE rank = 1""",
    "cluster_stats": f"""WITH {_ROWS}, r AS (SELECT * FROM rows0 WHERE period_days > 0 AND amp_pct IS NOT NULL), m AS (SELECT csize, median(period_days) AS p, median(amp_pct) AS q FROM r GROUP BY 1),
        a AS (SELECT csize, count(*) AS n, any_value(p) AS p, any_value(q) AS q, 1.4826 * median(abs(period_days - p)) / nullif(abs(any_value(p)), 0) * 100 AS x, 1.4826 * median(abs(amp_pct - q)) / nullif(abs(any_value(q)), 0) * 100 AS y FROM r JOIN m USING (csize) GROUP BY 1)
        SELECT csize AS cluster, n, round(p, 6) AS median_period, round(q, 6) AS median_amp, round(x, 6) AS mad_pct_period, round(y, 6) AS mad_pct_amp, round(CASE WHEN n = 1 THEN 0 ELSE exp(-x / 25) END, 6) AS reliability_period, round(CASE WHEN n = 1 THEN 0 ELSE exp(-y / 25) END, 6) AS reliability_amp FROM a""",
    "cluster_cards": f"""WITH {_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY csize ORDER BY energy_share DESC NULLS LAST, symbol) AS k FROM rows0 WHERE period_days > 0 AND amp_pct IS NOT NULL)
        SELECT csize AS cluster, count(*) AS n, string_agg(symbol, ',' ORDER BY k) FILTER (WHERE k <= 5) AS example_symbols FROM r GROUP BY 1""",
    "cluster_relabel": f"""WITH {_ROWS}, r AS (SELECT *, CASE WHEN imf_id % 50 = 0 THEN -1 ELSE csize::INT END AS c FROM rows0 WHERE period_days IS NOT NULL),
        z AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, median(period_days), c) AS k FROM r WHERE c <> -1 GROUP BY c), n AS (SELECT imf_id, 9000 + row_number() OVER (ORDER BY period_days, symbol, imf_id) AS k FROM r WHERE c = -1)
        SELECT imf_id, printf('GP%04d', k) AS cluster_id FROM r JOIN z USING (c) UNION ALL SELECT imf_id, printf('GP%04d', k) FROM n""",
    "energy_stubs": f"""WITH {_ROWS}, r AS (SELECT symbol, series, imf_id, status, round((energy_share + 1) / (sum(energy_share + 1) OVER (PARTITION BY symbol, series) + 1e-9), 8) AS energy_share FROM rows0),
        g AS (SELECT DISTINCT symbol, unnest(['price', 'volume']) AS series FROM (SELECT symbol FROM rows0 UNION ALL SELECT 'S' || i FROM range(40, 45) t(i))) SELECT symbol, series, imf_id, coalesce(status, 'no_imfs') AS status, energy_share FROM g LEFT JOIN r USING (symbol, series)""",
}
