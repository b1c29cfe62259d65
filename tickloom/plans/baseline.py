"""Per-symbol baselines of metrics, and where a current value stands against them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.registry import KNOTS, is_signal, neutral_value, transform_kind
from tickloom.functions.scalar import EPS, finite, interpolate, transform
from tickloom.plans.metrics import column_name, metrics_series
from tickloom.plans.metrics import _WINDOWS as WINDOWS_SQL
from tickloom.plans.tables import bars_h

RANKED = (1, 5, 10, 25, 50, 75, 90, 95, 99)
KINDS = ("positive", "signed", "plain")


def to_long(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, metric, value) of the metric columns that carry a signal."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), finite(F.col(m).cast("double")).alias("value")) for m in metrics if is_signal(m)])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.metric", "c.value")


def build_baseline(long: DataFrame) -> DataFrame:
    """(symbol, metric, p01 .. p99, n): exact percentiles of what is known, and how many."""
    q = F.percentile("value", F.array(*[F.lit(k / 100) for k in KNOTS]))
    got = long.where("value IS NOT NULL").groupBy("symbol", "metric").agg(q.alias("q"), F.count("value").alias("n"))
    return got.select("symbol", "metric", *[F.col("q")[i].alias(f"p{k:02d}") for i, k in enumerate(KNOTS)], "n")


def by_kind(kind: Column, x: Column) -> Column:
    return F.when(kind == "positive", transform(x, "positive")).when(kind == "signed", transform(x, "signed")).otherwise(x)


def enrich(current: DataFrame, baseline: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long rows (symbol, metric, value) with pctile, quintile, p25, p50, p75, n, direction, rz and abs_rz.

    Metrics without a baseline are left out. The percentile interpolates between knots, in the metric's
    transform space, clamped to 1..99; 50 where all knots are equal."""
    kinds = F.create_map(*[F.lit(x) for m in metrics for x in (m, transform_kind(m))])
    rows = current.join(baseline, ["symbol", "metric"]).withColumn("kind", F.element_at(kinds, F.col("metric")))
    rows = rows.withColumn("__x", by_kind(F.col("kind"), F.col("value"))).withColumns({f"__k{k}": by_kind(F.col("kind"), F.col(f"p{k:02d}")) for k in RANKED})
    xs = [F.col(f"__k{k}") for k in RANKED]
    x, p50 = F.col("value"), F.col("p50")
    pctile = F.when(x.isNull(), None).when(xs[0] == xs[-1], 50.0).otherwise(interpolate(F.col("__x"), xs, [float(k) for k in RANKED], 1.0, 99.0))
    above = [F.when(x > F.col(p), 1).otherwise(0) for p in ("p20", "p40", "p60", "p80")]
    rz = (x - p50) / ((F.col("p75") - F.col("p25")) + EPS)
    return rows.select("symbol", "metric", "value", pctile.alias("pctile"), (1 + reduce(lambda a, b: a + b, above)).alias("quintile"), "p25", "p50", "p75", "n", F.when(x.isNotNull(), F.when(x >= p50, "over").otherwise("under")).alias("direction"), rz.alias("rz"), F.abs(rz).alias("abs_rz"))


ENRICHED = ("pctile", "quintile", "p25", "p50", "p75", "n", "direction", "rz", "abs_rz")


def enrich_wide(current: DataFrame, baseline: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The current rows with the enrichment of each metric as columns ``{metric}_pctile`` and so on."""
    long = enrich(to_long(current, metrics), baseline, metrics)
    pick = [F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{m}_{e}") for m in metrics if is_signal(m) for e in ENRICHED]
    return current.join(long.groupBy("symbol").agg(*pick), "symbol", "left")


def impute_neutral(df: DataFrame, profile: str = "core") -> DataFrame:
    """Missing numbers replaced by neutral values, each with an ``_imputed`` flag.

    A metric that falls back to its median takes that of its own row."""
    made: dict[str, Column] = {}
    for f in df.schema:
        rule = neutral_value(f.name, profile)
        if rule is None or f.name.endswith("_imputed") or not isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            continue
        value = F.lit(rule.value)
        if rule.median and f"{f.name}_p50" in df.columns:
            value = F.coalesce(f"{f.name}_p50", value)
        known = F.col(f.name).cast("double") if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
        known = finite(known) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else known
        made[f"{f.name}_imputed"] = F.when(known.isNull(), 1).otherwise(0)
        if not isinstance(f.dataType, T.BooleanType):
            made[f.name] = F.coalesce(known, value)
    return df.select(*[made.get(c, F.col(c)).alias(c) for c in df.columns], *[x.alias(c) for c, x in made.items() if c not in df.columns])


BASE = ("roc", "rv_close", "volume_sum", "dist_to_window_high_abs", "obv")
NAMES = [column_name(m, "24h") for m in BASE if m != "dist_to_window_high_abs"] + ["quote_volume_sum_24h_mag"]


def _series(spark, d):
    s = metrics_series(bars_h(spark, d), 24)
    return s.select("symbol", "window_start", F.col("roc").alias("roc_24h"), F.col("rv_close").alias("rv_close_24h_mag"), F.col("volume_sum").alias("volume_sum_24h"), F.col("obv").alias("obv_24h"), F.col("quote_volume_sum").alias("quote_volume_sum_24h_mag"))


def _now(s):
    rest = [c for c in s.columns if c != "symbol"]
    return s.groupBy("symbol").agg(F.max_by(F.struct(*rest), "window_start").alias("r")).select("symbol", "r.*")


def q_baseline_quantiles(spark, d):
    b = build_baseline(to_long(_series(spark, d), NAMES))
    return b.select("symbol", "metric", *[F.round(f"p{k:02d}", 6).alias(f"p{k:02d}") for k in KNOTS], "n")


def q_enrich_percentile(spark, d):
    s = _series(spark, d)
    e = enrich(to_long(_now(s), NAMES), build_baseline(to_long(s, NAMES)), NAMES)
    return e.select("symbol", "metric", *[F.round(c, 4).alias(c) for c in ("value", "pctile", "p25", "p50", "p75", "rz", "abs_rz")], F.col("quintile").cast("bigint").alias("quintile"), "n", "direction")


def q_impute_neutral(spark, d):
    return impute_neutral(_holes(spark, d)).withColumns({c: F.col(c).cast("bigint") for c in [f"{x}_imputed" for x in HOLES]})


HOLES = ("roc_1h", "rsi_1h_pctile", "rsi_1h_quintile", "roc_1h_rz", "bb_position_1h_pos", "roc_4h_over_24h_dir", "rv_close_1h_over_4h_mag", "adx_1h_minus_4h_mag", "atr_1h_mag")


def _holes(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    x = lambda i: F.when((F.col("p_partkey") + i) % (i + 3) != 0, F.col("p_size") / 4.0)
    return p.select(F.col("p_partkey").alias("symbol"), *[x(i).alias(n) for i, n in enumerate(HOLES)], x(3).alias("atr_1h_mag_p50"), F.when(F.col("p_size") > 10, F.lit(True)).alias("window_ok_1h"))


def q_impute_state(spark, d):
    out = impute_neutral(_holes(spark, d), "state")
    return out.select("symbol", "roc_4h_over_24h_dir", "atr_1h_mag", F.col("roc_4h_over_24h_dir_imputed").cast("bigint").alias("flag"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_SERIES = WINDOWS_SQL + """,
    x AS (SELECT *, CASE WHEN c IS NOT NULL AND pc IS NOT NULL THEN ln(c) - ln(pc) END AS r FROM g),
    s AS (SELECT symbol, ws, (max_by(c, ts) - min_by(c, ts)) / min_by(c, ts) * 100 AS roc_24h, stddev_samp(r) AS rv_close_24h_mag, sum(v) AS volume_sum_24h, sum(sign(coalesce(c - pc, 0)) * v) AS obv_24h, sum(c * v) AS quote_volume_sum_24h_mag FROM x GROUP BY 1, 2),
    long AS (UNPIVOT s ON roc_24h, rv_close_24h_mag, volume_sum_24h, obv_24h, quote_volume_sum_24h_mag INTO NAME metric VALUE value),
    base AS (SELECT symbol, metric, """ + ", ".join(f"quantile_cont(value, {k / 100}) AS p{k:02d}" for k in KNOTS) + ", count(*) AS n FROM long GROUP BY 1, 2)"


def _enrich_sql() -> str:
    kinds = {m: transform_kind(m) for m in NAMES}
    of = lambda c: "CASE " + " ".join(f"WHEN metric = '{m}' THEN " + {"positive": f"ln(1 + greatest({c}, 0))", "signed": f"sign({c}) * ln(1 + abs({c}))", "plain": c}[k] for m, k in kinds.items()) + " END"
    ks = ", ".join(f"{of(f'p{k:02d}')} AS k{k}" for k in RANKED)
    steps = " ".join(f"WHEN x >= k{a} AND x < k{b} THEN {a} + ({b} - {a}) * (x - k{a}) / (k{b} - k{a})" for a, b in zip(RANKED, RANKED[1:]))
    return f"""WITH {_SERIES}, now AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY symbol, metric ORDER BY ws DESC) = 1),
        j AS (SELECT b.*, now.value, {of('now.value').replace('metric', 'b.metric')} AS x, {ks.replace('metric', 'b.metric')} FROM now JOIN base b ON now.symbol = b.symbol AND now.metric = b.metric)
        SELECT symbol, metric, round(value, 4) AS value, round(CASE WHEN k1 = k99 THEN 50 WHEN x < k1 THEN 1 {steps} ELSE 99 END, 4) AS pctile, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75,
            round((value - p50) / (p75 - p25 + 1e-9), 4) AS rz, round(abs((value - p50) / (p75 - p25 + 1e-9)), 4) AS abs_rz, CAST(1 + (value > p20)::INT + (value > p40)::INT + (value > p60)::INT + (value > p80)::INT AS BIGINT) AS quintile, n,
            CASE WHEN value >= p50 THEN 'over' ELSE 'under' END AS direction FROM j"""


def _impute_sql() -> str:
    neutral = (0, 50, 3, 0, 0.5, 0, 1, 0, None)
    holes = ", ".join(f"CASE WHEN (p_partkey + {i}) % {i + 3} <> 0 THEN p_size / 4.0::DOUBLE END AS {n}" for i, n in enumerate(HOLES))
    fill = lambda n, v: f"coalesce({n}, {'coalesce(atr_1h_mag_p50, 0)' if v is None else f'{v}::DOUBLE'})"
    return f"""h AS (SELECT p_partkey AS symbol, {holes}, CASE WHEN (p_partkey + 3) % 6 <> 0 THEN p_size / 4.0::DOUBLE END AS atr_1h_mag_p50, CASE WHEN p_size > 10 THEN true END AS window_ok_1h FROM part),
        i AS (SELECT symbol, {', '.join(f'{fill(n, v)} AS {n}, CAST({n} IS NULL AS BIGINT) AS {n}_imputed' for n, v in zip(HOLES, neutral))}, coalesce(atr_1h_mag_p50, 0) AS atr_1h_mag_p50, atr_1h_mag_p50 IS NULL AS m, window_ok_1h FROM h)"""


SQL = {
    "baseline_quantiles": f"WITH {_SERIES} SELECT symbol, metric, {', '.join(f'round(p{k:02d}, 6) AS p{k:02d}' for k in KNOTS)}, n FROM base",
    "enrich_percentile": _enrich_sql(),
    "impute_neutral": f"WITH {_impute_sql()} SELECT * EXCLUDE (m), CAST(m AS INT) AS atr_1h_mag_p50_imputed FROM i",
    "impute_state": f"WITH {_impute_sql()} SELECT symbol, CASE WHEN roc_4h_over_24h_dir_imputed = 1 THEN 1 ELSE roc_4h_over_24h_dir END AS roc_4h_over_24h_dir, atr_1h_mag, roc_4h_over_24h_dir_imputed AS flag FROM i",
}
