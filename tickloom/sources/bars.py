"""Where bars come from: files, databases, ticks; and the shapes they are brought into."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accepted headers of each column, in any case.
SYNONYMS = {
    "symbol": ("sym", "ticker", "asset"),
    "timestamp": ("time", "date", "datetime"),
    "volume": ("vol", "qty", "quantity", "amount"),
}
BAR_COLUMNS = ("symbol", "timestamp", "open", "high", "low", "close", "volume")


def normalize_columns(df: DataFrame, required: Sequence[str] = BAR_COLUMNS) -> DataFrame:
    """Rename headers to the bar columns, whatever their case or synonym; ValueError if one is missing.

    A column that already has the plain name wins over synonyms; the first synonym present is taken."""
    by_lower: dict[str, str] = {}
    for c in df.columns:
        by_lower.setdefault(c.lower(), c)
    names = {}
    for want in required:
        found = next((by_lower[x] for x in (want, *SYNONYMS.get(want, ())) if x in by_lower), None)
        if found is None:
            raise ValueError(f"no column for {want!r} among {df.columns}")
        if found != want:
            names[found] = want
    return df.withColumnsRenamed(names)


def clean_bars(df: DataFrame) -> DataFrame:
    """Typed bars: NaN becomes NULL, rows without a readable timestamp go, UTC NTZ timestamps."""
    numbers = [c for c in ("open", "high", "low", "close", "volume") if c in df.columns]
    parsed = F.col("timestamp") if isinstance(df.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.try_to_timestamp("timestamp")
    typed = {c: F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(None).cast("double")) for c in numbers}
    return df.withColumns({**typed, "timestamp": parsed.cast("timestamp_ntz")}).where(F.col("timestamp").isNotNull())


def read_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a CSV file with any accepted header. All columns are read as text, so nothing is scanned twice."""
    return clean_bars(normalize_columns(spark.read.option("header", True).csv(path)))


def read_metrics_series(spark: SparkSession, path: str, windows: Sequence[str] = ()) -> DataFrame:
    """A metrics series from CSV, of the given windows in any case (all if none)."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return of_windows(df, windows)


def of_windows(df: DataFrame, windows: Sequence[str]) -> DataFrame:
    return df.where(F.lower("window").isin([w.lower() for w in windows])) if windows else df


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV where the name says so."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def jdbc_options(url: str, user: str, password: str, **more: str) -> dict[str, str]:
    """Options of a JDBC source; a driver class or fetch size may be among ``more``."""
    return {"url": url, "user": user, "password": password, "fetchsize": "10000", **more}


def read_jdbc_bars(spark: SparkSession, options: Mapping[str, str], table: str = "ohlcvt") -> DataFrame:
    """Bars of a database table; filters on symbol and time are pushed down by Spark."""
    return spark.read.format("jdbc").options(**options, dbtable=table).load().select(*BAR_COLUMNS)


def bars_from_ticks(df: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, size: Column, every: str) -> DataFrame:
    """OHLCV bars of ticks: first and last by ``order``, left-labelled epoch-aligned bins."""
    t = df.select(symbol.alias("symbol"), F.window(ts, every)["start"].alias("ts"), price.alias("p"), order.alias("o"), size.alias("s"))
    return t.groupBy("symbol", "ts").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("s").alias("volume"))


def recent_symbols(bars: DataFrame, asof: Column, within: str = "1 day", symbol: str = "symbol", ts: str = "timestamp") -> DataFrame:
    """Symbols with a bar at or after ``asof`` - ``within``, with their last one."""
    last = bars.groupBy(F.col(symbol).alias("symbol")).agg(F.max(ts).alias("last_ts"))
    return last.where(F.col("last_ts") >= asof - F.expr(f"INTERVAL {within}"))


def history(bars: DataFrame, symbols: DataFrame, start: Column, symbol: str = "symbol", ts: str = "timestamp") -> DataFrame:
    """Bars of the given symbols from ``start`` on; no symbols, no rows."""
    wanted = symbols.select(F.col("symbol").alias("__s")).distinct()
    return bars.where(F.col(ts) >= start).join(wanted, F.col(symbol) == F.col("__s"), "left_semi")


def history_months(bars: DataFrame, symbols: DataFrame, asof: Column, months: int, symbol: str = "symbol", ts: str = "timestamp") -> DataFrame:
    """Bars of the given symbols in (asof - months, asof], in calendar months with ends clamped."""
    recent = history(bars, symbols, asof - F.make_ym_interval(F.lit(0), F.lit(months)), symbol, ts)
    return recent.where((F.col(ts) > asof - F.make_ym_interval(F.lit(0), F.lit(months))) & (F.col(ts) <= asof))


def leaders(spark: SparkSession, listed: Sequence[str] = (), table: DataFrame | None = None) -> DataFrame:
    """(symbol, place): symbols of a table's symbol column (or a synonym), then of a list, each at its first place."""
    from tickloom.operators.sets import distinct_in_order

    parts = spark.createDataFrame([(s.strip(), i) for i, s in enumerate(listed) if s.strip()], "symbol string, place bigint").withColumn("source", F.lit(1))
    if table is not None:
        named = normalize_columns(table, ["symbol"]).select(F.trim(F.col("symbol").cast("string")).alias("symbol"), F.monotonically_increasing_id().alias("place"), F.lit(0).alias("source"))
        parts = named.where("symbol <> ''").unionByName(parts)
    return distinct_in_order(parts, ["symbol"], F.struct("source", "place"))


TICKER = "map<string,struct<o:string,c:array<string>,v:array<string>>>"


def parse_ticker(df: DataFrame, json: Column) -> DataFrame:
    """(pair, open, last, volume) of ticker documents; entries with an unreadable number or no open price go."""
    entries = df.select(F.explode(F.from_json(json, TICKER)).alias("pair", "t"))
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    out = entries.select("pair", number("t.o").alias("open"), number("get(t.c, 0)").alias("last"), number("get(t.v, 1)").alias("volume"))
    return out.where("open IS NOT NULL AND open <> 0 AND last IS NOT NULL AND volume IS NOT NULL")


def quoted_in(pairs: DataFrame, json: Column, quote: str = "USD") -> DataFrame:
    """Pair keys whose ``wsname`` ends with the quote currency; a document with errors raises."""
    shape = "error array<string>, result map<string,struct<wsname:string>>"
    doc = pairs.select(F.from_json(json, shape).alias("d")).select(F.when(F.size("d.error") > 0, F.raise_error(F.concat(F.lit("exchange error: "), F.array_join("d.error", ", ")))).otherwise(F.col("d.result")).cast("map<string,struct<wsname:string>>").alias("r"))
    return doc.select(F.explode("r").alias("pair", "info")).where(F.endswith("info.wsname", F.lit(quote))).select("pair")


def read_dominant_cycles(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, duration_min, amplitude_pct) of a comma-separated text file; NA is NULL."""
    part = lambda i: F.trim(F.get(F.split("value", ","), F.lit(i)))
    rows = spark.read.text(path).select(part(0).alias("symbol"), part(1).alias("d"), part(2).alias("a"))
    return rows.where("symbol <> ''").select("symbol", F.expr("try_cast(d AS double)").alias("duration_min"), F.expr("try_cast(a AS double)").alias("amplitude_pct"))


CLUSTER_SUMMARY = "map<string,map<string,struct<gmm:array<{0}>,dbscan:array<{0}>>>>".format("struct<cluster:int,count:bigint,median_amplitude_pct:double,median_duration_min:double,small:boolean>")


def read_cluster_summary(df: DataFrame, json: Column) -> DataFrame:
    """One row for each (coin, window, method, cluster) of a nested summary document."""
    windows = df.select(F.explode(F.from_json(json, CLUSTER_SUMMARY)).alias("symbol", "w")).select("symbol", F.explode("w").alias("window", "m"))
    both = F.array(F.struct(F.lit("gmm").alias("method"), F.col("m.gmm").alias("cs")), F.struct(F.lit("dbscan").alias("method"), F.col("m.dbscan").alias("cs")))
    return windows.select("symbol", "window", F.explode(both).alias("x")).select("symbol", "window", "x.method", F.posexplode("x.cs").alias("place", "c")).select("symbol", "window", "method", "place", "c.*")
