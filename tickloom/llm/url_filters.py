"""URL filters whose lists change over time, in DataFrame expressions only.

List entries are dated: each adds or removes a host pattern. Per list and pattern they become validity
intervals, and every capture is evaluated against the entries active when it was fetched. A pattern
matches its host and all hosts below it. Every distinct host is looked up at all its levels, however deep, by
one equality join with the patterns; what it finds goes into one row per host, so that the join with the
captures adds no rows and Spark can split it on a hot host. The as-of step is an expression over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.tokens import beside

HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@\\[]+)"
#: Addresses, which have no hosts below or above them: IPv6 in brackets, and four numbers.
ADDRESS = "^\\[|^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$"
INTERVAL = "array<struct<valid_from:timestamp_ntz,valid_to:timestamp_ntz,list:string>>"


def url_host(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without a final dot; null for anything else. User information ends at the
    last @ before the path; an IPv6 address keeps its brackets."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), "\\.$", "")
    return F.when(found != "", found)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, at) -> (list, pattern, valid_from, valid_to).

    ``add`` opens an interval and ``remove`` closes it; further adds while open and removes while closed
    do nothing. Of entries at one time, removes come first. An open interval has a null ``valid_to``.
    Entries with a null in any column are ignored; patterns are lower-cased."""
    known = entries.dropna(subset=["list", "pattern", "action", "at"]).select("list", F.lower("pattern").alias("pattern"), "action", F.col("at").cast("timestamp_ntz").alias("at"))
    known = known.where(F.col("action").isin("add", "remove")).distinct()
    order = Window.partitionBy("list", "pattern").orderBy("at", F.col("action").desc())
    turns = known.withColumn("before", F.lag("action").over(order)).where(~F.col("action").eqNullSafe(F.col("before")))
    closed = turns.withColumn("valid_to", F.lead("at").over(order)).where("action = 'add'")
    return closed.where("valid_to IS NULL OR valid_to > at").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host``, ``listed``, ``list``, ``pattern`` and ``valid_from`` of the deciding entry.

    The most specific pattern with an interval that holds the fetch time decides (``valid_from`` <= time <
    ``valid_to``); of its intervals, the latest begun, then the first list by name. Hosts are looked up at
    all levels from the host itself upwards, single labels excluded; an IP address, IPv6 in its brackets, is looked
    up as a whole only. A null or relative URL or a null time matches nothing. All intervals of one pattern over all
    lists lie in one row, so they are bounded by a pattern's history and not by captures. Repeated rows pass
    through; columns named like the result's, in whatever case, are replaced. An empty list or table gives no matches or no rows."""
    made = ["host", "listed", "list", "pattern", "valid_from"]
    plain = beside(captures.columns, *made, "__host", "__found", "__hit")
    rows = captures.select(*plain).withColumn("host", url_host(F.col(url_col)))
    by_pattern = validity_intervals(entries).groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "list"))).cast(INTERVAL).alias("intervals"))
    hosts = rows.select(F.col("host").alias("__host")).where("__host IS NOT NULL").distinct().withColumn("__labels", F.split("__host", "\\."))
    top = F.when(F.col("__host").rlike(ADDRESS), 1).otherwise(F.size("__labels") - 1)
    tried = hosts.where((F.size("__labels") >= 2) | F.col("__host").rlike(ADDRESS)).withColumn("level", F.explode(F.sequence(F.lit(1), top)))
    tried = tried.select("__host", "level", F.array_join(F.slice("__labels", F.col("level"), F.size("__labels")), ".").alias("pattern"))
    found = tried.join(by_pattern, "pattern").groupBy("__host").agg(F.sort_array(F.collect_list(F.struct("level", "pattern", "intervals"))).alias("__found"))

    def deciding(entry: Column) -> Column:
        active = F.filter(entry["intervals"], lambda x: (x["valid_from"] <= F.col(time_col)) & (x["valid_to"].isNull() | (F.col(time_col) < x["valid_to"])))
        last = F.aggregate(active, F.lit(None).cast("struct<valid_from:timestamp_ntz,valid_to:timestamp_ntz,list:string>"), lambda a, x: F.when(a.isNull() | (x["valid_from"] > a["valid_from"]) | ((x["valid_from"] == a["valid_from"]) & (x["list"] < a["list"])), x).otherwise(a))
        return F.struct(entry["pattern"].alias("pattern"), last["list"].alias("list"), last["valid_from"].alias("valid_from"))

    rows = rows.join(found, F.col("host") == F.col("__host"), "left")
    rows = rows.withColumn("__hit", F.get(F.filter(F.transform("__found", deciding), lambda x: x["list"].isNotNull()), F.lit(0)))
    return rows.select(*plain, "host", F.col("__hit").isNotNull().alias("listed"), F.col("__hit.list").alias("list"), F.col("__hit.pattern").alias("pattern"), F.col("__hit.valid_from").alias("valid_from"))
