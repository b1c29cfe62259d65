"""Scores of predictions, and the choice of a threshold, as aggregates over a prediction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.sets import before_parts, in_ranges


def regression_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """mae, rmse and r2 in one row; r2 is NULL for constant truth."""
    e = F.col(truth) - F.col(guess)
    n = F.count(e)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(F.when(e.isNotNull(), F.col(truth))) * n)).alias("r2"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def _mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (tp + fp, tp + fn, tn + fp, tn + fn))
    return F.coalesce(F.try_divide(tp.cast("double") * tn - fp.cast("double") * fn, F.sqrt(a * b * c * d)), F.lit(0.0))


def _confusion(truth: Column, guess: Column) -> dict[str, Column]:
    of = lambda t, g: F.sum(F.when((truth == t) & (guess == g), 1).otherwise(0))
    return {"tp": of(1, 1), "tn": of(0, 0), "fp": of(0, 1), "fn": of(1, 0)}


def binary_scores(df: DataFrame, truth: str, guess: str, score: str | None = None) -> DataFrame:
    """f1 and mcc and, with a ``score``, roc_auc, pr_auc and brier, in one row.

    Equal scores count as one step: the table is first reduced to its distinct scores."""
    out = df.agg(*[c.alias(n) for n, c in _confusion(F.col(truth), F.col(guess)).items()]).select(_f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), _mcc(*map(F.col, ("tp", "tn", "fp", "fn"))).alias("mcc"))
    if score is None:
        return out
    steps = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum((1 - F.col(truth)).cast("long")).alias("n"))
    parts = in_ranges(steps, F.desc("s"))
    down = Window.partitionBy("__part").orderBy(F.desc("s"))
    # one row for each part, and one of totals
    run = parts.join(F.broadcast(before_parts(parts, p0=F.sum("p"), n0=F.sum("n"))), "__part").join(F.broadcast(parts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))))
    run = run.withColumns({"tp": F.col("p0") + F.sum("p").over(down), "fp": F.col("n0") + F.sum("n").over(down)})
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.max(F.col("all_p") * F.col("all_n"))
    precision = F.sum(F.col("p") / F.col("all_p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    curves = run.where("all_p > 0 AND all_n > 0").agg(area.alias("roc_auc"), precision.alias("pr_auc"))
    brier = df.agg(F.avg((F.col(score) - F.col(truth)) ** 2).alias("brier"))
    return out.join(curves).join(brier)


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean F1 of all classes that occur."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array_distinct(F.array("t", "g"))).alias("c"), "t", "g", "n")
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    c, t, g = F.col("c"), F.col("t"), F.col("g")
    per = sides.groupBy("c").agg(of((t == c) & (g == c)).alias("tp"), of((t != c) & (g == c)).alias("fp"), of((t == c) & (g != c)).alias("fn"))
    return per.agg(F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1_macro"))


def macro_curves(df: DataFrame, truth: str, scores: list[str]) -> DataFrame:
    """roc_auc_macro and pr_auc_macro, one class against the rest; ``scores`` holds each class's column."""
    parts = [binary_scores(df.select((F.col(truth) == i).cast("int").alias("y"), F.col(s).alias("s")), "y", "y", "s").select("roc_auc", "pr_auc") for i, s in enumerate(scores)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(F.avg("roc_auc").alias("roc_auc_macro"), F.avg("pr_auc").alias("pr_auc_macro"))


def threshold_table(df: DataFrame, truth: str, score: str, taus: list[float]) -> DataFrame:
    """(tau, f1, mcc): every score is placed among the thresholds once, and running sums do the rest."""
    place = F.size(F.filter(F.array(*map(F.lit, taus)), lambda t: t <= F.col(score)))
    binned = df.where(F.col(score).isNotNull()).groupBy(place.alias("k")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum((1 - F.col(truth)).cast("long")).alias("n"))
    total = binned.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.collect_list(F.struct("k", "p", "n")).alias("b"))
    above = lambda part: F.aggregate(F.filter("b", lambda x: x["k"] > F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x[part])
    rows = total.select("all_p", "all_n", "b", F.posexplode(F.array(*map(F.lit, taus))).alias("i", "tau")).select("tau", "all_p", "all_n", above("p").alias("tp"), above("n").alias("fp"))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("all_p") - F.col("tp"), F.col("all_n") - F.col("fp")
    return rows.select("tau", _f1(tp, fp, fn).alias("f1"), _mcc(tp, tn, fp, fn).alias("mcc"))


def best_threshold(table: DataFrame, by: str) -> DataFrame:
    """The smallest threshold of the highest value."""
    return table.where(F.col(by).isNotNull()).orderBy(F.desc(by), "tau").limit(1)


def expected_value(df: DataFrame, score: str, taus: list[float], gain: Column, cost: float = 0.0) -> DataFrame:
    """(tau, ev): mean of score * gain - cost over rows at or above each threshold; thresholds without rows have none."""
    place = F.size(F.filter(F.array(*map(F.lit, taus)), lambda t: t <= F.col(score)))
    value = F.col(score) * gain - cost
    binned = df.where(value.isNotNull()).groupBy(place.alias("k")).agg(F.sum(value).alias("v"), F.count(value).alias("n"))
    one = binned.agg(F.collect_list(F.struct("k", "v", "n")).alias("b"))
    above = lambda part, zero: F.aggregate(F.filter("b", lambda x: x["k"] > F.col("i")), zero, lambda a, x: a + x[part])
    rows = one.select("b", F.posexplode(F.array(*map(F.lit, taus))).alias("i", "tau"))
    return rows.select("tau", F.try_divide(above("v", F.lit(0.0)), above("n", F.lit(0).cast("long"))).alias("ev")).where("ev IS NOT NULL")


def cv_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of fold scores."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
