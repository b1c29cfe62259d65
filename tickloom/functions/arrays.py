"""Statistics over small arrays with missing elements, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.fold import let

Body = Callable[[Column], Column]


def known(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull())


def total(xs: Column) -> Column:
    """Sum of what is known; 0 for nothing."""
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def count(xs: Column) -> Column:
    return F.size(known(xs))


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), count(xs))


def variance(xs: Column) -> Column:
    """Sample variance; NULL under two values."""
    return let(mean(xs), lambda m: F.try_divide(total(F.transform(xs, lambda x: (x - m) * (x - m))), F.when(count(xs) > 1, count(xs) - 1)))


def deviation(xs: Column) -> Column:
    return F.sqrt(variance(xs))


def median(xs: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return let(F.sort_array(known(xs)), middle)


def share(xs: Column, holds: Body) -> Column:
    """Elements for which ``holds``, of all elements, missing ones included."""
    return F.try_divide(F.size(F.filter(xs, lambda x: F.coalesce(holds(x), F.lit(False)))), F.size(xs))


def streak(xs: Column, holds: Body) -> Column:
    """The longest run of elements for which ``holds``."""
    step = lambda s, x: let(F.when(F.coalesce(holds(x), F.lit(False)), s["now"] + 1).otherwise(0), lambda n: F.struct(n.alias("now"), F.greatest(s["best"], n).alias("best")))
    return F.aggregate(xs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda s: s["best"].cast("double"))


def tail(xs: Column, n: int) -> Column:
    return F.slice(xs, F.greatest(F.size(xs) - n + 1, F.lit(1)), n)
