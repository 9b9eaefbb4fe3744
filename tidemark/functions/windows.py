"""Window helpers: guarded rolling aggregates, percentile ranks, integer quantile buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def series(by: str = "market", order: str = "day") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def frame(n: int, last: int = 0, by: str = "market", order: str = "day") -> WindowSpec:
    """The n rows that end `last` rows before the current one. Same partition and order: one sort serves all frames."""
    return series(by, order).rowsBetween(-(n - 1 + last), -last)


def roll(agg: Callable[[Column], Column], x: Column | str, n: int, min_periods: int | None = None, last: int = 0, by: str = "market", order: str = "day") -> Column:
    """A rolling aggregate that is NULL unless min_periods (n if not given) values of the frame are not null."""
    x = F.col(x) if isinstance(x, str) else x
    w = frame(n, last, by, order)
    return F.when(F.count(x).over(w) >= (n if min_periods is None else min_periods), agg(x).over(w))


def roll_std(x: Column | str, n: int) -> Column:
    """The sample deviation of the last n values by running means, step by step as the SQL takes it (M2 from the distances to the mean before and after): stddev_samp
    takes other steps, and a query that asks whether two deviations are equal sees their last bits."""
    values = F.collect_list(F.col(x) if isinstance(x, str) else x).over(frame(n))

    def add(s: Column, v: Column) -> Column:
        mean = s["mean"] + (v - s["mean"]) / (s["k"] + 1)
        return F.struct((s["k"] + 1).alias("k"), mean.alias("mean"), (s["m2"] + (v - mean) * (v - s["mean"])).alias("m2"))

    start = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.when(F.size(values) >= n, F.aggregate(values, start, add, lambda s: F.sqrt(s["m2"] / (s["k"] - 1))))


def lag(x: Column | str, n: int = 1, by: str = "market", order: str = "day") -> Column:
    return F.lag(x, n).over(series(by, order))


def average_rank(x: Column, *by: str) -> Column:
    """Rank from one, ties sharing their mean rank; NULL for NULL."""
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / 2.0)


def pct_rank(x: Column | str, *by: str) -> Column:
    """average_rank over the count of values."""
    x = F.col(x) if isinstance(x, str) else x
    return average_rank(x, *by) / F.count(x).over(Window.partitionBy(*by))


def qcut_bucket(row_number: Column, n: Column, buckets: int) -> Column:
    """Quantile bucket of first-ranks, in whole numbers: 0 .. buckets - 1."""
    return F.when(n > 1, F.greatest(F.floor(((row_number - 1) * buckets + n - 2) / (n - 1)) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long")


def last_rank(values: Column) -> Column:
    """Average-tie percentile rank of the last entry among the non-null entries of an array; NULL for NULL."""
    last, live = F.element_at(values, -1), F.filter(values, lambda v: v.isNotNull())
    below, same = F.size(F.filter(live, lambda v: v < last)), F.size(F.filter(live, lambda v: v == last))
    return F.when(last.isNotNull(), (below + (same + 1) / 2.0) / F.size(live))
