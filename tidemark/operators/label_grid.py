"""A grid of label definitions from one pass: target x close x draw-down x horizon, by regime and liquidity.

For a target, a path is told by three things: the bar that reaches it first, the lowest price up to that bar, and the close. Paths are
counted by the classes that these fall in, for each target; every cell of the grid is then a sum of classes. The data are
read once and multiplied by the targets only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Grid(NamedTuple):
    """In percent, and in hours; a path has `bars` bars of `bar_hours` at most."""

    targets: tuple[float, ...] = (3, 5, 7, 10, 15, 20)
    closes: tuple[float, ...] = (0, 2, 3, 5)
    drawdowns: tuple[float, ...] = (2, 3, 5)
    horizons: tuple[int, ...] = (4, 8, 12, 24)
    bars: int = 6
    bar_hours: int = 4


def session_paths(bars: DataFrame, grid: Grid) -> DataFrame:
    """(market, session, open, close, path) of bars (market, session, i, open, high, low, close), i from one: the open of the first and close of the last bar
    of the session, and its first bars as running highest and lowest prices. Sessions whose open is not positive go."""
    rows = bars.groupBy("market", "session").agg(
        F.min_by("open", "i").alias("open"), F.max_by("close", "i").alias("close"),
        F.array_sort(F.collect_list(F.when(F.col("i") <= grid.bars, F.struct("i", "high", "low")))).alias("bars"),
    ).where("open > 0")
    start = F.array().cast("array<struct<top:double,bottom:double>>")

    def grow(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.struct(F.greatest(last["top"], b["high"]).alias("top"), F.least(last["bottom"], b["low"]).alias("bottom"))))

    return rows.withColumn("path", F.aggregate("bars", start, grow)).drop("bars")


def label_grid(paths: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """A row a cell (regime, tier, target, close, drawdown, horizon): paths, hits (the target is reached within the horizon), successes (no draw-down before the hit, and the
    close held), their rates, the mean close where nothing hit and its 5 % quantile (in whole basis points), the mean close of hits that failed, and of
    successes the mean hours to the hit and the mean draw-down before it. Rates are shares; means without rows are null.

    paths: (regime, tier, open, close, path), path as in session_paths. Regime and tier also come as 'all'; null ones are called unknown.
    """
    end = F.col("close") / F.col("open") - 1
    each = paths.select(F.coalesce("regime", F.lit("unknown")).alias("regime"), F.coalesce("tier", F.lit("unknown")).alias("tier"), "open", end.alias("end"), "path", F.explode(F.array(*[F.lit(float(t)) for t in grid.targets])).alias("target"))
    level = F.col("open") * (1 + F.col("target") / 100)
    first = F.size(F.filter("path", lambda b: b["top"] < level))  # bars before the hit: the running highest price only rises
    hit = first < F.size("path")
    low = F.get("path", first)["bottom"] / F.col("open") - 1
    closes = sum((F.when(F.col("end") >= c / 100, 1).otherwise(0) for c in grid.closes), F.lit(0))
    # How many closes are reached, and how many draw-downs the path stays above.
    depth = sum((F.when(low >= -dd / 100, 1).otherwise(0) for dd in grid.drawdowns), F.lit(0))
    classes = each.select("regime", "tier", "target", F.when(hit, first).alias("bar"), F.when(hit, depth).alias("held"), closes.alias("closed"), F.round(F.col("end") * 10000).cast("int").alias("bp"), "end", low.alias("low"))
    told = classes.groupBy("regime", "tier", "target", "bar", "held", "closed", "bp").agg(F.count("*").alias("n"), F.sum("end").alias("ends"), F.sum("low").alias("lows"))
    both = told.withColumn("regime", F.explode(F.array(F.col("regime"), F.lit("all")))).withColumn("tier", F.explode(F.array(F.col("tier"), F.lit("all"))))
    by = ["regime", "tier", "target", "bar", "held", "closed", "bp"]
    both = both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "ends", "lows")])
    cells = F.array(*[
        F.struct(F.lit(float(c)).alias("close"), F.lit(float(dd)).alias("drawdown"), F.lit(h).alias("horizon"), F.lit(i).alias("c_"), F.lit(sum(1 for other in grid.drawdowns if other >= dd)).alias("d_"), F.lit(max(1, min(grid.bars, h // grid.bar_hours))).alias("h_"))
        for i, c in enumerate(sorted(grid.closes), 1) for dd in grid.drawdowns for h in grid.horizons
    ])
    rows = both.select("*", F.explode(cells).alias("x")).select(*both.columns, "x.*")
    hit = F.col("bar").isNotNull() & (F.col("bar") < F.col("h_"))
    # A path that stays above a draw-down stays above all deeper ones.
    success = hit & (F.col("held") >= F.col("d_")) & (F.col("closed") >= F.col("c_"))
    some = lambda when, c: F.sum(F.when(when, F.col(c)))
    mean = lambda when, c: F.try_divide(some(when, c), some(when, "n"))
    out = rows.groupBy("regime", "tier", "target", "close", "drawdown", "horizon").agg(
        F.sum("n").alias("n"), F.coalesce(some(hit, "n"), F.lit(0)).alias("hits"), F.coalesce(some(success, "n"), F.lit(0)).alias("successes"), mean(~hit, "ends").alias("no_hit_end"),
        (F.percentile(F.when(~hit, F.col("bp")), 0.05, F.col("n")) / 10000).alias("no_hit_worst"), mean(hit & ~success, "ends").alias("failed_end"),
        F.try_divide(F.sum(F.when(success, (F.col("bar") + 1) * F.col("n"))) * grid.bar_hours, some(success, "n")).alias("hit_hours"), mean(success, "lows").alias("success_low"),
    )
    return out.withColumns({"hit_rate": F.col("hits") / F.col("n"), "base_rate": F.col("successes") / F.col("n")})
