"""Risk-adjusted figures of return series and their trades, extreme trades, contributions to a mean, sweeps of targets and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.portfolio import YEAR, equity
from tidemark.operators.ranks import quantiles


def risk_adjusted(returns: DataFrame, trades: DataFrame) -> DataFrame:
    """(series, days, cumulative, annualized, max_drawdown, calmar, profit_factor, win_loss, tail_ratio, common_sense). returns: (series, day, ret) on a calendar without gaps;
    trades: (series, net). Annualized over 365 days, null where all is lost; Calmar needs a drawdown, the profit factor and win/loss losses, the tail ratio a 5 % quantile that
    is not zero; common sense is profit factor times tail ratio. What lacks is null."""
    e = equity(returns).groupBy("series").agg(F.count("*").alias("days"), (F.max_by("equity", "day") - 1).alias("cumulative"), F.min("drawdown").alias("max_drawdown"))
    annual = F.when(1 + F.col("cumulative") > 0, F.pow(1 + F.col("cumulative"), F.try_divide(F.lit(float(YEAR)), F.col("days"))) - 1)
    e = e.withColumn("annualized", annual).withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.try_divide("annualized", F.abs("max_drawdown"))))
    won, lost = F.when(F.col("net") > 0, F.col("net")), F.when(F.col("net") < 0, F.col("net"))
    t = trades.groupBy("series").agg(F.try_divide(F.coalesce(F.sum(won), F.lit(0.0)), F.abs(F.sum(lost))).alias("profit_factor"), F.abs(F.try_divide(F.avg(won), F.avg(lost))).alias("win_loss"))
    q = quantiles(trades, "net", {"q05": 0.05, "q95": 0.95}, "series").select("series", F.abs(F.try_divide("q95", "q05")).alias("tail_ratio"))
    out = e.join(t, "series", "left").join(q, "series", "left")
    return out.withColumn("common_sense", F.col("profit_factor") * F.col("tail_ratio"))


def extreme_trades(ledger: DataFrame, k: int = 3, by: str = "model_id") -> DataFrame:
    """(by, side, place, trade_id, day, net_pct): the k best and k worst closed trades of each group, ties by trade_id. A partition keeps k of each before it is shuffled."""
    rows = ledger.where("status = 'closed' and net_pct is not null")
    out = None
    for side, order in (("best", F.desc("net_pct")), ("worst", F.asc("net_pct"))):
        place = F.row_number().over(Window.partitionBy(by).orderBy(order, "trade_id"))
        part = rows.withColumn("place", place).where(F.col("place") <= k).select(by, F.lit(side).alias("side"), "place", "trade_id", "day", "net_pct")
        out = part if out is None else out.unionByName(part)
    return out


def contributions(picks: DataFrame, days: DataFrame, key: str = "coin") -> DataFrame:
    """(key, contribution, share, place): how much each key adds to the mean daily delta of an arm over a control. picks: (day, key, arm +1 or -1, value); days: (day), those
    that count. A day's picks of an arm weigh alike, days weigh alike, and the contributions sum to the mean. place: by size, ties by name."""
    n = days.agg(F.count("*").alias("n_"))
    rows = picks.join(days, "day", "left_semi").withColumn("k_", F.count("*").over(Window.partitionBy("day", "arm")))
    per = rows.groupBy(key).agg(F.sum(F.col("arm") * F.col("value") / F.col("k_")).alias("s_")).crossJoin(F.broadcast(n))
    out = per.select(key, (F.col("s_") / F.col("n_")).alias("contribution"))
    whole = out.agg(F.sum("contribution").alias("w_"))
    place = F.row_number().over(Window.orderBy(F.round(F.abs("contribution"), 9).desc(), key))
    return out.crossJoin(F.broadcast(whole)).select(key, "contribution", F.try_divide("contribution", "w_").alias("share"), place.alias("place"))


def target_cost_sweep(rows: DataFrame, targets: list[float], costs: list[float]) -> DataFrame:
    """(target, cost, n, mean_net, win, cumulative) of rows (day, best, close: returns from the entry): the target where it was reached, else the close, less the cost;
    cumulative compounds day-equal means."""
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("cost")) for t in targets for c in costs])
    each = rows.select("day", "best", "close", F.explode(cells).alias("x")).select("day", "x.*", (F.when(F.col("best") >= F.col("x.target"), F.col("x.target")).otherwise(F.col("close")) - F.col("x.cost")).alias("net"))
    per = each.groupBy("target", "cost", "day").agg(F.count("*").alias("n"), F.sum("net").alias("s"), F.sum((F.col("net") > 0).cast("int")).alias("w"))
    return per.groupBy("target", "cost").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean_net"), (F.sum("w") / F.sum("n")).alias("win"), (F.exp(F.sum(F.log1p(F.col("s") / F.col("n")))) - 1).alias("cumulative"),
    )
