"""Features known before a row's day begins: market-wide trends, daily context for intraday rows, semi-volatility; and ranges of four-hour bars.

Everything is moved on by one row before it meets the row that may use it: frames end at the row before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import EPS, lag, pct_rank, roll, series
from tidemark.operators.features import ret, with_session


def market_trends(days: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(day, trends) of one row a day (day, breadth, pumps, adv_ratio, med_ret, turnover) and benchmark (day, bench_1, bench_3, bench_7): each value of the day before; means of
    3, 7 and 14 days up to the day before; turnover of 7 days over 30 and its z-score; breadth of 3 days less that of 14; and the decoupling, the share that
    rose less five times the benchmark's absolute move. Frames that aren't full are null."""
    order = Window.orderBy("day")

    def past(agg, c: str, n: int) -> Column:
        w = order.rowsBetween(-n, -1)
        return F.when(F.count(c).over(w) >= n, agg(c).over(w))

    rows = days.join(benchmark, "day", "left")
    names = ["breadth", "pumps", "adv_ratio", "med_ret", "turnover", "bench_1", "bench_3", "bench_7"]
    out = {f"{c}_lag1": F.lag(c).over(order) for c in names}
    out |= {f"{c}_ma{n}": past(F.avg, c, n) for c in ("breadth", "pumps", "adv_ratio") for n in (3, 7, 14)}
    out["turnover_7_30"] = past(F.avg, "turnover", 7) / (past(F.avg, "turnover", 30) + EPS)
    out["turnover_z30"] = (F.lag("turnover").over(order) - past(F.avg, "turnover", 30)) / (past(F.stddev_samp, "turnover", 30) + EPS)
    out["breadth_3_14"] = past(F.avg, "breadth", 3) - past(F.avg, "breadth", 14)
    out["decoupling"] = F.lag("adv_ratio").over(order) - F.abs(F.lag("bench_1").over(order)) * 5.0
    return rows.select("day", *[c.alias(n) for n, c in out.items()])


def day_context(bars: DataFrame) -> DataFrame:
    """(market, day, 7 values and 4 ranks) of daily bars, all of the bar before: returns of 3, 5 and 7 days, log return, mean range of 14 days (five at least), close, turnover; percentile ranks
    of the day's names by the first, third and fifth, and the dense rank by turnover, missing ones last."""
    raw = bars.withColumns({
        "roc_7d_": ret(7), "roc_3d_": ret(3), "log_ret_1d_": F.log(F.try_divide(F.col("close"), lag("close")) + EPS), "range_": (F.col("high") - F.col("low")) / (F.col("close") + EPS), "ret_5d_": ret(5), "d1_close_": F.col("close"), "d1_qv_": F.col("quote_volume"),
    }).withColumn("atr_pct_14_", roll(F.avg, "range_", 14, 5))
    names = ["roc_7d", "roc_3d", "log_ret_1d", "atr_pct_14", "ret_5d", "d1_close", "d1_qv"]
    rows = raw.select("market", "day", *[lag(f"{n}_").alias(n) for n in names])
    liquid = F.dense_rank().over(Window.partitionBy("day").orderBy(F.col("d1_qv").desc_nulls_last()))
    return rows.withColumns({"roc7_rank": pct_rank("roc_7d", "day"), "roc3_rank": pct_rank("roc_3d", "day"), "liq_rank": liquid, "atr_rank": pct_rank("atr_pct_14", "day")})


def contractions(bars: DataFrame, days: tuple[int, ...] = (3, 7, 14), a_day: int = 6, mean_of: int = 7, least: int = 60) -> DataFrame:
    """(market, session, contraction of each span, mean range): range of the bars of the K days before the last K over that of the last K, both against the current close, and the mean
    range of bars over `mean_of` days; each the session's last value. A bar needs more than twice its span of bars; markets of under `least` bars are left out."""
    row, every = Window.partitionBy("market").orderBy("ts"), Window.partitionBy("market")
    rows = with_session(bars).withColumns({"k_": F.row_number().over(row) - 1, "n_": F.count("*").over(every)}).where((F.col("n_") >= least) & (F.col("close") > 0))
    span = lambda a, b: (F.max("high").over(row.rowsBetween(a, b)) - F.min("low").over(row.rowsBetween(a, b))) / F.col("close")
    values = {f"rc4h_{d}d": F.when(F.col("k_") >= 2 * d * a_day, span(-(2 * d * a_day - 1), -d * a_day) / (span(-(d * a_day - 1), 0) + EPS)) for d in days}
    w = mean_of * a_day
    values["rc4h_atr_pct"] = F.when(F.col("k_") >= 2 * w, F.avg(F.col("high") - F.col("low")).over(row.rowsBetween(-(w - 1), 0)) / F.col("close"))
    told = rows.select("market", "session", "ts", *[v.alias(n) for n, v in values.items()])
    return told.groupBy("market", "session").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("ts"))).alias(n) for n in values]).where(" or ".join(f"{n} is not null" for n in values))


def semivolatilities(bars: DataFrame) -> DataFrame:
    """(market, day, source_day, downside 7 and 21, upside 21, asymmetry, known): roots of mean squared falls and rises of returns up to the bar before, over full frames only; known says
    that the newest return's day is before the row's."""
    r = bars.withColumn("r_", ret())
    sq = r.withColumns({"down_": F.pow(F.least("r_", F.lit(0.0)), 2), "up_": F.pow(F.greatest("r_", F.lit(0.0)), 2)})
    sq = sq.withColumns({c: F.when(F.col("r_").isNotNull(), F.col(c)) for c in ("down_", "up_")})
    past = lambda c, n: F.sqrt(roll(F.avg, c, n, last=1))
    out = sq.select("market", "day", F.lag("day").over(series()).alias("source_day"), past("down_", 7).alias("downside_semivol_7"), past("down_", 21).alias("downside_semivol_21"), past("up_", 21).alias("upside_semivol_21"))
    return out.withColumns({"semivol_asym_21": F.col("upside_semivol_21") - F.col("downside_semivol_21"), "known": F.coalesce(F.col("source_day") < F.col("day"), F.lit(False))})
