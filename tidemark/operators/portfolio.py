"""Portfolio and risk analytics over a daily return series (series, day, ret) and trade ledgers.

Windows run within a series, one row a day; the trades behind it are aggregated first.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.ranks import with_sums_before

YEAR, EULER = 365, 0.5772156649015329
# The rational approximation of the normal quantile, highest power first, and where its tails begin.
QUANTILE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
QUANTILE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
QUANTILE_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QUANTILE_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
QUANTILE_LOW = 0.02425


def series_window() -> WindowSpec:
    return Window.partitionBy("series").orderBy("day")


def running() -> WindowSpec:
    return series_window().rowsBetween(Window.unboundedPreceding, 0)


def daily_returns(ledger: DataFrame, series: str = "model_id", until: str | None = None) -> DataFrame:
    """(series, day, ret): day-equal mean return on a calendar without gaps; idle days are zero. Nothing after `until` counts."""
    rows = ledger.where("status = 'closed'").withColumnRenamed(series, "series")
    rows = rows.where(F.col("day") <= F.lit(until).cast("date")) if until else rows
    days = rows.groupBy("series", "day").agg((F.avg("net_pct") / 100).alias("r"))
    calendar = days.groupBy("series").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("series", F.explode(F.sequence("a", "b")).alias("day"))
    return calendar.join(days, ["series", "day"], "left").select("series", "day", F.coalesce("r", F.lit(0.0)).alias("ret"))


def equity(returns: DataFrame) -> DataFrame:
    """Compounded equity from one, its running peak (one included), and the drawdown."""
    e = F.exp(F.sum(F.log1p("ret")).over(running()))
    out = returns.withColumn("equity", e)
    return out.withColumn("peak", F.greatest(F.max("equity").over(running()), F.lit(1.0))).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def ratios(returns: DataFrame) -> DataFrame:
    """Sharpe and Sortino a year, zero where undefined."""
    down = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2)))
    s = returns.groupBy("series").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), down.alias("down"), F.count("*").alias("n"))
    safe = lambda x: F.coalesce(F.when(F.col(x) > 0, F.col("mean") / F.col(x) * math.sqrt(YEAR)), F.lit(0.0))
    return s.withColumns({"sharpe": safe("std"), "sortino": safe("down")})


def headline(ledger: DataFrame, by: str = "model_id") -> DataFrame:
    """Win rate, profit factor, expectancy, mean win and loss of closed trades."""
    x = F.col("net_pct")
    return ledger.where("status = 'closed'").groupBy(by).agg(
        F.count("*").alias("trades"), F.avg((x > 0).cast("int")).alias("win_rate"), (F.sum(F.greatest(x, F.lit(0.0))) / F.nullif(F.sum(F.greatest(-x, F.lit(0.0))), F.lit(0.0))).alias("profit_factor"),
        F.avg(x).alias("expectancy"), F.avg(F.when(x > 0, x)).alias("mean_win"), F.avg(F.when(x < 0, x)).alias("mean_loss"), F.max(x).alias("best"), F.min(x).alias("worst"),
    )


def moments(returns: DataFrame) -> DataFrame:
    """Bias-corrected skewness (null under three days or without spread) and excess kurtosis (under four), 5 % value at risk and its tail mean, tail ratio (null
    where the value at risk is zero), ulcer index, recovery (end return over the deepest drawdown, null without one)."""
    n = F.col("n")
    base = returns.groupBy("series").agg(F.count("ret").alias("n"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"), F.percentile("ret", 0.05).alias("var95"), F.percentile("ret", 0.95).alias("q95"))
    tail = returns.join(base.select("series", "var95"), "series").where("ret <= var95").groupBy("series").agg(F.avg("ret").alias("cvar95"))
    ulcer = equity(returns).groupBy("series").agg(F.sqrt(F.avg(F.pow("drawdown", 2))).alias("ulcer"), F.min("drawdown").alias("max_drawdown"), (F.max_by("equity", "day") - 1).alias("end_return"))
    out = base.join(tail, "series").join(ulcer, "series")
    return out.withColumns({
        "skew": F.when(n > 2, F.nanvl("g1", F.lit(None)) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)), "kurt": F.when(n > 3, F.try_divide(((n + 1) * F.nanvl("g2", F.lit(None)) + 6) * (n - 1), (n - 2) * (n - 3))),
        "tail_ratio": F.abs(F.try_divide("q95", "var95")), "recovery": F.when(F.col("max_drawdown") < 0, F.try_divide("end_return", F.abs("max_drawdown"))),
    })


def streaks(ledger: DataFrame, by: str = "model_id") -> DataFrame:
    """Longest runs of winning and losing closed trades in order of (day, trade_id); rows without a result are left out.

    Wins with one number of losses before them are one run, and losses with one number of wins: counts over ranges of all rows, so that no task holds a model.
    """
    rows = ledger.where("status = 'closed' and net_pct is not null").withColumn("win", F.col("net_pct") > 0).select(by, "day", "trade_id", "win", F.col("win").cast("int").alias("w_"), (~F.col("win")).cast("int").alias("l_"))
    run = with_sums_before(rows, [F.col(by).asc(), F.col("day").asc(), F.col("trade_id").asc()], ["w_", "l_"])
    runs = run.groupBy(by, "win", F.when(F.col("win"), F.col("l__before")).otherwise(F.col("w__before")).alias("run_")).agg(F.count("*").alias("n"))
    return runs.groupBy(by).agg(F.max(F.when(F.col("win"), F.col("n"))).alias("win_streak"), F.max(F.when(~F.col("win"), F.col("n"))).alias("loss_streak"))


def normal_cdf(z: Column) -> Column:
    """By the fixed rational approximation 26.2.17 of Abramowitz and Stegun; error under 1e-7."""
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = sum((F.lit(c) * F.pow(t, i + 1) for i, c in enumerate(b)), F.lit(0.0))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_inverse(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1 by a fixed rational approximation in three parts; relative error under 1.2e-9. Null outside."""
    poly = lambda x, cs: functools.reduce(lambda acc, c: acc * x + c, cs[1:], F.lit(cs[0]))
    q = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = poly(q, QUANTILE_C) / (poly(q, QUANTILE_D) * q + 1)
    r = (p - 0.5) * (p - 0.5)
    middle = poly(r, QUANTILE_A) * (p - 0.5) / (poly(r, QUANTILE_B) * r + 1)
    return F.when((p > 0) & (p < 1), F.when(p < QUANTILE_LOW, tail).when(p > 1 - QUANTILE_LOW, -tail).otherwise(middle))


def expected_maximum(trials: Column) -> Column:
    """The expected maximum of that many independent standard normal trials; zero for one."""
    k = trials.cast("double")
    return F.when(k > 1, (1 - EULER) * normal_inverse(1 - 1 / k) + EULER * normal_inverse(1 - 1 / (k * math.e))).when(k == 1, 0.0)


def sharpe_variance(sr: Column) -> Column:
    """The variance term of a Sharpe ratio from skew and kurt (excess); at least 1e-9. Series too short for a kurtosis have null."""
    return F.greatest(1 - F.col("skew") * sr + (F.col("kurt") + 2) / 4 * sr * sr, F.lit(1e-9))


def deflated_sharpe(returns: DataFrame, trials: Column, confidence: float = 0.95) -> DataFrame:
    """probabilistic_sharpe with the ratio that the best of `trials` strategies without skill is expected to show (sr_threshold), the probability of beating
    that (dsr), and the days that it takes to beat it with `confidence` (min_track, null where the ratio is no higher)."""
    p = probabilistic_sharpe(returns).withColumn("trials", trials)
    p = p.withColumn("sr_threshold", F.try_divide(expected_maximum(F.col("trials")), F.sqrt("n")))
    gap, need = F.col("sr") - F.col("sr_threshold"), normal_inverse(F.lit(confidence))
    z = F.try_divide(gap * F.sqrt(F.col("n") - 1), F.sqrt(sharpe_variance(F.col("sr"))))
    track = F.when(gap > 0, 1 + sharpe_variance(F.col("sr_threshold")) * F.pow(F.try_divide(need, gap), 2))
    return p.withColumns({"dsr": normal_cdf(z), "min_track": track})


def probabilistic_sharpe(returns: DataFrame, benchmark: float = 0.0) -> DataFrame:
    m = moments(returns).select("series", "n", "skew", "kurt")
    s = returns.groupBy("series").agg(F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sr"))
    out = m.join(s, "series")
    z = F.try_divide((F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1), F.sqrt(sharpe_variance(F.col("sr"))))
    return out.withColumn("z", z).withColumn("psr", normal_cdf(F.col("z")))


def against_benchmark(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beta, alpha, correlation, R², tracking error and information ratio on shared days, null where they don't exist. benchmark: (day, bench)."""
    r = returns.join(benchmark, "day")
    d = F.col("ret") - F.col("bench")
    return r.groupBy("series").agg(
        F.count("*").alias("n"), F.regr_slope("ret", "bench").alias("beta"), F.regr_intercept("ret", "bench").alias("alpha"), F.try_divide(F.covar_pop("ret", "bench"), F.stddev_pop("ret") * F.stddev_pop("bench")).alias("corr"), F.regr_r2("ret", "bench").alias("r2"),
        F.stddev_samp(d).alias("tracking_error"), (F.try_divide(F.avg(d), F.stddev_samp(d)) * math.sqrt(YEAR)).alias("information_ratio"),
    )


def alpha_test(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Alpha of the regression on the benchmark, its standard error and t on n - 2 degrees; null under three days or without spread."""
    r = returns.join(benchmark, "day").groupBy("series").agg(
        F.regr_count("ret", "bench").alias("n"), F.regr_intercept("ret", "bench").alias("alpha"), F.regr_r2("ret", "bench").alias("r2"),
        *(f("ret", "bench").alias(c) for f, c in [(F.regr_sxx, "sxx"), (F.regr_syy, "syy"), (F.regr_sxy, "sxy"), (F.regr_avgx, "ax")]),
    )
    sxx = F.nullif(F.col("sxx"), F.lit(0.0))
    left = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / sxx, F.lit(0.0)) / F.nullif(F.col("n") - 2, F.lit(0))
    se = F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.sqrt(left * (1 / F.col("n") + F.col("ax") * F.col("ax") / sxx)))
    return r.withColumn("alpha_se", se).withColumn("alpha_t", F.when(F.col("alpha_se") > 0, F.col("alpha") / F.col("alpha_se"))).drop("sxx", "syy", "sxy", "ax")


def drawdown_episodes(returns: DataFrame, top: int = 3) -> DataFrame:
    """The deepest episodes of each series: from the first day under the peak to recovery or the open end."""
    e = equity(returns).withColumn("at_peak", F.col("drawdown") >= -1e-12).withColumn("island", F.sum(F.col("at_peak").cast("int")).over(running()))
    last = e.groupBy("series").agg(F.max("day").alias("end"))
    ep = e.where(~F.col("at_peak")).groupBy("series", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min("drawdown").alias("depth"), F.min_by("day", "drawdown").alias("valley"), F.count("*").alias("length"))
    ep = ep.join(last, "series").withColumn("recovered", F.col("last_day") < F.col("end"))
    return ep.withColumn("i", F.row_number().over(Window.partitionBy("series").orderBy(F.round("depth", 12), "first_day"))).where(F.col("i") <= top)


def rolling_sharpe(returns: DataFrame, n: int = 30) -> DataFrame:
    w = series_window().rowsBetween(-(n - 1), 0)
    return returns.withColumn("rolling_sharpe", F.when((F.count("ret").over(w) >= n) & (F.stddev_samp("ret").over(w) > 0), F.avg("ret").over(w) / F.stddev_samp("ret").over(w) * math.sqrt(YEAR)))


def monthly(returns: DataFrame) -> DataFrame:
    return returns.groupBy("series", F.trunc("day", "month").alias("month")).agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("month_ret"), F.count("*").alias("days"))


def positional_folds(ledger: DataFrame, folds: int, by: str = "model_id") -> DataFrame:
    """Chronological folds whose sizes differ by one at most, the longer ones first."""
    rows = ledger.where("status = 'closed'").select(by, "day", "trade_id", "net_pct", F.lit(1).alias("one_"))
    run = with_sums_before(rows, [F.col(by).asc(), F.col("day").asc(), F.col("trade_id").asc()], ["one_"])
    rows = run.join(run.groupBy(by).agg(F.min("one__before").alias("base_"), F.count("*").alias("n")), by).withColumn("i", F.col("one__before") - F.col("base_"))
    q, m = F.floor(F.col("n") / folds), F.col("n") % folds
    fold = F.when(F.col("i") < m * (q + 1), F.floor(F.col("i") / (q + 1))).otherwise(m + F.floor(F.try_divide(F.col("i") - m * (q + 1), q)))
    return rows.withColumn("fold", fold).groupBy(by, "fold").agg(F.count("*").alias("trades"), F.avg("net_pct").alias("mean_net"))


def sized(ledger: DataFrame, cap: float = 0.3) -> DataFrame:
    """Position weights of a day: equal, by probability, quarter Kelly, and capped with the rest given to those with room."""
    day = Window.partitionBy("day")
    p = ((F.col("trade_id") % 40) + 10) / 60
    rows = ledger.withColumn("p", p).withColumns({"w_equal": 1 / F.count("*").over(day), "w_prob": F.try_divide(F.col("p"), F.sum("p").over(day)), "kelly": F.greatest((F.col("p") * 2 - (1 - F.col("p"))) / 2, F.lit(0.0)) / 4})
    over = F.greatest(F.col("w_prob") - cap, F.lit(0.0))
    room = F.greatest(F.lit(cap) - F.col("w_prob"), F.lit(0.0))
    rows = rows.withColumns({"over": F.sum(over).over(day), "room": F.sum(room).over(day)})
    return rows.withColumn("w_capped", F.least(F.col("w_prob"), F.lit(cap)) + F.when(F.col("room") > 0, room / F.col("room") * F.least("over", "room")).otherwise(0.0))


def halted(returns: DataFrame, loss: float, depth: float, cool_days: int) -> DataFrame:
    """Days silenced by a daily loss or drawdown limit breached within the cool-down before them."""
    e = equity(returns).withColumn("breach", ((F.col("ret") <= -loss) | (F.col("drawdown") <= -depth)).cast("int")).withColumn("t", F.datediff("day", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("series").orderBy("t").rangeBetween(-cool_days, -1)
    return e.withColumn("silenced", F.coalesce(F.max("breach").over(w), F.lit(0)))


def basket_forward(bars: DataFrame, top: int, n: int) -> DataFrame:
    """Equal-weight day return of the most traded names, compounded over the next n days from each day on."""
    w = Window.partitionBy("market").orderBy("day")
    rows = bars.withColumns({"r": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, "liq": F.rank().over(Window.partitionBy("day").orderBy(F.desc("quote_volume")))}).where((F.col("liq") <= top) & F.col("r").isNotNull())
    days = rows.groupBy("day").agg(F.avg("r").alias("basket"))
    f = Window.orderBy("day").rowsBetween(0, n - 1)
    return days.withColumn("forward", F.when(F.count("basket").over(f) >= n, F.exp(F.sum(F.log1p("basket")).over(f)) - 1))
