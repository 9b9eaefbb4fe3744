"""Time-series features of bars (market, day, open .. quote_volume): one shuffle by market, one sort, many frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import EPS, frame, lag, last_rank, pct_rank, roll, roll_std, series

STATES = {"bull_quiet": 0, "bull_volatile": 1, "bear_quiet": 2, "bear_volatile": 3}


def ret(n: int = 1, close: str = "close") -> Column:
    """Return over n bars; null where the price before is zero."""
    return F.try_divide(F.col(close), lag(close, n)) - 1


def log_return() -> Column:
    return F.log(F.col("close") / lag("close") + EPS)


def with_volatility(bars: DataFrame, spans: tuple[int, ...] = (3, 7, 14, 21)) -> DataFrame:
    out = bars.withColumn("log_return_1d", log_return())
    return out.withColumns({f"vol_{n}d": roll(F.stddev_samp, "log_return_1d", n, max(2, n // 2)) for n in spans})


def range_contraction(n: int) -> Column:
    """Range of the n bars before the latest n, over that of the latest n: above one, it got quieter."""
    recent = (roll(F.max, "high", n) - roll(F.min, "low", n)) / (F.col("close") + EPS)
    before = (roll(F.max, "high", n, last=n) - roll(F.min, "low", n, last=n)) / (lag("close", n) + EPS)
    return before / (recent + EPS)


def volume_ratio(n: int, col: str = "volume") -> Column:
    return F.col(col) / (roll(F.avg, col, n) + EPS)


def with_volume_spike(bars: DataFrame) -> DataFrame:
    out = bars.withColumn("vol_pct", F.try_divide(F.col("volume"), lag("volume")) - 1)
    return out.withColumn("volume_spike_score", F.col("vol_pct") / (roll(F.stddev_samp, "vol_pct", 20) + EPS))


def with_rsi(bars: DataFrame, n: int = 14, min_periods: int = 7) -> DataFrame:
    """RSI by simple rolling means; the first bar's change counts as no gain and no loss."""
    d = F.coalesce(F.col("close") - lag("close"), F.lit(0.0))
    out = bars.withColumns({"gain": F.greatest(d, F.lit(0.0)), "loss": F.greatest(-d, F.lit(0.0))})
    rs = roll(F.avg, "gain", n, min_periods) / (roll(F.avg, "loss", n, min_periods) + EPS)
    return out.withColumn(f"rsi_{n}", 100 - 100 / (1 + rs))


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(market, day, macd, macdhist) by recursive means that start at the first value. A recursion over time
    has no window form, so each market's closes (one row a bar) go through pandas as one Arrow group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("day")
        mean = lambda x, n: x.ewm(span=n, adjust=False).mean()
        macd = mean(part["close"], fast) - mean(part["close"], slow)
        return pd.DataFrame({"market": part["market"], "day": part["day"], "macd": macd, "macdhist": macd - mean(macd, signal)})

    return bars.select("market", "day", "close").groupBy("market").applyInPandas(run, "market string, day date, macd double, macdhist double")


def with_bollinger(bars: DataFrame) -> DataFrame:
    """Position, width, and whether the width is the least of the last 24 (unknown counts as 0)."""
    mid, std = roll(F.avg, "close", 20), roll_std("close", 20)
    out = bars.withColumns({"bb_mid": mid, "bb_std": std})
    lower, upper = F.col("bb_mid") - 2 * F.col("bb_std"), F.col("bb_mid") + 2 * F.col("bb_std")
    out = out.withColumns({"bb_position": (F.col("close") - lower) / (upper - lower + EPS), "bb_width": (4 * F.col("bb_std")) / (F.col("bb_mid") + EPS)})
    return out.withColumn("squeeze_on", F.coalesce((roll(F.min, "bb_width", 24, 10) == F.col("bb_width")).cast("int"), F.lit(0)))


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(bars: DataFrame, n: int = 14, min_periods: int | None = None) -> DataFrame:
    out = bars.withColumn("tr", true_range())
    out = out.withColumn(f"atr_{n}", roll(F.avg, "tr", n, min_periods))
    return out.withColumn(f"atr_pct_{n}", F.col(f"atr_{n}") / (F.col("close") + EPS))


def regime(bars: DataFrame, ma: int = 200, rv: int = 30, lookback: int = 252, threshold: float = 0.5) -> DataFrame:
    """Of one benchmark: distance to its mean, volatility, its rolling percentile rank, and one of four states.
    An unknown distance or rank counts as not above, so the first bars are bear_quiet."""
    out = bars.withColumn("lr", log_return())
    out = out.withColumns({"btc_rv": roll(F.stddev_samp, "lr", rv), "mean": roll(F.avg, "close", ma)})
    ranks = F.collect_list(F.struct("btc_rv")).over(frame(lookback))
    out = out.withColumns({"btc_ma_distance": (F.col("close") - F.col("mean")) / (F.col("mean") + EPS), "values": F.transform(ranks, lambda s: s["btc_rv"])})
    full = F.size(F.filter("values", lambda v: v.isNotNull())) >= lookback
    out = out.withColumn("btc_intensity", F.when(full, last_rank(F.col("values"))))
    bull, wild = F.coalesce(F.col("btc_ma_distance") > 0, F.lit(False)), F.coalesce(F.col("btc_intensity") > threshold, F.lit(False))
    name = F.concat(F.when(bull, "bull").otherwise("bear"), F.when(wild, "_volatile").otherwise("_quiet"))
    ids = F.coalesce(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[name], F.lit(-1))
    return out.select("market", "day", "btc_ma_distance", "btc_rv", "btc_intensity", name.alias("btc_regime"), ids.alias("btc_regime_id"))


def with_width_rank(bars: DataFrame, n: int = 60, min_periods: int = 30) -> DataFrame:
    out = with_bollinger(bars)
    values = F.transform(F.collect_list(F.struct(F.round("bb_width", 12).alias("w"))).over(frame(n)), lambda s: s["w"])
    out = out.withColumn("values", values)
    live = F.size(F.filter("values", lambda v: v.isNotNull()))
    return out.withColumn(f"bb_width_pctile_{n}", F.when(live >= min_periods, last_rank(F.col("values")))).drop("values")


def with_turnover(bars: DataFrame) -> DataFrame:
    qv = F.coalesce(F.col("quote_volume"), F.col("volume") * F.col("close"))
    out = bars.withColumn("qv", qv)
    out = out.withColumns({"log_qv": F.log(F.col("qv") + 1), "qv_ma7": roll(F.avg, "qv", 7), "qv_ma30": roll(F.avg, "qv", 30)})
    out = out.withColumns({"qv_surge_7d": F.col("qv") / (F.col("qv_ma7") + EPS), "qv_surge_30d": F.col("qv") / (F.col("qv_ma30") + EPS), "qv_ma7_vs_ma30": F.col("qv_ma7") / (F.col("qv_ma30") + EPS)})
    return out.withColumn("qv_spiked_yday", F.coalesce((lag("qv_surge_7d") >= 3.0).cast("double"), F.lit(0.0)))


def with_position(bars: DataFrame) -> DataFrame:
    out = bars.withColumns({"hh20": roll(F.max, "high", 20), "ll20": roll(F.min, "low", 20), "hh60": roll(F.max, "high", 60), "hh7": roll(F.max, "high", 7), "ll7": roll(F.min, "low", 7)})
    c = F.col("close")
    out = out.withColumns({
        "pos_in_20d_range": (c - F.col("ll20")) / (F.col("hh20") - F.col("ll20") + EPS), "dist_from_20d_high": c / (F.col("hh20") + EPS) - 1, "dist_from_60d_high": c / (F.col("hh60") + EPS) - 1,
        "drawdown_7d": c / (F.col("hh7") + EPS) - 1, "bounce_off_7d_low": c / (F.col("ll7") + EPS) - 1,
    })
    return out.withColumn("near_20d_high", F.coalesce((F.col("dist_from_20d_high") >= -0.03).cast("double"), F.lit(0.0)))


def with_streak(bars: DataFrame, by: str = "market", order: str = "day") -> DataFrame:
    """Length of the run of rising closes that ends here: rows since the last close that didn't rise."""
    up = F.coalesce(F.col("close") > lag("close", by=by, order=order), F.lit(False))
    out = bars.withColumn("up", up).withColumn("island", F.sum(F.when(F.col("up"), 0).otherwise(1)).over(series(by, order)))
    return out.withColumn("up_streak", F.sum(F.col("up").cast("long")).over(Window.partitionBy(by, "island").orderBy(order)))


def panel(bars: DataFrame) -> DataFrame:
    """The leak-safe panel: raw indicators of every bar, all shifted by one bar, with this bar's labels. The
    frames share partition and order, so Spark sorts once."""
    b = with_position(with_turnover(with_atr(bars, min_periods=7)))
    b = with_rsi(b)
    b = b.withColumn("lr", log_return()).withColumns({**{f"ret_{n}d": ret(n) for n in (1, 3, 7, 14)}, "rv_7d": roll(F.stddev_samp, "lr", 7, 4), "rv_21d": roll(F.stddev_samp, "lr", 21, 10), "range_contraction_7d": range_contraction(7)})
    names = ["ret_1d", "ret_3d", "ret_7d", "ret_14d", "rv_7d", "rv_21d", "range_contraction_7d", "atr_pct_14", "log_qv", "qv_surge_7d", "qv_surge_30d", "qv_ma7_vs_ma30", "pos_in_20d_range", "dist_from_20d_high", "dist_from_60d_high", "drawdown_7d", "bounce_off_7d_low", "rsi_14"]
    o = F.col("open") + EPS
    return b.select("market", "day", "open", "high", "low", "close", *[lag(n).alias(f"f_{n}") for n in names], lag("qv").alias("f_universe_qv"), (F.col("high") / o - 1 >= 0.05).cast("double").alias("lab_up5"), (F.col("high") / o - 1).alias("high_ret"), (F.row_number().over(series()) - 1).alias("history"))


def with_session(bars: DataFrame) -> DataFrame:
    """Bars with the date of their session, which begins at 09:00, and their place in it."""
    out = bars.withColumn("session", F.to_date(F.col("ts") - F.expr("interval 9 hours")))
    return out.withColumn("i", F.row_number().over(Window.partitionBy("market", "session").orderBy("ts")))


def first_bars_vs_history(bars: DataFrame, k: int, days: int = 20, min_days: int = 5) -> DataFrame:
    """Volume of a session's first k bars against the mean of the sessions before."""
    first = with_session(bars).groupBy("session", "market").agg(F.sum(F.when(F.col("i") <= k, F.col("volume")).otherwise(0.0)).alias("first_vol"))
    w = Window.partitionBy("market").orderBy("session").rowsBetween(-days, -1)
    return first.withColumn("vs_history", F.when(F.count("*").over(w) >= min_days, F.try_divide(F.col("first_vol"), F.avg("first_vol").over(w))))
