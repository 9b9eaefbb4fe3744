"""What a market showed just before a session ended: snapshots at one exact bar, from bars up to that bar only.

A session runs from 09:00 to 09:00. Row windows give each bar the mean volume and highest price of the bars before it; one grouping by session
then takes the snapshot bar, the bars shortly before it, and all of the session so far. A session without the snapshot bar has none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import with_session

TINY = 1e-9


class Snapshot(NamedTuple):
    """unit: the name of one bar; at: minutes from the session's start to the snapshot bar; step: minutes of a bar; before: bars of the prior mean; least: bars
    that a market must have; looks: name -> minutes from the first bar of a look-back to the snapshot; clock: how the moment is called."""

    unit: str
    at: int
    step: int
    before: int
    least: int
    looks: dict[str, int]
    clock: str


# The snapshot at 08:00 of hourly bars, and that at 08:30 of quarter hours.
HOURLY = Snapshot("1h", 22 * 60, 60, 24, 30, {"3h": 120}, "08h")
QUARTERS = Snapshot("15m", 23 * 60 + 15, 15, 96, 100, {"30m": 15, "1h": 45, "3h": 165}, "0830")


def over(a: Column, b: Column) -> Column:
    """a / b - 1; null unless b is positive."""
    return F.when(b > 0, a / b - 1)


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def snapshot(bars: DataFrame, benchmark: DataFrame, spec: Snapshot) -> DataFrame:
    """(market, session, columns) of bars (market, ts, open, high, low, close, volume). benchmark: (ts, bench), its return to each bar.

    For hourly bars 15 columns, for quarter hours 19: return, volume against the prior mean, range and close position of the snapshot bar; return and volume of
    each look-back; the break over the prior high; the benchmark; highest and lowest of the session against its open, the close against
    both, volume so far; and the breadth, the share of markets whose snapshot bar rose. Prior values need half their bars.
    Prices and means that are not positive give nulls.
    """
    w = Window.partitionBy("market").orderBy("ts").rowsBetween(-spec.before, -1)
    half = F.count(F.lit(1)).over(w) >= spec.before // 2
    rows = with_session(bars).withColumns({
        "mean_": F.when(half, F.avg("volume").over(w)), "top_": F.when(half, F.max("high").over(w)), "n_": F.count(F.lit(1)).over(Window.partitionBy("market")),
        "ago_": spec.at - ((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("session").cast("timestamp"))) / 60 - 9 * 60),
    })
    so_far = rows.where((F.col("ago_") >= 0) & (F.col("n_") >= spec.least))
    now = F.col("ago_") == 0
    at = lambda c: F.max(F.when(now, F.col(c)))
    aggs = [at(c).alias(f"{c}_") for c in ("open", "high", "low", "close", "volume", "ts")] + [at("mean_").alias("mean"), at("top_").alias("top"), F.count(F.when(now, 1)).alias("there")]
    for name, minutes in {**spec.looks, "day": 24 * 60}.items():
        inside = F.col("ago_") <= minutes
        aggs += [
            F.min_by("open", F.when(inside, F.col("ts"))).alias(f"first_{name}"), F.sum(F.when(inside, F.col("volume"))).alias(f"vol_{name}"),
            F.max(F.when(inside, F.col("high"))).alias(f"high_{name}"), F.min(F.when(inside, F.col("low"))).alias(f"low_{name}"),
        ]
    s = so_far.groupBy("market", "session").agg(*aggs).where("there > 0").withColumnRenamed("ts_", "at_")
    s = s.join(benchmark.select(F.col("ts").alias("at_"), "bench"), "at_", "left")
    c, o, mean = F.col("close_"), F.col("open_"), F.col("mean")
    u, clock = spec.unit, spec.clock
    out = {f"pre{u}_ret": over(c, o), f"pre{u}_vol_ratio": share(F.col("volume_"), mean), f"pre{u}_range_pct": share(F.col("high_") - F.col("low_"), o), f"pre{u}_close_position": (c - F.col("low_")) / F.greatest(F.col("high_") - F.col("low_"), F.lit(TINY))}
    for name, minutes in spec.looks.items():
        out[f"pre{name}_ret"] = over(c, F.col(f"first_{name}"))
        out[f"pre{name}_vol_ratio"] = share(F.col(f"vol_{name}"), mean * (minutes // spec.step + 1))
    width = F.col("high_3h") - F.col("low_3h")
    out |= {"range_5_to_8_expansion": share(width, o)} if spec is HOURLY else {"pre3h_range_pct": share(width, F.col("first_3h"))}
    close = "close07" if spec is HOURLY else "close0830"
    out |= {
        "breakout_24h_high": over(c, F.col("top")), f"pre{u}_btc_ret": F.col("bench"), f"cum_max_ret_to_{clock}": over(F.col("high_day"), F.col("first_day")), f"cum_dd_to_{clock}": over(F.col("low_day"), F.col("first_day")),
        f"{close}_vs_cum_high": over(c, F.col("high_day")), f"{close}_vs_day_open": over(c, F.col("first_day")), f"cum_volume_to_{clock}": share(F.col("vol_day"), mean * (spec.at // spec.step + 1)),
        f"pre{u}_breadth": F.avg(F.coalesce(over(c, o) > 0, F.lit(False)).cast("double")).over(Window.partitionBy("session")),
    }
    return s.select("market", "session", *[v.alias(n) for n, v in out.items()])


def fifth_bar(bars: DataFrame) -> DataFrame:
    """(market, session, 7 columns) of four-hour bars: the session's fifth bar against the four before it and against the session so far. Sessions of fewer bars have none."""
    rows = with_session(bars).where("i <= 5")
    at = lambda c: F.max(F.when(F.col("i") == 5, F.col(c)))
    s = rows.groupBy("market", "session").agg(
        *[at(c).alias(f"{c}_") for c in ("open", "high", "low", "close", "volume")], F.avg(F.when(F.col("i") < 5, F.col("volume"))).alias("mean"), F.min_by("open", "i").alias("first"),
        F.max("high").alias("top"), F.min("low").alias("bottom"), F.count("*").alias("n"),
    ).where("n = 5")
    tiny = lambda x: F.greatest(x, F.lit(TINY))
    o, h, lo, c = (F.col(f"{x}_") for x in ("open", "high", "low", "close"))
    return s.select(
        "market", "session", (F.col("volume_") / tiny(F.col("mean"))).alias("pre_vol_ratio"), (c / tiny(o) - 1).alias("pre_price_change"), ((h - lo) / tiny(o)).alias("pre_range_pct"),
        ((c - lo) / tiny(h - lo)).alias("pre_close_position"), (F.col("top") / tiny(F.col("first")) - 1).alias("pre_day_to_bar5_max"), (F.col("bottom") / tiny(F.col("first")) - 1).alias("pre_day_to_bar5_dd"),
        (c / tiny(F.col("top")) - 1).alias("pre_bar5_close_vs_day_high"),
    )


def benchmark_hourly(bars: DataFrame) -> DataFrame:
    """(ts, bench): return over the bar before."""
    return bars.select("ts", over(F.col("close"), F.lag("close").over(Window.orderBy("ts"))).alias("bench"))


def benchmark_quarters(bars: DataFrame) -> DataFrame:
    """(ts, bench): close against the open of three bars before."""
    return bars.select("ts", over(F.col("close"), F.lag("open", 3).over(Window.orderBy("ts"))).alias("bench"))
