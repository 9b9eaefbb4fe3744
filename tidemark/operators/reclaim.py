"""Reclaim entries after a pump: a window of bars that cools off, an entry right after it, and one after the first close above it.

Each pump meets the bars that follow its session by their number, so a pump brings as many rows as its window, search and hold have bars.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.closing import first_index
from tidemark.operators.features import with_session


class Setup(NamedTuple):
    """pump: least rise of a session over its open; top: names by turnover that count; window, search, hold: bars; cool: the window's last close is at most this against the pump's
    high; atr: mean ranges of the window under its low, where the stop is; target: of both entries."""

    pump: float = 0.12
    top: int = 100
    window: int = 6
    search: int = 12
    hold: int = 12
    cool: float = -0.03
    atr: float = 0.5
    target: float = 0.08


def pumps(bars: DataFrame, setup: Setup) -> DataFrame:
    """(market, session, pump_high, first): sessions that rose enough among the most traded of the day, and the number of the bar after them."""
    numbered = with_session(bars).withColumn("k", F.row_number().over(Window.partitionBy("market").orderBy("ts")) - 1)
    s = numbered.groupBy("market", "session").agg(F.min_by("open", "k").alias("open"), F.max("high").alias("pump_high"), F.sum("quote_volume").alias("qv"), (F.max("k") + 1).alias("first"))
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.col("qv").desc_nulls_last(), "market"))
    return s.withColumn("place", place).where((F.col("open") > 0) & (F.col("pump_high") / F.col("open") - 1 >= setup.pump) & (F.col("place") <= setup.top)).select("market", "session", "pump_high", "first")


def walk(path: Column, at: Column | int, stop: Column, target: float, hold: int) -> Column:
    """struct(gross, hit) of an entry at the open of bar `at`: the stop's price wins a shared bar (hit 0), then the target (1), else the last close (null)."""
    entry = F.get(path, at if isinstance(at, Column) else F.lit(at))["open"]
    inside = lambda b: (b["idx"] >= at) & (b["idx"] < at + hold)
    i, j = first_index(path, lambda b: inside(b) & (b["low"] <= stop)), first_index(path, lambda b: inside(b) & (b["high"] >= entry * (1 + target)))
    by_stop = i.isNotNull() & (j.isNull() | (i <= j))
    last = F.get(path, at + F.lit(hold - 1))["close"] / entry - 1
    gross = F.when(by_stop, stop / entry - 1).when(j.isNotNull(), target).otherwise(last)
    return F.when(entry > 0, F.struct(gross.alias("gross"), F.when(by_stop, 0).when(j.isNotNull(), 1).alias("hit")))


def reclaims(bars: DataFrame, setup: Setup = Setup(), cost: float = 0.0015) -> DataFrame:
    """A row a pump whose market has bars enough after it (the window, the search and one more): what its window shows (no new high, cooled, contracting, a higher low), armed if all
    hold and the hold fits, the stop, the immediate entry's net and hit, and for the first close above the window within the search its place and the net of the next open (null
    where the hold doesn't fit). Prices that are not positive give no entry."""
    w, n = setup.window, setup.window + setup.search + setup.hold + 1
    numbered = bars.withColumns({"k": F.row_number().over(Window.partitionBy("market").orderBy("ts")) - 1, "bars": F.count("*").over(Window.partitionBy("market"))})
    asked = pumps(bars, setup).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("k", F.col("first") + F.col("idx"))
    rows = asked.join(numbered.select("market", "k", "bars", "open", "high", "low", "close"), ["market", "k"])
    per = rows.groupBy("market", "session", "pump_high", "first", "bars").agg(F.array_sort(F.collect_list(F.struct("idx", "open", "high", "low", "close"))).alias("path")).where(F.col("first") + w + setup.search + 1 < F.col("bars"))
    part = lambda a, b: F.slice("path", a + 1, b - a)
    prices = lambda x, c: F.transform(x, lambda b: b[c])
    mean_range = lambda x: F.aggregate(F.transform(x, lambda b: b["high"] - b["low"]), F.lit(0.0), lambda acc, v: acc + v) / F.size(x)
    whole, early, late = part(0, w), part(0, w // 2), part(w // 2, w)
    top, low = F.array_max(prices(whole, "high")), F.array_min(prices(whole, "low"))
    seen = per.withColumns({
        "no_new_high": top <= F.col("pump_high"), "cooled": F.get("path", F.lit(w - 1))["close"] / F.col("pump_high") - 1 <= setup.cool, "contracting": mean_range(early) > mean_range(late),
        "higher_low": F.array_min(prices(late, "low")) >= F.array_min(prices(early, "low")), "top": top, "stop": low - setup.atr * mean_range(whole),
    })
    fits = F.col("first") + w + setup.hold < F.col("bars")
    seen = seen.withColumn("armed", F.col("no_new_high") & F.col("cooled") & F.col("contracting") & F.col("higher_low") & fits)
    broke = first_index(F.col("path"), lambda b: (b["idx"] >= w) & (b["idx"] < w + setup.search) & (b["close"] > F.col("top")))
    seen = seen.withColumns({"broke": F.when(F.col("armed"), broke), "now": F.when(F.col("armed"), walk(F.col("path"), w, F.col("stop"), setup.target, setup.hold))})
    later = F.when(F.col("first") + F.col("broke") + 1 + setup.hold < F.col("bars"), walk(F.col("path"), F.col("broke") + 1, F.col("stop"), setup.target, setup.hold))
    seen = seen.withColumn("later", later)
    return seen.select("market", "session", "no_new_high", "cooled", "contracting", "higher_low", "armed", "stop", (F.col("now.gross") - cost).alias("net_now"), F.col("now.hit").alias("hit_now"), "broke", (F.col("later.gross") - cost).alias("net_reclaim"))
