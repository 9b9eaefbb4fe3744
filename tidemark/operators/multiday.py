"""Exits over several days: hold, bracket and trailing arms on daily bars, with fills at a gapped open.

The next `days` bars of each row are gathered once, as an array of at most that many; each arm folds over it. A fold's state
holds the high up to the bar before, so a bar's own high can't raise the stop that the same bar is tested against.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Arm(NamedTuple):
    """kind: hold, bracket (target and stop) or trail (distance under the running high); parts of one. gaps: a bar that opens beyond
    the stop is filled at its open; a target is filled at its level even then."""

    name: str
    kind: str
    target: float = 0.0
    stop: float = 0.0
    trail: float = 0.0
    gaps: bool = True


def future(bars: DataFrame, days: int) -> DataFrame:
    """market, day, entry (the next bar's open) and path, up to `days` bars from the next on. Rows without a next bar, or whose
    entry is not a positive number, go."""
    w = Window.partitionBy("market").orderBy("day")
    path = F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])).over(w.rowsBetween(1, days))
    rows = bars.select("market", "day", path.alias("path")).withColumn("entry", F.get("path", F.lit(0))["open"])
    return rows.where((F.col("entry") > 0) & (F.col("entry") < float("inf")))


def folded(arm: Arm) -> Column:
    """struct(reason, gross, held) of one arm over path from entry."""
    entry = F.col("entry")
    none = F.lit(None).cast("string")

    def ended(reason: str, gross: Column, acc: Column) -> Column:
        return F.struct(F.lit(reason).alias("reason"), gross.cast("double").alias("gross"), (acc["held"] + 1).alias("held"), acc["high"].alias("high"))

    def step(acc: Column, bar: Column) -> Column:
        open_ = F.struct(none.alias("reason"), (bar["close"] / entry - 1).alias("gross"), (acc["held"] + 1).alias("held"), F.greatest(acc["high"], bar["high"]).alias("high"))
        if arm.kind == "hold":
            return open_
        level = entry * (1 - arm.stop) if arm.kind == "bracket" else acc["high"] * (1 - arm.trail)
        name = "sl" if arm.kind == "bracket" else "trail"
        at_level = F.lit(-arm.stop) if arm.kind == "bracket" else level / entry - 1
        out = F.when(acc["reason"].isNotNull(), acc)
        if arm.gaps:
            out = out.when(bar["open"] <= level, ended(f"{name}_gap", bar["open"] / entry - 1, acc))
        out = out.when(bar["low"] <= level, ended(name, at_level, acc))
        if arm.kind == "bracket":
            out = out.when(bar["high"] >= entry * (1 + arm.target), ended("tp", F.lit(arm.target), acc))
        return out.otherwise(open_)

    start = F.struct(none.alias("reason"), F.lit(0.0).alias("gross"), F.lit(0).alias("held"), entry.alias("high"))
    done = F.aggregate("path", start, step)
    last = {"hold": "hold", "bracket": "eod", "trail": "trail_eod"}[arm.kind]
    return F.struct(F.lit(arm.name).alias("arm"), F.coalesce(done["reason"], F.lit(last)).alias("reason"), done["gross"].alias("gross"), done["held"].alias("held"))


def exits(bars: DataFrame, days: int, arms: list[Arm], whole: bool = True) -> DataFrame:
    """(market, day, arm, reason, gross, held): each arm from the next bar's open over up to `days` bars; of one bar the stop comes before the
    target. whole: only paths of all the days. Held counts bars, the exit's own included."""
    rows = future(bars, days)
    rows = rows.where(F.size("path") == days) if whole else rows
    return rows.select("market", "day", F.explode(F.array(*[folded(a) for a in arms])).alias("x")).select("market", "day", "x.*")
