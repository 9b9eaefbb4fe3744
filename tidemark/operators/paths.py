"""Intraday paths: as-of and interval joins, grids, first touches, exits, outcome labels.

A path is the bars in [start, start + hours) of one entry. Interval joins are equi-joins on (market, date):
each entry is sent to the dates that its window touches, so no side is ever compared with all of the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def path_window() -> WindowSpec:
    return Window.partitionBy("entry_id").orderBy("idx")


def next_boundary(ts: Column, seconds: int = 900) -> Column:
    """The first bar start strictly after an instant; an instant on a boundary goes to the next."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds + seconds)


def entries(trades: DataFrame) -> DataFrame:
    """(entry_id, market, seen, start): a decision at each trade, executed at the next bar."""
    return trades.select(F.col("event_id").alias("entry_id"), "market", F.col("ts").alias("seen"), next_boundary(F.col("ts")).alias("start"))


def interval_join(entries_: DataFrame, bars: DataFrame, hours: int = 24) -> DataFrame:
    """Entries with their bars and idx, the whole number of 15 minutes since start."""
    end = F.col("start") + F.make_dt_interval(hours=F.lit(hours))
    spread = entries_.withColumn("date_", F.explode(F.sequence(F.to_date("start"), F.to_date(end))))
    rows = spread.join(bars.withColumn("date_", F.to_date("ts")), ["market", "date_"]).where((F.col("ts") >= F.col("start")) & (F.col("ts") < end))
    return rows.withColumn("idx", ((F.unix_seconds("ts") - F.unix_seconds("start")) / 900).cast("long")).drop("date_")


def per_start(entries_: DataFrame, bars: DataFrame, fold: Callable[[DataFrame], DataFrame], hours: int = 24) -> DataFrame:
    """fold(paths), whose rows are keyed by entry_id, for every entry. Entries of one market and start have one path: paths are joined and folded
    once for each start, under the smallest entry_id, and only the results go to all entries, so what is joined to bars is bounded by
    the grid of starts however many entries there are. A start that very many entries share is one row on its side of the last join."""
    starts = entries_.groupBy("market", "start").agg(F.min("entry_id").alias("entry_id"))
    keys = entries_.select("entry_id", "market", "start").join(starts.withColumnRenamed("entry_id", "one_"), ["market", "start"]).select("entry_id", "one_")
    return keys.join(fold(interval_join(starts, bars, hours)).withColumnRenamed("entry_id", "one_"), "one_").drop("one_")


def prior_close(entries_: DataFrame, bars: DataFrame) -> DataFrame:
    """Entries with prior, the last close strictly before start: one sort of both sides by time."""
    a = entries_.select("entry_id", "market", F.col("start").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("c"))
    b = bars.select(F.lit(None).cast("long").alias("entry_id"), "market", F.col("ts").alias("t"), F.lit(1).alias("kind"), F.col("close").alias("c"))
    w = Window.partitionBy("market").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("prior", F.last("c", ignorenulls=True).over(w)).where("kind = 0").select("entry_id", "market", F.col("t").alias("start"), "prior")


def with_entry_price(paths: DataFrame) -> DataFrame:
    return paths.withColumn("entry", F.first("open").over(path_window()))


def first_touch(paths: DataFrame, stop: float | Column, target: float | Column) -> DataFrame:
    """(entry_id, entry, i_sl, i_tp, gross, reason): the stop wins a shared bar; neither: the last close."""
    p = with_entry_price(paths)
    stop, target = (F.lit(x) if isinstance(x, float) else x for x in (stop, target))
    hit = p.groupBy("entry_id").agg(
        F.first("entry").alias("entry"), F.min(F.when(F.col("low") <= F.col("entry") * (1 - stop), F.col("idx"))).alias("i_sl"), F.min(F.when(F.col("high") >= F.col("entry") * (1 + target), F.col("idx"))).alias("i_tp"),
        F.max_by("close", "idx").alias("last_close"), F.max(stop).alias("sl_"), F.max(target).alias("tp_"),
    )
    by_stop = F.col("i_sl").isNotNull() & (F.col("i_tp").isNull() | (F.col("i_sl") <= F.col("i_tp")))
    reason = F.when(by_stop, "sl").when(F.col("i_tp").isNotNull(), "tp").otherwise("eod")
    return hit.withColumn("reason", reason).withColumn("gross", F.when(F.col("reason") == "sl", -F.col("sl_")).when(F.col("reason") == "tp", F.col("tp_")).otherwise(F.col("last_close") / F.col("entry") - 1)).drop("sl_", "tp_")


def variants(paths: DataFrame, specs: list[tuple[str, float, float]]) -> DataFrame:
    """first_touch for each named (stop, target) pair: the path is aggregated once, with one hit column for each level."""
    p = with_entry_price(paths)
    aggs = [F.first("entry").alias("entry"), F.max_by("close", "idx").alias("last_close"), (F.max("high") / F.first("entry") - 1).alias("path_max"), (F.min("low") / F.first("entry") - 1).alias("path_min")]
    for i, (_, sl, tp) in enumerate(specs):
        aggs += [F.min(F.when(F.col("low") <= F.col("entry") * (1 - F.lit(sl)), F.col("idx"))).alias(f"s{i}"), F.min(F.when(F.col("high") >= F.col("entry") * (1 + F.lit(tp)), F.col("idx"))).alias(f"t{i}")]
    hit = p.groupBy("entry_id").agg(*aggs)
    one = lambda i, n, sl, tp: F.struct(F.lit(n).alias("variant"), F.when(F.col(f"s{i}").isNotNull() & (F.col(f"t{i}").isNull() | (F.col(f"s{i}") <= F.col(f"t{i}"))), -sl).when(F.col(f"t{i}").isNotNull(), tp).otherwise(F.col("last_close") / F.col("entry") - 1).alias("gross"))
    return hit.withColumn("v", F.explode(F.array(*[one(i, *spec) for i, spec in enumerate(specs)]))).select("entry_id", "path_max", "path_min", "v.variant", "v.gross")


def ladder(paths: DataFrame, floor: float, arms: list[tuple[float, float]]) -> DataFrame:
    """Arms (gain, fraction) sold at their first touch before the floor; the rest at the floor or the end."""
    p = with_entry_price(paths)
    aggs = [F.first("entry").alias("entry"), F.max_by("close", "idx").alias("last_close"), F.min(F.when(F.col("low") <= F.col("entry") * (1 - F.lit(floor)), F.col("idx"))).alias("i_floor")]
    aggs += [F.min(F.when(F.col("high") >= F.col("entry") * (1 + F.lit(g)), F.col("idx"))).alias(f"a{i}") for i, (g, _) in enumerate(arms)]
    hit = p.groupBy("entry_id").agg(*aggs)
    sold = [F.col(f"a{i}").isNotNull() & (F.col("i_floor").isNull() | (F.col(f"a{i}") < F.col("i_floor"))) for i in range(len(arms))]
    gain = sum((F.when(s, F.lit(g * w)).otherwise(0.0) for s, (g, w) in zip(sold, arms)), F.lit(0.0))
    left = 1 - sum((F.when(s, F.lit(w)).otherwise(0.0) for s, (_, w) in zip(sold, arms)), F.lit(0.0))
    n = sum((s.cast("long") for s in sold), F.lit(0))
    rest = F.when(F.col("i_floor").isNotNull(), F.lit(-floor)).otherwise(F.col("last_close") / F.col("entry") - 1)
    return hit.select("entry_id", (gain + F.greatest(left, F.lit(0.0)) * rest).alias("gross"), (n + (F.round(left, 9) > 0).cast("long")).alias("n_sell"), F.col("i_floor").isNotNull().alias("floored"))


def trailing(paths: DataFrame, arm: float, trail: float, stop: float, target: float, last_idx: int) -> DataFrame:
    """Trailing exit: the running high rises before the same bar is tested. Of one bar, stop, trail, target, time is the order."""
    p = with_entry_price(paths).withColumn("high_", F.max("high").over(path_window().rowsBetween(Window.unboundedPreceding, 0)))
    e = F.col("entry")
    rule = (
        F.when(F.col("low") <= e * (1 - stop), F.struct(F.lit("stop").alias("reason"), F.lit(-stop).alias("gross")))
        .when((F.col("high_") >= e * (1 + arm)) & (F.col("low") <= F.col("high_") * (1 - trail)), F.struct(F.lit("trail").alias("reason"), (F.col("high_") * (1 - trail) / e - 1).alias("gross")))
        .when(F.col("high") >= e * (1 + target), F.struct(F.lit("target").alias("reason"), F.lit(target).alias("gross")))
        .when(F.col("idx") >= last_idx, F.struct(F.lit("time").alias("reason"), (F.col("close") / e - 1).alias("gross")))
    )
    done = p.withColumn("x", rule).groupBy("entry_id").agg(F.min_by("x", F.when(F.col("x").isNotNull(), F.col("idx"))).alias("x"), F.first("entry").alias("entry"), F.max_by("close", "idx").alias("last_close"))
    return done.select("entry_id", F.coalesce("x.reason", F.lit("eod")).alias("reason"), F.coalesce("x.gross", F.col("last_close") / F.col("entry") - 1).alias("gross"))


def outcomes(paths: DataFrame, cost: float = 0.0015) -> DataFrame:
    """Forward outcome of each entry: excursions, end return, net, threshold labels."""
    p = with_entry_price(paths)
    o = p.groupBy("entry_id").agg(F.first("market").alias("market"), (F.max("high") / F.first("entry") - 1).alias("mfe"), (F.min("low") / F.first("entry") - 1).alias("mae"), (F.max_by("close", "idx") / F.first("entry") - 1).alias("eod"), F.count("*").alias("n_bars"))
    flags = {f"up{k}": (F.col("mfe") >= k / 100).cast("int") for k in (1, 2, 5)} | {f"dn{k}": (F.col("mae") <= -k / 100).cast("int") for k in (1, 3, 5)}
    return o.withColumns({"net": F.col("eod") - cost} | flags)


def grid(entries_: DataFrame, bars: DataFrame, steps: int = 96) -> DataFrame:
    """The expected bar starts of each entry with the observed bar or a flat one from the close before."""
    g = entries_.select("entry_id", "market", "start", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("idx")).withColumn("ts", F.timestamp_seconds(F.unix_seconds("start") + F.col("idx") * 900))
    rows = g.join(bars.select("market", "ts", "open", "high", "low", "close"), ["market", "ts"], "left").join(prior_close(entries_, bars).select("entry_id", "prior"), "entry_id")
    filled = F.coalesce("close", F.last("close", ignorenulls=True).over(path_window().rowsBetween(Window.unboundedPreceding, 0)), "prior")
    return rows.withColumns({"close_f": filled, "observed": F.col("close").isNotNull()})


def path_shape(paths: DataFrame, level: float) -> DataFrame:
    p = with_entry_price(paths)
    return p.groupBy("entry_id").agg((F.max("high") / F.first("entry") - 1).alias("path_max"), (F.min("low") / F.first("entry") - 1).alias("path_min"), (F.max_by("close", "idx") / F.first("entry") - 1).alias("end_ret"), F.max_by("idx", F.struct("high", -F.col("idx"))).alias("max_idx"), F.min(F.when(F.col("high") >= F.col("entry") * (1 + F.lit(level)), F.col("idx"))).alias("first_hit"))


# The seven heads: target and close in percent, draw-down before the target in percent (none: 999), horizon in hours.
HEADS = {
    "h1_stable_3_4h": (3, 2, 2, 4), "h2_hit_3_4h": (3, None, None, 4), "h3_eod_3_24h": (3, 3, 3, 24), "h4_eod_5_24h": (5, 3, 3, 24),
    "h5_tail_20": (20, None, None, 24), "h6_hit_5_24h": (5, None, None, 24), "h7_mid_7_24h": (7, 0, 3, 24),
}


def distribution_heads(paths: DataFrame, scale: float = 1.0) -> DataFrame:
    """(entry_id, one 0/1 column a head): the target is reached within the horizon and, for heads that ask for it, the lowest price up to
    and with that bar stays above the draw-down and the path's last close reaches the close. scale: of all percentages."""
    whole = with_entry_price(paths).groupBy("entry_id").agg(F.first("entry").alias("entry"), F.max_by("close", "idx").alias("last"), F.array_sort(F.collect_list(F.struct("idx", "high", "low"))).alias("bars"))
    up = lambda percent: 1 + percent * scale / 100
    out = []
    for name, (target, close, drawdown, hours) in HEADS.items():
        reached = (lambda t, k: lambda b: (b["idx"] < k) & (b["high"] >= F.col("entry") * up(t)))(target, 4 * hours)
        hits = F.filter("bars", reached)
        label = F.size(hits) > 0
        if drawdown is not None:
            first = F.get(hits, F.lit(0))["idx"]
            lowest = F.array_min(F.transform(F.filter("bars", (lambda last: lambda b: b["idx"] <= last)(first)), lambda b: b["low"]))
            label = label & (lowest >= F.col("entry") * up(-drawdown)) & (F.col("last") >= F.col("entry") * up(close))
        out.append(F.coalesce(label, F.lit(False)).cast("int").alias(name))
    return whole.select("entry_id", *out)
