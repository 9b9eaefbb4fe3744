"""Completeness of paths: the bars seen against the grid of bars expected.

A path is the grid of `steps` bars from a start. A benchmark that trades without pause shows whether the collector ran: all its bars
must be there, and one beyond the end, which proves that the last one is closed. Gaps of the target itself mean that nothing traded, and
are filled flat, but only between bars that were seen. Entries share starts, so all is worked out once for each (market, start).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# The reasons, in the order in which the first that holds is given, and the two good qualities.
REASONS = (
    "benchmark_missing", "db_horizon_start_incomplete", "db_horizon_end_incomplete", "benchmark_off_grid", "benchmark_gap",
    "target_no_observations", "target_off_grid", "invalid_target_ohlc", "market_start_horizon_incomplete",
)
QUALITIES = ("complete", "flat_filled")


def sound_bar() -> Column:
    """All four prices are finite and positive, and high and low enclose the others. Null prices are unsound."""
    prices = [F.col(c).cast("double") for c in ("open", "high", "low", "close")]
    finite = [p.isNotNull() & ~F.isnan(p) & (p > 0) & (p < float("inf")) for p in prices]
    o, h, lo, c = prices
    return F.coalesce(finite[0] & finite[1] & finite[2] & finite[3] & (h >= F.greatest(o, c)) & (lo <= F.least(o, c)) & (h >= lo), F.lit(False))


def instants(bars: DataFrame, step_us: int) -> DataFrame:
    """One row for each market and instant t (microseconds): copies, whether t is on the grid, whether a copy is sound, a close."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = bars.where(F.col("ts").isNotNull()).select("market", t.alias("t"), sound_bar().alias("sound"), "close")
    per = rows.groupBy("market", "t").agg(F.count("*").alias("copies"), F.max("sound").alias("sound"), F.max("close").alias("close"))
    # Of several bars at one instant a sound one makes the others repeats; without a sound one the prices are what is wrong.
    code = F.when((F.col("t") % step_us != 0) | (F.col("sound") & (F.col("copies") > 1)), "target_off_grid").when(~F.col("sound"), "invalid_target_ohlc")
    return per.select("market", "t", "copies", (F.col("t") % step_us == 0).alias("on_grid"), "close", code.alias("fault"))


def around(seen: DataFrame, starts: DataFrame, span_us: int) -> DataFrame:
    """starts (market, t) with what is seen in [t, t + span): rows, distinct instants on the grid, off it, repeats, the first fault;
    and the last instant before t. One sort of both by time; no row is multiplied."""
    w = Window.partitionBy("market").orderBy("t")
    ahead, past = w.rangeBetween(0, span_us - 1), w.rangeBetween(Window.unboundedPreceding, -1)
    both = seen.withColumn("start", F.lit(False)).unionByName(starts.withColumn("start", F.lit(True)), allowMissingColumns=True)
    there = ~F.col("start")
    out = both.withColumns({
        "raw": F.sum("copies").over(ahead), "instants": F.sum((there & F.col("on_grid")).cast("int")).over(ahead), "off": F.sum((there & ~F.col("on_grid")).cast("int")).over(ahead),
        "fault": F.min(F.when(F.col("fault").isNotNull(), F.struct("t", "fault"))).over(ahead)["fault"], "at_start": F.max((there & F.col("on_grid")).cast("int")).over(w.rangeBetween(0, 0)),
        "before": F.max(F.when(there, F.struct("t", "close"))).over(past)["close"],
    })
    return out.where("start").select("market", "t", F.coalesce("raw", F.lit(0)).alias("raw"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("instants", "off", "at_start")], "fault", "before")


def completeness(entries: DataFrame, bars: DataFrame, benchmark: DataFrame, steps: int = 96, seconds: int = 900) -> DataFrame:
    """entries (market, start, ...) with quality, path_complete, raw_bars, benchmark_bars and filled (bars made flat).

    bars: (market, ts, open, high, low, close), raw: repeats, off-grid instants and unsound prices may be among them. benchmark: the same
    without market. Starts lie on the grid of whole `seconds`. The first fault in time decides between an off-grid or repeated bar
    and unsound prices. A start without a bar needs a close before it that is finite and positive.
    Entries with a null market or start have a null quality.
    """
    step_us = seconds * 1_000_000
    span_us = steps * step_us
    keyed = entries.withColumn("t_", F.unix_micros(F.col("start").cast("timestamp")))
    starts = keyed.where("market is not null and t_ is not null").select("market", F.col("t_").alias("t")).distinct()
    own = around(instants(bars, step_us), starts, span_us)
    b = benchmark.withColumn("market", F.lit("benchmark"))
    reach = b.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("first_"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_"))
    bench = around(instants(b, step_us), starts.select(F.lit("benchmark").alias("market"), "t").distinct(), span_us)
    bench = bench.select("t", F.col("raw").alias("b_raw"), F.col("instants").alias("b_instants"), F.col("off").alias("b_off"))
    rows = own.join(bench, "t").crossJoin(F.broadcast(reach))
    close = F.col("before").cast("double")
    no_close = close.isNull() | F.isnan(close) | (close <= 0) | (close == float("inf"))
    quality = (
        F.when(F.col("first_").isNull(), REASONS[0])
        .when(F.col("first_") > F.col("t"), REASONS[1])
        .when(F.col("last_") < F.col("t") + span_us, REASONS[2])
        .when(F.col("b_off") > 0, REASONS[3])
        .when((F.col("b_instants") != steps) | (F.col("b_raw") != steps), REASONS[4])
        .when(F.col("raw") == 0, REASONS[5])
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when((F.col("at_start") == 0) & no_close, REASONS[8])
        .when(F.col("instants") == steps, QUALITIES[0])
        .otherwise(QUALITIES[1])
    )
    rows = rows.withColumn("quality", quality).withColumn("path_complete", F.col("quality").isin(*QUALITIES))
    filled = F.when(F.col("path_complete"), F.lit(steps) - F.col("instants"))
    found = rows.select("market", F.col("t").alias("t_"), "quality", "path_complete", F.col("raw").alias("raw_bars"), F.col("b_raw").alias("benchmark_bars"), filled.alias("filled"))
    return keyed.join(found, ["market", "t_"], "left").drop("t_")


def grid_window() -> WindowSpec:
    return Window.partitionBy("market", "start").orderBy("idx")


def flat_filled(starts: DataFrame, bars: DataFrame, steps: int = 96, seconds: int = 900) -> DataFrame:
    """The grid of each complete path (market, start): idx, open, high, low, close, observed. A gap takes the close before it for all four
    prices, from before the start where the first bars lack. Paths that aren't complete come out with null prices: give only complete ones."""
    keys = starts.select("market", "start").distinct()
    grid = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("idx")).withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.col("start").cast("timestamp")) + F.col("idx") * seconds))
    rows = grid.join(bars.select("market", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close"), ["market", "ts"], "left")
    before = around(instants(bars, seconds * 1_000_000), keys.select("market", F.unix_micros(F.col("start").cast("timestamp")).alias("t")), 1)
    rows = rows.withColumn("t", F.unix_micros(F.col("start").cast("timestamp"))).join(before.select("market", "t", "before"), ["market", "t"], "left")
    last = F.coalesce(F.last("close", ignorenulls=True).over(grid_window().rowsBetween(Window.unboundedPreceding, 0)), "before")
    rows = rows.withColumns({"observed": F.col("close").isNotNull(), "last_": last})
    return rows.select("market", "start", "idx", *[F.coalesce(c, "last_").alias(c) for c in ("open", "high", "low", "close")], "observed")
