"""Policies against what happened: competition metrics with recall, summaries of groups with evidence tiers, sweeps of day gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import resampling as rs
from tidemark.operators.portfolio import YEAR


def competition(rows: DataFrame, policies: dict[str, Column], deep_loss: float = -5.0) -> DataFrame:
    """A row a policy over rows (day, market, net_pct, exit_reason, pump 0/1): picks are closed rows that the policy's predicate takes. Recall and capture
    count all pumps of all days, those on which the policy picked nothing too. Rates without rows are null; a policy that never picks has only counts.
    """
    days = rows.groupBy("day").agg(F.sum(F.coalesce("pump", F.lit(0))).alias("pumps"))
    whole = days.agg(F.count("*").alias("n_days"), F.coalesce(F.sum("pumps"), F.lit(0)).alias("actual"), F.coalesce(F.sum((F.col("pumps") > 0).cast("int")), F.lit(0)).alias("pump_days"))
    named = F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in policies.items()])
    taken = rows.where(F.col("net_pct").isNotNull()).withColumn("policy", F.explode(F.filter(named, lambda x: x.isNotNull())))
    # One row a policy and day: what a day adds to every total.
    per = taken.groupBy("policy", "day").agg(
        F.count("*").alias("n"), F.sum("net_pct").alias("net"), F.sum((F.col("net_pct") <= deep_loss).cast("int")).alias("deep"), F.sum((F.col("exit_reason") == "TP").cast("int")).alias("tp"),
        F.sum((F.col("exit_reason") == "SL").cast("int")).alias("sl"), F.sum(F.coalesce("pump", F.lit(0))).alias("captured"), F.count("pump").alias("labelled"),
    )
    total = per.groupBy("policy").agg(
        *[F.sum(c).alias(c) for c in ("n", "net", "deep", "tp", "sl", "captured", "labelled")], F.count("*").alias("selected_days"), F.sum((F.col("captured") > 0).cast("int")).alias("captured_days"),
    )
    names = rows.sparkSession.createDataFrame([(n,) for n in policies], "policy string")
    out = names.join(total, "policy", "left").crossJoin(F.broadcast(whole)).fillna(0, ["n", "selected_days", "captured", "captured_days"])
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return out.select(
        "policy", "n", "n_days", "selected_days", F.col("net").alias("net_sum"), rate("net", "n").alias("net_mean"), rate("deep", "n").alias("deep_loss"), rate("sl", "n").alias("sl_rate"), rate("tp", "n").alias("tp_rate"),
        rate("captured", "labelled").alias("precision"), rate("captured", "actual").alias("recall"), "captured", "actual", "pump_days", "captured_days", rate("captured_days", "pump_days").alias("capture_rate"),
    )


def evidence_tier(n: Column, mean: Column, drawdown: Column) -> Column:
    return (
        F.when(n == 0, "DIAGNOSTIC_ONLY").when(n < 20, "COLLECT").when((mean > 0) & (drawdown.isNull() | (drawdown > -0.25)), "PROMOTE_CANDIDATE").when(mean < 0, "DEMOTE_CANDIDATE").otherwise("WATCH")
    )


def group_summary(rows: DataFrame, dimensions: dict[str, Column], replicates: int = 50, seed: int = 42, min_days: int = 5) -> DataFrame:
    """A row a value of each dimension, over rows (day, status, net_pct): candidates, closed rows with their win rate, sum, mean, median and worst; the day-equal
    portfolio on a calendar without gaps (Sharpe, deepest drawdown, end, days); the interval of the mean daily return by drawing days
    on which it traded (null under min_days); and the evidence tier. A null value of a dimension is called none.

    All dimensions are counted in one pass: a row is sent to one group a dimension, and summed by day before anything else.
    """
    groups = F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(c.cast("string"), F.lit("none")).alias("value")) for n, c in dimensions.items()])
    closed = (F.col("status") == "closed") & F.col("net_pct").isNotNull()
    each = rows.select(F.explode(groups).alias("g"), "day", F.when(closed, F.col("net_pct")).alias("x")).select("g.dimension", "g.value", "day", "x")
    by = ["dimension", "value"]
    counts = each.groupBy(*by).agg(
        F.count("*").alias("candidates"), F.count("x").alias("closed"), F.avg((F.col("x") > 0).cast("int")).alias("win_rate"), F.sum("x").alias("net_sum"), F.avg("x").alias("net_mean"), F.percentile("x", 0.5).alias("net_median"), F.min("x").alias("worst"),
    )
    days = each.where("x is not null").groupBy(*by, "day").agg((F.avg("x") / 100).alias("r"))
    calendar = days.groupBy(*by).agg(F.sequence(F.min("day"), F.max("day")).alias("d")).select(*by, F.explode("d").alias("day")).join(days, [*by, "day"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    curve = calendar.withColumn("e", F.exp(F.sum(F.log1p("r")).over(w))).withColumn("dd", F.col("e") / F.greatest(F.max("e").over(w), F.lit(1.0)) - 1)
    risk = curve.groupBy(*by).agg(
        (F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")), F.lit(0.0)) * math.sqrt(YEAR)).alias("sharpe"), F.min("dd").alias("max_drawdown"), (F.max_by("e", "day") - 1).alias("cumulative"), F.count("*").alias("calendar_days"),
    )
    placed = rs.numbered(days, *by)
    drawn = rs.draws(placed.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= min_days), replicates, seed)
    means = drawn.join(placed.select(*by, "i", "r"), [*by, "i"]).groupBy(*by, "rep").agg(F.avg("r").alias("m"))
    ci = means.groupBy(*by).agg(F.percentile("m", rs.LOW).alias("mean_low"), F.percentile("m", rs.HIGH).alias("mean_high"))
    out = counts.join(risk, by, "left").join(ci, by, "left")
    return out.withColumn("tier", evidence_tier(F.col("closed"), F.col("net_mean"), F.col("max_drawdown")))


def gate_sweep(days: DataFrame, rules: dict[str, Column], events: str, least: int = 1) -> DataFrame:
    """A row a rule over days (events, and what the rules read): days counted, base rate of rich days (at least `least` events), share of days on, precision on those, recall, lift, and
    the share of the days off that have no event at all. A rule that can't be told on a day doesn't count it; one that is never on has no precision,
    recall, lift or dead share."""
    each = days.where(F.col(events).isNotNull()).select(F.col(events).alias("n_"), F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), r.cast("int").alias("on")) for n, r in rules.items()])).alias("x")).select("n_", "x.*").where(F.col("on").isNotNull())
    rich, on, off = (F.col("n_") >= least).cast("int"), F.col("on") == 1, F.col("on") == 0
    out = each.groupBy("rule").agg(
        F.count("*").alias("n"), F.avg(rich).alias("base"), F.avg("on").alias("on_rate"), F.avg(F.when(on, rich)).alias("precision"), F.try_divide(F.sum(F.when(on, rich).otherwise(0)), F.sum(rich)).alias("recall"), F.avg(F.when(off, (F.col("n_") == 0).cast("int"))).alias("dead_off"),
    )
    told = F.col("on_rate") > 0
    return out.withColumns({"recall": F.when(told, F.col("recall")), "dead_off": F.when(told, F.col("dead_off")), "lift": F.when(told, F.try_divide("precision", "base"))})
