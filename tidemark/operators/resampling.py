"""Bootstraps by date: replicates as multiplicities of days, statistics recomputed in each.

A replicate draws as many days as there are, with replacement. What it holds is how often each day was drawn, one small number a day and
replicate, which is bounded by the calendar. Statistics of days are sums over that table; the AUC of all rows weighs every row by its
day's number, for all replicates in one pass over one sort by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored

LOW, HIGH, MIN_CI_DATES = 0.025, 0.975, 30
AT_ONCE = 1 << 21  # numbers of a block of rows by replicates


def numbered(days: DataFrame, *by: str) -> DataFrame:
    """One row a day (and group), with its place i from zero and the number n of days. The table has a row a calendar day."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return days.withColumns({"i": F.row_number().over(w.orderBy("day")) - 1, "n": F.count("*").over(w)})


def draws(counts: DataFrame, replicates: int, seed: Column | int, block: int = 1, wrap: bool = True) -> DataFrame:
    """(groups of counts ..., rep, i): n places for each replicate, with repeats. counts: one row a group with n.

    Places come in blocks from a start that is a hash of (seed, replicate, block's number), the same on every cluster. Blocks wrap around
    the end, or, without wrap, start early enough to fit; the last is cut so that n places are drawn.
    """
    keys = [c for c in counts.columns if c != "n"]
    length = F.least(F.lit(block), F.col("n"))
    rows = counts.where("n > 0").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    number = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    key = F.concat_ws("|", number, F.col("rep").cast("string"), F.floor(F.col("k") / length).cast("string"))
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long")
    at = (h % F.col("n") + F.col("k") % length) % F.col("n") if wrap else h % (F.col("n") - length + 1) + F.col("k") % length
    return rows.select(*keys, "rep", at.cast("int").alias("i"))


def replicated(days: DataFrame, stats: dict[str, Column], replicates: int, seed: int, block: int = 1, wrap: bool = True) -> DataFrame:
    """(rep, one column a statistic): all statistics of the same drawn days, from one replicate table."""
    indexed = numbered(days)
    drawn = draws(indexed.agg(F.count("*").alias("n")), replicates, seed, block, wrap)
    return drawn.join(F.broadcast(indexed.drop("n")), "i").groupBy("rep").agg(*[c.alias(n) for n, c in stats.items()])


def intervals(reps: DataFrame, stats: list[str]) -> DataFrame:
    """(stat, low, mid, high, reps): percentiles of each statistic over the replicates where it is not null."""
    pairs = ", ".join(f"'{s}', cast({s} as double)" for s in stats)
    long = reps.selectExpr(f"stack({len(stats)}, {pairs}) as (stat, x)")
    return long.groupBy("stat").agg(F.percentile("x", LOW).alias("low"), F.percentile("x", 0.5).alias("mid"), F.percentile("x", HIGH).alias("high"), F.count("x").alias("reps"))


def compounded(x: Column) -> Column:
    return F.exp(F.sum(F.log1p(x))) - 1


def sharpe(x: Column, year: int = 365) -> Column:
    """Annual Sharpe ratio; zero where the days don't differ."""
    return F.coalesce(F.try_divide(F.avg(x), F.stddev_samp(x)) * float(np.sqrt(year)), F.lit(0.0))


def multiplicities(spark: SparkSession, n_days: int, replicates: int, seed: int) -> np.ndarray:
    """How often each day was drawn in each replicate: days by replicates. Its size is the calendar's times the replicates'."""
    one = spark.range(1).select(F.lit(n_days).alias("n"))
    drawn = draws(one, replicates, seed).groupBy("i", "rep").agg(F.count("*").cast("int").alias("m")).toArrow()
    out = np.zeros((n_days, replicates), np.int32)
    out[drawn["i"].to_numpy(), drawn["rep"].to_numpy()] = drawn["m"].to_numpy()
    return out


def replicate_auc(rows: DataFrame, p: str, y: str, many: np.ndarray) -> DataFrame:
    """(rep, auc): rows (i, p, y), i the place of their day. Null where a replicate has one class only.

    Rows are counted by day and score, ranged by score (equal scores together) and sorted once. A task adds up, for all replicates
    at once, the pairs won within its range and its weighed positives and negatives; ranges are then put in order.
    """
    per = rows.groupBy("i", p).agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    ranged = per.select(F.col(p).cast("double").alias("p"), "i", "pos", "neg").repartitionByRange("p").sortWithinPartitions("p")
    replicates = many.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(many)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, size = sent.value, max(1, AT_ONCE // replicates)
        won, wpos, wneg = (np.zeros(replicates) for _ in range(3))
        tie = None  # score, positives and negatives of the score that is still open

        def close() -> None:
            nonlocal won, wpos, wneg
            won += tie[1] * (wneg + tie[2] / 2)
            wpos += tie[1]
            wneg += tie[2]

        for batch in batches:
            p_, i, pos, neg = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            for a in range(0, len(p_), size):
                s = slice(a, a + size)
                first = np.flatnonzero(np.diff(p_[s], prepend=np.nan) != 0)
                weight = m[i[s]]
                gpos, gneg = (np.add.reduceat(x[s][:, None] * weight, first, axis=0) for x in (pos, neg))
                scores = p_[s][first]
                if tie is not None and tie[0] == scores[0]:
                    gpos[0] += tie[1]
                    gneg[0] += tie[2]
                elif tie is not None:
                    close()
                before = wneg + np.cumsum(gneg[:-1], axis=0) - gneg[:-1]
                won += (gpos[:-1] * (before + gneg[:-1] / 2)).sum(axis=0)
                wpos += gpos[:-1].sum(axis=0)
                wneg += gneg[:-1].sum(axis=0)
                tie = (scores[-1], gpos[-1], gneg[-1])
        if tie is not None:
            close()
            part = np.full(replicates, TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(replicates)), pa.array(won), pa.array(wpos), pa.array(wneg)], names=["part", "rep", "won", "wpos", "wneg"])

    sums = ranged.mapInArrow(add_up, "part bigint, rep bigint, won double, wpos double, wneg double")
    lower = F.coalesce(F.sum("wneg").over(Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = sums.withColumn("won", F.col("won") + F.col("wpos") * lower).groupBy("rep").agg(F.sum("won").alias("won"), F.sum("wpos").alias("pos"), F.sum("wneg").alias("neg"))
    return whole.select("rep", F.try_divide("won", F.col("pos") * F.col("neg")).alias("auc"))


def usable(rows: DataFrame, p: str, y: str) -> DataFrame:
    """(day, p, y) of the rows that count: a probability from 0 to 1 and a label of 0 or 1."""
    return rows.select("day", F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y")).where("day is not null and p >= 0 and p <= 1 and not isnan(p) and y in (0, 1)")


def head_report(rows: DataFrame, p: str, y: str, replicates: int = 100, seed: int = 5, min_rows: int = 100, min_days: int = MIN_CI_DATES, min_class: int = 10) -> DataFrame:
    """One row: counts; status ok, or insufficient with all its reasons; pooled AUC and Brier score with day-clustered intervals, both recomputed
    in each replicate. The AUC's interval needs replicates with both classes: at least 20 and half of all. An insufficient head has
    no metrics, only counts."""
    spark = rows.sparkSession
    clean = stored(usable(rows, p, y), "head")
    per = numbered(clean.groupBy("day").agg(F.count("*").alias("rows"), F.sum("y").alias("pos"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sse")))
    n_rows, n_days, positives, sse = per.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*"), F.coalesce(F.sum("pos"), F.lit(0)), F.sum("sse")).first()
    negatives = n_rows - positives
    short = [(n_rows, min_rows, "n_rows"), (n_days, min_days, "n_days"), (positives, min_class, "positives"), (negatives, min_class, "negatives")]
    reason = ";".join(f"{name}<{least}" for have, least, name in short if have < least)
    schema = "status string, reason string, n_rows long, n_days long, positives long, negatives long, positive_rate double, brier double"
    counts = spark.createDataFrame([("insufficient" if reason else "ok", reason or None, n_rows, n_days, positives, negatives, positives / n_rows if n_rows else None, None if reason else sse / n_rows)], schema)
    names = ["auc", "auc_low", "auc_high", "auc_valid", "brier_low", "brier_high"]
    if reason:
        return counts.select("*", *[F.lit(None).cast("long" if n == "auc_valid" else "double").alias(n) for n in names])
    days = F.broadcast(per.select("day", "i"))
    placed = clean.join(days, "day").select("i", "p", "y")
    many = multiplicities(spark, n_days, replicates, seed)
    # The observed rows are one more replicate, in which each day stands once.
    auc = replicate_auc(placed, "p", "y", np.concatenate([many, np.ones((n_days, 1), np.int32)], axis=1))
    observed = auc.where(F.col("rep") == replicates).select("auc")
    drawn = auc.where(F.col("rep") < replicates).agg(F.percentile("auc", LOW).alias("a"), F.percentile("auc", HIGH).alias("b"), F.count("auc").alias("auc_valid"))
    enough = F.col("auc_valid") >= max(20, replicates // 2)
    drawn = drawn.select(F.when(enough, F.col("a")).alias("auc_low"), F.when(enough, F.col("b")).alias("auc_high"), "auc_valid")
    brier = replicated(per.select("day", "rows", "sse"), {"brier": F.sum("sse") / F.sum("rows")}, replicates, seed).agg(F.percentile("brier", LOW).alias("brier_low"), F.percentile("brier", HIGH).alias("brier_high"))
    return counts.crossJoin(observed).crossJoin(drawn).crossJoin(brier).select(*counts.columns, *names)


def calibration_bins(rows: DataFrame, p: str, y: str, edges: list[float], replicates: int = 100, seed: int = 105, min_days: int = MIN_CI_DATES) -> DataFrame:
    """A row a bin that holds rows: bin k holds edges[k] <= p < edges[k + 1], the last its end too. Counts, day-equal mean prediction and observed
    rate, the rate's interval by drawing the bin's days (null under min_days days), and the bin's part of the row-weighted error."""
    inner = edges[1:-1]
    b = sum((F.when(F.col("p") >= e, 1).otherwise(0) for e in inner), F.lit(0))
    per = usable(rows, p, y).groupBy(b.alias("bin"), "day").agg(F.count("*").alias("k"), F.sum("p").alias("sp"), F.sum("y").alias("sy"))
    indexed = numbered(per.withColumn("rate", F.col("sy") / F.col("k")), "bin")
    table = indexed.groupBy("bin").agg(F.sum("k").alias("n_rows"), F.count("*").alias("n_days"), F.avg(F.col("sp") / F.col("k")).alias("predicted"), F.avg("rate").alias("observed"), F.abs(F.sum("sp") - F.sum("sy")).alias("gap"))
    drawn = draws(table.where(F.col("n_days") >= min_days).select("bin", F.col("n_days").alias("n")), replicates, seed + F.col("bin"))
    reps = drawn.join(indexed.select("bin", "i", "rate"), ["bin", "i"]).groupBy("bin", "rep").agg(F.avg("rate").alias("x"))
    ci = reps.groupBy("bin").agg(F.percentile("x", LOW).alias("low"), F.percentile("x", HIGH).alias("high"))
    share = F.col("gap") / F.sum("n_rows").over(Window.partitionBy(F.lit(0)))
    return table.withColumn("error_share", share).join(ci, "bin", "left").select("bin", "n_rows", "n_days", "predicted", "observed", "low", "high", "error_share")


def vector_summary(days: DataFrame, metrics: list[str], replicates: int, seed: int, block: int = 3, min_dates: int = MIN_CI_DATES) -> DataFrame:
    """(metric, dates, mean, and the ends of two intervals): days drawn one by one, and in blocks of neighbours that don't wrap. All metrics
    of a replicate come from the same days. Under min_dates days the intervals are null."""
    means = {m: F.avg(m) for m in metrics}
    rows = days.select("day", *metrics)
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    point = rows.selectExpr(f"stack({len(metrics)}, {pairs}) as (metric, x)").groupBy("metric").agg(F.count("*").alias("dates"), F.avg("x").alias("mean"))
    out = point
    for name, size in (("iid", 1), ("block", block)):
        ends = intervals(replicated(rows, means, replicates, seed, size, wrap=False), metrics)
        out = out.join(F.broadcast(ends.select(F.col("stat").alias("metric"), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))), "metric")
    enough = F.col("dates") >= min_dates
    return out.select("metric", "dates", "mean", *[F.when(enough, F.col(c)).alias(c) for c in ("iid_low", "iid_high", "block_low", "block_high")])
