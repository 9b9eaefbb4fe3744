"""Walk-forward splits, availability purging, cohorts, causal replay, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_index(rows: DataFrame) -> DataFrame:
    """One row a distinct day, with its place and the number of days."""
    days = rows.select("day").distinct()
    w = Window.orderBy("day")
    return days.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(F.lit(0)))})


def walk_forward(rows: DataFrame, folds: int, embargo_days: int, holdout_days: int, sliding: bool = False) -> DataFrame:
    """(fold, role, day): test blocks of equal numbers of days before the holdout; train days end embargo_days before the block."""
    d = day_index(rows)
    last = d.agg(F.max("day").alias("last_"))
    d = d.crossJoin(F.broadcast(last)).withColumn("holdout", F.col("day") > F.date_sub("last_", holdout_days)).drop("last_")
    live = d.where("not holdout").select("day").withColumns({"i": F.row_number().over(Window.orderBy("day")) - 1, "n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    live = live.withColumn("block", F.floor(F.col("i") * (folds + 1) / F.col("n")))
    starts = live.where("block > 0").groupBy("block").agg(F.min("day").alias("start_"), F.max("day").alias("end_"))
    test = live.join(starts, "block").select((F.col("block") - 1).alias("fold"), F.lit("test").alias("role"), "day")
    near = F.col("day") < F.date_sub("start_", embargo_days)
    train = live.drop("block").join(F.broadcast(starts), near if not sliding else near & (F.col("day") >= F.date_sub("start_", 365))).select((F.col("block") - 1).alias("fold"), F.lit("train").alias("role"), "day")
    return test.unionByName(train)


def index_folds(rows: DataFrame, folds: int, embargo: int, two_sided: bool = False) -> DataFrame:
    """Folds by position: test block k, train all days more than embargo places before (or, two-sided, away from) it."""
    d = day_index(rows).withColumn("block", F.floor(F.col("i") * folds / F.col("n")))
    ends = d.groupBy("block").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    far = F.col("i") < F.col("a") - embargo
    far = far | (F.col("i") > F.col("b") + embargo) if two_sided else far
    train = d.drop("block").join(F.broadcast(ends), far).select(F.col("block").alias("fold"), F.lit("train").alias("role"), "day")
    return d.select(F.col("block").alias("fold"), F.lit("test").alias("role"), "day").unionByName(train)


def availability_purged(days: DataFrame, folds: DataFrame) -> DataFrame:
    """Training days of each fold whose labels were there before the fold's first decision. days: (day, available_at); folds: (fold, decision_at), few rows."""
    return days.join(F.broadcast(folds), F.col("available_at") < F.col("decision_at")).select("fold", "day")


def common_days(rows: DataFrame, arm: str) -> DataFrame:
    """Days on which every arm is there."""
    arms = rows.agg(F.countDistinct(arm).alias("arms_"))
    return rows.groupBy("day").agg(F.countDistinct(arm).alias("k_")).crossJoin(F.broadcast(arms)).where("k_ = arms_").select("day")


def causal_replay(days: DataFrame, last: int, min_days: int) -> DataFrame:
    """For each decision day the arm that did better over the last earlier days whose outcome was known by then.

    days: (day, available_day, delta), one row a day, available_day rising with day. The known days are a prefix, so a
    range frame over day numbers finds them; nothing later than the decision is in reach.
    """
    t = days.withColumn("t", F.datediff("day", F.lit("1970-01-01").cast("date"))).withColumn("lag_", F.datediff("available_day", "day"))
    w = Window.orderBy("t").rowsBetween(-10 * last, -1)
    past = F.transform(F.collect_list(F.struct("t", "lag_", "delta")).over(w), lambda x: x)
    rows = t.withColumn("past", past)
    known = F.filter("past", lambda x: x["t"] + x["lag_"] < F.col("t"))
    rows = rows.withColumn("known", F.slice(known, F.greatest(F.size(known) - last + 1, F.lit(1)), last))
    mean = F.aggregate("known", F.lit(0.0), lambda a, x: a + x["delta"]) / F.size("known")
    return rows.withColumns({"n_known": F.size("known"), "mean_delta": F.when(F.size("known") > 0, mean)}).withColumn("arm", F.when(F.col("n_known") < min_days, "control").when(F.col("mean_delta") > 0, "challenger").otherwise("control")).drop("past", "known")


def bootstrap(days: DataFrame, value: str, replicates: int, seed: int, block: int = 1) -> DataFrame:
    """(rep, mean): means of days drawn with replacement in blocks that wrap. Draws are hashes of (seed, rep, place), so
    they are the same on every cluster; replicate rows are made, joined and summed in parallel.

    days: one row a day. The day table is sent to all tasks: it has one number for each calendar day.
    """
    w = Window.orderBy("day")
    indexed = days.select(value, (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))
    reps = days.sparkSession.range(replicates).select(F.col("id").alias("rep"))
    size = indexed.agg(F.max("n").alias("n"))
    key = F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.floor(F.col("k") / block).cast("string"))
    start = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") % F.col("n")
    draws = reps.crossJoin(F.broadcast(size)).select("rep", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k")).select("rep", ((start + F.col("k") % block) % F.col("n")).alias("i"))
    return draws.join(F.broadcast(indexed.drop("n")), "i").groupBy("rep").agg(F.avg(value).alias("mean"))


def interval(reps: DataFrame, value: str = "mean") -> DataFrame:
    return reps.agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.5).alias("mid"), F.percentile(value, 0.975).alias("high"), F.count("*").alias("reps"))


def permutation(rows: DataFrame, group: str, value: str, key: str, replicates: int, seed: int) -> DataFrame:
    """(rep, diff): difference of group means with labels dealt anew within each day; rep 0 is as observed."""
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col(key).cast("string")).cast("binary"))
    w = Window.partitionBy("rep", "day")
    a = reps.select("rep", "day", value, F.row_number().over(w.orderBy(key)).alias("k"))
    b = reps.withColumn("h_", h).select("rep", "day", group, F.row_number().over(w.orderBy(F.when(F.col("rep") == 0, F.lpad(F.col(key).cast("string"), 20, "0")).otherwise(F.col("h_")), key)).alias("k"))
    return a.join(b, ["rep", "day", "k"]).groupBy("rep").agg((F.avg(F.when(F.col(group) == 1, F.col(value))) - F.avg(F.when(F.col(group) == 0, F.col(value)))).alias("diff"))
