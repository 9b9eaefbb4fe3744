"""Drift of a model's scores: four triggers a day, from moving windows and a two-sample test against the days before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evaluate import daily_ic

# Fixed values of the triggers.
HALF_DROP, HIT_DROP, P_LEAST = 0.5, 0.15, 0.01
SHORT, LONG, MIN_NEW, MIN_OLD = 7, 30, 10, 50


def kolmogorov_p(d: Column, n: Column, m: Column, terms: int = 40) -> Column:
    """The asymptotic p-value of a two-sample Kolmogorov-Smirnov distance: 2 * sum of (-1)^(k-1) * exp(-2 k^2 x^2), x = d * sqrt(nm / (n + m)).
    For x under 0.2, where the series converges slowly, one (the error is under 1e-12). Null without samples."""
    x = d * F.sqrt(F.try_divide(n * m, n + m))
    series = sum((F.exp(-2.0 * k * k * x * x) * (2 if k % 2 else -2) for k in range(1, terms + 1)), F.lit(0.0))
    return F.when((n > 0) & (m > 0) & (x < 0.2), 1.0).when(x.isNotNull(), F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_by_day(rows: DataFrame, p: str, before: int = SHORT) -> DataFrame:
    """(day, ks, n_new, n_old, ks_p): each day's scores against those of the `before` calendar days up to the day before. Scores are counted by
    day and value, and each count is sent to the days that compare it; the running shares are within one day's comparison. Null scores don't count."""
    per = rows.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))).groupBy("day", F.col(p).cast("double").alias("v")).agg(F.count("*").alias("k"))
    days = per.select("day").distinct()
    sent = per.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(before)))).select(F.date_add("day", F.col("shift")).alias("day"), "v", F.when(F.col("shift") == 0, F.col("k")).otherwise(0).alias("new"), F.when(F.col("shift") > 0, F.col("k")).otherwise(0).alias("old"))
    both = sent.join(F.broadcast(days), "day", "left_semi").groupBy("day", "v").agg(F.sum("new").alias("new"), F.sum("old").alias("old"))
    w, whole = Window.partitionBy("day").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("day")
    gap = F.abs(F.try_divide(F.sum("new").over(w), F.sum("new").over(whole)) - F.try_divide(F.sum("old").over(w), F.sum("old").over(whole)))
    out = both.withColumn("gap", gap).groupBy("day").agg(F.max("gap").alias("ks"), F.sum("new").alias("n_new"), F.sum("old").alias("n_old"))
    return out.withColumn("ks_p", kolmogorov_p(F.col("ks"), F.col("n_new"), F.col("n_old")))


def triggers(rows: DataFrame, p: str, y: str, min_rows: int = 5) -> DataFrame:
    """A row a day of rows (day, market, p, y): its rank correlation ic and the mean of the last seven, hit rates of the last 7 and 30 days, the test against the week before,
    the four flags and the state: FREEZE on a sign flip or a half drop, WARN on the others, else OK.

    Correlations are taken to nine decimals, so that noise about zero has no sign. Windows are of days that have a value (an ic needs min_rows rows and both classes), and flags are false until they are full. The distribution counts with ten new and
    fifty old scores at least.
    """
    by_day = Window.orderBy("day")
    tail = lambda n: by_day.rowsBetween(-(n - 1), 0)
    full = lambda x, n: F.when(F.count(x).over(tail(n)) >= n, F.avg(x).over(tail(n)))
    ic = daily_ic(rows, p, y, min_rows).where("ic is not null").select("day", F.round("ic", 9).alias("ic")).withColumn("ic_7", full("ic", SHORT))
    hits = rows.groupBy("day").agg(F.avg(y).alias("hit"))
    hits = hits.withColumns({"hit_7": F.when(F.count("hit").over(tail(LONG)) >= LONG, F.avg("hit").over(tail(SHORT))), "hit_30": full("hit", LONG)})
    days = hits.join(ic, "day", "left").join(ks_by_day(rows, p), "day", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    days = days.withColumns({
        "sign_flip": flag(F.col("ic") * F.col("ic_7") < 0), "half_drop": flag((F.col("ic_7") > 0) & (F.col("ic") < F.col("ic_7") * HALF_DROP)), "hit_drop": flag(F.col("hit_7") < F.col("hit_30") - HIT_DROP),
        "dist_shift": flag((F.col("n_new") >= MIN_NEW) & (F.col("n_old") >= MIN_OLD) & (F.col("ks_p") < P_LEAST)),
    })
    state = F.when(F.col("sign_flip") | F.col("half_drop"), "FREEZE").when(F.col("hit_drop") | F.col("dist_shift"), "WARN").otherwise("OK")
    return days.withColumn("state", state)
