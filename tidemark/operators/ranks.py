"""Cross-sectional operators: breadth, ranks, scores, universes, top-k, quantile screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.sources.scratch import shared_path
from tidemark.functions.windows import EPS, lag, pct_rank, roll, series
from tidemark.operators.features import ret

def by_day() -> WindowSpec:
    """Over one row a day: a market-wide series, not rows of the data."""
    return Window.orderBy("day")



def breadth(bars: DataFrame, pump: float = 0.1) -> DataFrame:
    """One row a day: active markets, pumps and their share, advancers, median return, turnover."""
    rows = bars.withColumns({"r": ret(), "p": (F.col("high") / F.col("open") - 1 >= pump).cast("int")})
    return rows.groupBy("day").agg(
        F.count("*").alias("active"), F.sum("p").alias("pumps"), F.avg("p").alias("breadth"), F.sum((F.col("r") > 0).cast("int")).alias("advancers"),
        F.percentile("r", 0.5).alias("med_ret"), F.sum("quote_volume").alias("turnover"),
    )


def _last(agg, x: str, n: int) -> Column:
    w = by_day().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) >= n, agg(x).over(w))


def day_gate(days: DataFrame, regimes: DataFrame) -> DataFrame:
    before = regimes.select("day", F.lag("btc_regime").over(by_day()).alias("regime_yday"))
    rows = days.withColumns({"pumps_yday": F.lag("pumps").over(by_day()), "med_ret_yday": F.lag("med_ret").over(by_day()), "advancers_avg3": F.avg("advancers").over(by_day().rowsBetween(-3, -1))})
    return rows.join(before, "day", "left")


def with_context(rows: DataFrame) -> DataFrame:
    """Day breadth and own liquidity rank on each row; both come from windows over the day, without a join."""
    day = Window.partitionBy("day")
    return rows.withColumns({
        "day_breadth": F.avg((F.col("high") / F.col("open") - 1 >= 0.1).cast("int")).over(day), "day_turnover": F.sum("quote_volume").over(day),
        "liquidity_rank": F.rank().over(day.orderBy(F.desc("quote_volume"))),
    })


def foreign_surge(fx: DataFrame, n: int = 20, calendar: int = 5) -> DataFrame:
    """Volume over the mean of the n days before, and the log return, where the last days have no gap."""
    w = Window.partitionBy("symbol").orderBy("day")
    rows = fx.withColumns({
        "s": F.col("quote_volume") / F.nullif(F.avg("quote_volume").over(w.rowsBetween(-n, -1)), F.lit(0.0)), "lr": F.log(F.col("close") / F.lag("close").over(w)),
        "span": F.datediff("day", F.lag("day", calendar).over(w)), "n": F.count("*").over(w.rowsBetween(-n, -1)),
    })
    status = F.when(F.col("n") < n, "short_history").when(F.col("span") != calendar, "gap").otherwise("ok")
    rows = rows.withColumn("status", status)
    ok = F.col("status") == "ok"
    return rows.withColumns({"surge": F.when(ok, F.col("s")), "log_ret": F.when(ok, F.col("lr"))})


def lead_lag(home: DataFrame, fx: DataFrame) -> DataFrame:
    """Home return beside the foreign return and surge of the day before, never filled from other days."""
    w = Window.partitionBy("symbol").orderBy("day")
    f = fx.withColumns({"ret_foreign": F.col("close") / F.lag("close").over(w) - 1, "surge_d1": F.col("quote_volume") / F.nullif(F.avg("quote_volume").over(w.rowsBetween(-20, -1)), F.lit(0.0))})
    f = f.select("symbol", F.date_add("day", 1).alias("day"), "ret_foreign", "surge_d1")
    h = home.withColumns({"ret_home": ret(), "symbol": F.regexp_replace("market", "^M", "X")})
    return h.join(f, ["symbol", "day"], "left").withColumn("ret_gap", F.col("ret_home") - F.col("ret_foreign"))


def liquidity_ranks(rows: DataFrame, col: str) -> DataFrame:
    w = Window.partitionBy("day").orderBy(F.col(col).desc_nulls_last())
    first = Window.partitionBy("day").orderBy(F.col(col).desc_nulls_last(), "market")
    return rows.withColumns({"rank_min": F.rank().over(w), "rank_dense": F.dense_rank().over(w), "rank_first": F.row_number().over(first)})


def rolling_z(days: DataFrame, cols: list[str], n: int) -> DataFrame:
    return days.withColumns({f"{c}_z{n}": (F.col(c) - _last(F.avg, c, n)) / (_last(F.stddev_samp, c, n) + EPS) for c in cols})


def rank_mean(cols: list[str], by: str = "day") -> Column:
    """Mean of percentile ranks; a missing one counts 0.5."""
    return sum((F.coalesce(pct_rank(c, by), F.lit(0.5)) for c in cols), F.lit(0.0)) / len(cols)


def scored(bars: DataFrame) -> DataFrame:
    """Lagged indicators of each bar, its rank-mean score and liquidity rank, with the bar's own prices."""
    raw = bars.withColumns({"r1_": ret(1), "r3_": ret(3), "r7_": ret(7), "s7_": F.col("quote_volume") / (roll(F.avg, "quote_volume", 7) + EPS), "lq_": F.log(F.col("quote_volume") + 1)})
    rows = raw.select("day", "market", "open", "high", "low", "close", "volume", "quote_volume", *[lag(f"{c}_").alias(c) for c in ("r1", "r3", "r7", "s7", "lq")], lag("quote_volume").alias("uq"), (F.row_number().over(series()) - 1).alias("history"))
    liq = F.when(F.col("uq").isNotNull(), F.rank().over(Window.partitionBy("day").orderBy(F.col("uq").desc_nulls_last())))
    return rows.withColumns({"score": rank_mean(["r1", "r3", "r7", "s7", "lq"]), "liq": liq})


def top_k(rows: DataFrame, score: str, k: int, tie: str = "market") -> DataFrame:
    """The k best of each day with their rank; Spark keeps only k a partition before it shuffles."""
    w = Window.partitionBy("day").orderBy(F.round(score, 9).desc(), tie)
    return rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def precision_at(rows: DataFrame, k: int, score: str = "score", hit: str = "hit") -> DataFrame:
    w = Window.partitionBy("day").orderBy(F.round(score, 9).desc(), "market")
    ranked = rows.withColumn("top", F.row_number().over(w) <= k)
    per = ranked.groupBy("day").agg(F.sum(F.col("top").cast("int")).alias("picks"), F.sum(F.when(F.col("top"), F.col(hit)).otherwise(0)).alias("hits"), F.sum(hit).alias("positives"))
    return per.withColumns({f"precision_at_{k}": F.col("hits") / F.col("picks"), f"recall_at_{k}": F.col("hits") / F.nullif(F.col("positives"), F.lit(0))})


def global_buckets(rows: DataFrame, score: str, buckets: int, *ties: str) -> DataFrame:
    """rows with bucket, the quantile bucket of the first-rank over all rows.

    A rank over all rows without one task for all: see with_sums_before.
    """
    order = [F.round(score, 9).asc(), *[F.col(t).asc() for t in ties]]
    ranked = with_sums_before(rows.withColumn("one_", F.lit(1)), order, ["one_"])
    i, n = F.col("one__before") + 1, F.col("one__all")
    bucket = F.when(n > 1, F.greatest(F.floor(((i - 1) * buckets + n - 2) / (n - 1)) - 1, F.lit(0))).otherwise(0)
    return ranked.withColumn("bucket", bucket).drop("one_", "one__before", "one__all")


def with_sums_before(rows: DataFrame, order: list[Column], cols: list[str]) -> DataFrame:
    """rows with {col}_before, the sum of col over all rows that come before in the order (which must be total), and {col}_all, over all rows.

    Rows are range-partitioned by the order and written once to the shared folder with their partition's number; sums run inside
    partitions, and the partitions' own sums, one row each, are added to them.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "ranges")
    parts = rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    sums = parts.groupBy("part_").agg(*[F.sum(c).alias(f"{c}_part_") for c in cols])
    lower, every = Window.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    offsets = sums.select("part_", *[F.coalesce(F.sum(f"{c}_part_").over(lower), F.lit(0)).alias(f"{c}_off_") for c in cols], *[F.sum(f"{c}_part_").over(every).alias(f"{c}_all") for c in cols])
    inside = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = parts.withColumns({f"{c}_in_": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols}).join(F.broadcast(offsets), "part_")
    return run.withColumns({f"{c}_before": F.col(f"{c}_in_") + F.col(f"{c}_off_") for c in cols}).drop("part_", *[f"{c}_{x}_" for c in cols for x in ("in", "off")])


def quantiles(rows: DataFrame, value: str | Column, named: dict[str, float], *by: str) -> DataFrame:
    """(by, one column a name): exact quantiles, between two neighbours in proportion, of the values that are not null or NaN. Values are counted first, and the
    distinct ones put in order over ranges, so no buffer holds them all; each quantile is then the value at its place. Groups without values are left out."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    per = rows.select(*by, x.alias("v_")).where(F.col("v_").isNotNull() & ~F.isnan("v_")).groupBy(*by, "v_").agg(F.count("*").alias("n_"))
    run = with_sums_before(per, [*[F.col(b).asc() for b in by], F.col("v_").asc()], ["n_"])
    if by:
        run = run.join(run.groupBy(*by).agg(F.min("n__before").alias("base_"), F.sum("n_").alias("all_")), list(by))
    else:
        run = run.withColumns({"base_": F.lit(0), "all_": F.col("n__all")})
    first = F.col("n__before") - F.col("base_")
    at = lambda place: F.max(F.when((first <= place) & (place < first + F.col("n_")), F.col("v_")))
    place = {n: (F.col("all_") - 1) * q for n, q in named.items()}
    ends = [c for n, p in place.items() for c in (at(F.floor(p)).alias(f"{n}_lo_"), at(F.ceil(p)).alias(f"{n}_hi_"))]
    found = run.groupBy(*by, "all_").agg(*ends)
    return found.select(*by, *[(F.col(f"{n}_lo_") + (p - F.floor(p)) * (F.col(f"{n}_hi_") - F.col(f"{n}_lo_"))).alias(n) for n, p in place.items()])


def bucket_screen(rows: DataFrame, score: str, hit: str, buckets: int, *ties: str) -> DataFrame:
    per = global_buckets(rows, score, buckets, *(ties or ("day", "market"))).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("rate"))
    whole = per.agg(F.try_divide(F.sum("hits"), F.sum("n")).alias("base"))
    return per.crossJoin(F.broadcast(whole)).withColumn("lift", F.try_divide("rate", "base"))
