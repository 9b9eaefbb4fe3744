"""Evaluation: calibration, discrimination, ranking quality, policies, champions, evidence, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.windows import average_rank
from tidemark.operators.ranks import with_sums_before


def day_window() -> WindowSpec:
    return Window.partitionBy("day")


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed: count, mean prediction, observed rate."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def calibration_error(table: DataFrame) -> DataFrame:
    """Row-weighted expected calibration error of a reliability table."""
    return table.agg((F.sum(F.abs(F.col("mean_p") - F.col("rate")) * F.col("n")) / F.sum("n")).alias("ece"))


def day_equal_calibration(rows: DataFrame, p: str, y: str, edges: list[float]) -> DataFrame:
    """Fixed-edge bins whose rates weigh days alike."""
    b = sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    per = rows.withColumn("bin", b).groupBy("bin", "day").agg(F.avg(y).alias("r"), F.count("*").alias("k"), F.avg(p).alias("q"))
    return per.groupBy("bin").agg(F.sum("k").alias("n"), F.avg("r").alias("day_rate"), F.avg("q").alias("day_p"))


def brier(rows: DataFrame, p: str, y: str) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.count("*").alias("n"))


def auc(rows: DataFrame, p: str, y: str, *by: str) -> DataFrame:
    """Exact AUC from counts of each distinct score: values are aggregated first, and only the distinct ones are ordered,
    within their group, or over ranges of the score where there is one group for all rows."""
    per = rows.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    if by:
        less = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        per, less = with_sums_before(per, [F.col(p).asc()], ["neg"]), F.col("neg_before")
    scored = per.withColumn("won", F.col("pos") * (less + F.col("neg") / 2))
    return scored.groupBy(*by).agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"), F.sum("pos").alias("positives"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def ndcg(rows: DataFrame, score: str, y: str, k: int = 3) -> DataFrame:
    """Per day, with binary gain; days without a positive are left out."""
    gain = lambda r: F.when(r <= k, 1 / F.log2(r + 1)).otherwise(0.0)
    ranked = rows.withColumns({"r_": F.row_number().over(day_window().orderBy(F.round(score, 9).desc(), "market")), "i_": F.row_number().over(day_window().orderBy(F.desc(y), "market"))})
    per = ranked.groupBy("day").agg(F.sum(gain(F.col("r_")) * F.col(y)).alias("dcg"), F.sum(gain(F.col("i_")) * F.col(y)).alias("ideal"))
    return per.where("ideal > 0").withColumn("ndcg", F.col("dcg") / F.col("ideal"))


def daily_ic(rows: DataFrame, score: str, value: str, min_rows: int = 5) -> DataFrame:
    """Spearman correlation of score and value on days with enough rows."""
    ranked = rows.where(F.col(score).isNotNull() & F.col(value).isNotNull()).withColumns({"a_": average_rank(F.round(score, 9), "day"), "b_": average_rank(F.round(value, 9), "day")})
    return ranked.groupBy("day").agg(F.count("*").alias("n"), (F.covar_pop("a_", "b_") / F.nullif(F.stddev_pop("a_") * F.stddev_pop("b_"), F.lit(0.0))).alias("ic")).where(F.col("n") >= min_rows)


def apply_buckets(rows: DataFrame, score: str, table: DataFrame) -> DataFrame:
    """The rate of the first bucket whose upper edge is at least the score, else of the last one.

    table: one row a bucket (bucket, hi, rate), as the fit made it: at most as many rows as there are buckets, so it becomes
    one array beside each row. Buckets that end at one score are told apart by their number.
    """
    edges = table.agg(F.array_sort(F.collect_list(F.struct("bucket", "hi", "rate"))).alias("t_"))
    pick = F.coalesce(F.get(F.filter("t_", lambda b: b["hi"] >= F.col(score)), F.lit(0))["rate"], F.element_at("t_", -1)["rate"])
    return rows.crossJoin(F.broadcast(edges)).withColumn("calibrated", pick).drop("t_")


def policy_metrics(ledger: DataFrame, by: str) -> DataFrame:
    x = F.col("net_pct")
    return ledger.where("status = 'closed'").groupBy(by).agg(F.count("*").alias("n"), F.sum(x).alias("net_sum"), F.avg(x).alias("net_mean"), F.avg((x <= -5).cast("int")).alias("deep_loss"), F.avg((x > 0).cast("int")).alias("hit"), F.countDistinct("day").alias("days"))


def hierarchical_evidence(rows: DataFrame, levels: list[list[str]], min_n: int) -> DataFrame:
    """For each combination of the finest level the first level with enough closed rows: one pass by grouping sets."""
    cols = levels[0]
    every = rows.groupingSets([[F.col(c) for c in level] for level in levels], *cols).agg(F.count("*").alias("n"), F.avg("net_pct").alias("mean"), F.grouping_id(*cols).alias("g_"))
    out = rows.select(*cols).distinct()
    for k, level in enumerate(levels):
        gid = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in level)
        own = every.where(F.col("g_") == gid).select(*level, F.col("n").alias(f"n{k}"), F.col("mean").alias(f"m{k}"))
        out = out.join(own, level, "left") if level else out.crossJoin(F.broadcast(own))
    chosen = F.coalesce(*[F.when(F.col(f"n{k}") >= min_n, F.struct(F.lit(k).alias("level"), F.col(f"n{k}").alias("n"), F.col(f"m{k}").alias("mean"))) for k in range(len(levels))])
    return out.withColumn("e_", chosen).select(*cols, "e_.level", "e_.n", "e_.mean")


def confidence_tier(n: Column, mean: Column) -> Column:
    return F.when(n.isNull(), "none").when((n >= 200) & (mean > 0), "high").when((n >= 50) & (mean > 0), "medium").when(mean > 0, "low").otherwise("weak")


def leave_one_out(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of the others, for each key of a one-row-per-key table; null where there are none."""
    w = Window.partitionBy(F.lit(0))
    return rows.withColumn("without", F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1))


def apply_ranges(rows: DataFrame, score: str, table: DataFrame) -> DataFrame:
    """The rate of the first bucket (bucket, lo, hi, rate) whose [lo, hi] holds the score; below all, the first; otherwise unmatched, the last."""
    edges = table.agg(F.array_sort(F.collect_list(F.struct("bucket", "lo", "hi", "rate"))).alias("t_"))
    inside = F.get(F.filter("t_", lambda b: (b["lo"] <= F.col(score)) & (F.col(score) <= b["hi"])), F.lit(0))["rate"]
    first, last = F.element_at("t_", 1), F.element_at("t_", -1)
    return rows.crossJoin(F.broadcast(edges)).withColumn("calibrated", F.coalesce(inside, F.when(F.col(score) < first["lo"], first["rate"]), last["rate"])).drop("t_")
