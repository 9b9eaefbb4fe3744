"""Queries: bootstraps by date and the report of a binary head."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate as e
from tidemark.operators import resampling as rs
from tidemark.plans.q_evaluate import DAYNET, H, day_net, hy
from tidemark.plans.registry import query
from tidemark.sources.scratch import stored

REPS = 100


def drawn(days: str, seed: str | int, block: int = 1, wrap: bool = True, by: str = "", reps: int = REPS, name: str = "dr") -> str:
    """SQL: `name` (group, rep, i) of the draws for a table of days that has i and n."""
    group, also = (f"{by}, ", f"{by}, ") if by else ("", "")
    h = f"('0x' || substr(md5({seed} || '|' || rep::VARCHAR || '|' || (k // {block})::VARCHAR), 1, 12))::BIGINT"
    at = f"({h} % n + k % {block}) % n" if wrap else f"{h} % (n - {block} + 1) + k % {block}"
    return f"{name} AS (SELECT {group}rep, {at} AS i FROM range({reps}) a(rep), (SELECT {also}i AS k, n FROM {days}))"


def ends(x: str) -> str:
    return f"quantile_cont({x}, 0.025) AS low, quantile_cont({x}, 0.5) AS mid, quantile_cont({x}, 0.975) AS high, count({x}) AS reps"


#: Daily returns of the ledger as shares, two thousandths of the percent so that they compound.
RET = f"{DAYNET}, ix AS (SELECT x / 500 AS x, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM dn)"
STATS = {"mean": "avg(x)", "cumulative": "exp(sum(ln(1 + x))) - 1", "sharpe": "CASE WHEN stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(365) ELSE 0 END"}


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_net(spark, sf_dir).select("day", (F.col("x") / 500).alias("x"))


def statistics(spark: SparkSession, sf_dir: str, block: int) -> DataFrame:
    stats = {"mean": F.avg("x"), "cumulative": rs.compounded(F.col("x")), "sharpe": rs.sharpe(F.col("x"))}
    return rs.intervals(rs.replicated(returns(spark, sf_dir), stats, REPS, 7, block), list(stats))


for name, block in (("b_01_date_bootstrap", 1), ("b_04_circular_block", 5)):
    query(
        name, "stat:s low:d mid:d high:d reps:l",
        f"{RET}, {drawn('ix', repr('7'), block)}, re AS (SELECT rep, {', '.join(f'{e} AS {n}' for n, e in STATS.items())} FROM dr JOIN ix USING (i) GROUP BY rep) "
        + " UNION ALL ".join(f"SELECT '{n}' AS stat, {ends(n)} FROM re" for n in STATS),
    )(lambda s, d, block=block: statistics(s, d, block))

METRICS = ["up10", "dn5", "clean", "bracket", "eod", "mae"]
#: Six outcomes of the three picks of each day, less those of all names.
VECTOR = f"""{H}, o AS (SELECT day, rk, (high / open - 1 >= 0.1)::INT AS up10, (low / open - 1 <= -0.05)::INT AS dn5, (high / open - 1 >= 0.1 AND low / open - 1 > -0.05)::INT AS clean,
 CASE WHEN low / open - 1 <= -0.03 THEN -0.03 WHEN high / open - 1 >= 0.05 THEN 0.05 ELSE close / open - 1 END - 0.0015 AS bracket, close / open - 1 - 0.0015 AS eod, low / open - 1 AS mae FROM y),
 dv AS (SELECT day, {", ".join(f"avg(CASE WHEN rk <= 3 THEN {m} END) - avg({m}) AS {m}" for m in METRICS)} FROM o GROUP BY day),
 ix AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM dv)"""


def day_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down, end = F.col("high") / F.col("open") - 1, F.col("low") / F.col("open") - 1, F.col("close") / F.col("open") - 1
    rows = hy(spark, sf_dir).withColumns({
        "up10": (up >= 0.1).cast("int"), "dn5": (down <= -0.05).cast("int"), "clean": ((up >= 0.1) & (down > -0.05)).cast("int"),
        "bracket": F.when(down <= -0.03, -0.03).when(up >= 0.05, 0.05).otherwise(end) - 0.0015, "eod": end - 0.0015, "mae": down,
    })
    return rows.groupBy("day").agg(*[(F.avg(F.when(F.col("rk") <= 3, F.col(m))) - F.avg(m)).alias(m) for m in METRICS])


query(
    "b_02_block_bootstrap", "metric:s dates:l mean:d iid_low:d iid_high:d block_low:d block_high:d",
    f"""{VECTOR}, {drawn('ix', repr('11'), 1, False, name='da')}, {drawn('ix', repr('11'), 3, False, name='db')},
 ra AS (SELECT rep, {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM da JOIN ix USING (i) GROUP BY rep), rb AS (SELECT rep, {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM db JOIN ix USING (i) GROUP BY rep) """
    + " UNION ALL ".join(f"""SELECT '{m}' AS metric, (SELECT count(*) FROM ix) AS dates, (SELECT avg({m}) FROM ix) AS mean, (SELECT quantile_cont({m}, 0.025) FROM ra) AS iid_low,
 (SELECT quantile_cont({m}, 0.975) FROM ra) AS iid_high, (SELECT quantile_cont({m}, 0.025) FROM rb) AS block_low, (SELECT quantile_cont({m}, 0.975) FROM rb) AS block_high""" for m in METRICS),
)(lambda s, d: rs.vector_summary(day_vectors(s, d), METRICS, REPS, 11))

#: Rows placed in days; each replicate's scores with its positives and negatives, and the negatives below.
CLUSTER = f"""{H}, u AS (SELECT day, p_up10 AS p, y.y AS y FROM y), pd AS (SELECT day, count(*) AS c, sum(pow(p - y, 2)) AS sse FROM u GROUP BY day),
 ix AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM pd), {drawn('ix', repr('5'))},
 mu AS (SELECT rep, i, count(*) AS m FROM dr GROUP BY ALL UNION ALL SELECT {REPS}, i, 1 FROM ix),
 sc_ AS (SELECT rep, p, sum(m * y) AS pos, sum(m * (1 - y)) AS neg FROM u JOIN ix USING (day) JOIN mu USING (i) GROUP BY ALL),
 wn AS (SELECT rep, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS won FROM sc_),
 au AS (SELECT rep, sum(won) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS auc FROM wn GROUP BY rep),
 br AS (SELECT rep, sum(m * sse) / sum(m * c) AS brier FROM mu JOIN ix USING (i) GROUP BY rep)"""
query(
    "b_05_cluster_bootstrap", "metric:s value:d low:d mid:d high:d reps:l",
    f"""{CLUSTER} SELECT 'auc' AS metric, (SELECT auc FROM au WHERE rep = {REPS}) AS value, {ends('auc')} FROM au WHERE rep < {REPS}
 UNION ALL SELECT 'brier', (SELECT brier FROM br WHERE rep = {REPS}), {ends('brier')} FROM br WHERE rep < {REPS}""",
)(lambda s, d: cluster(s, d))


def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and Brier score of the first head, recomputed in each replicate of days."""
    rows = stored(rs.usable(hy(spark, sf_dir), "p_up10", "y"), "head")
    days = rs.numbered(rows.groupBy("day").agg(F.count("*").alias("rows"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sse")))
    placed = rows.join(F.broadcast(days.select("day", "i")), "day").select("i", "p", "y")
    many = rs.multiplicities(spark, days.count(), REPS, 5)
    auc = rs.replicate_auc(placed, "p", "y", many)
    brier = rs.replicated(days.select("day", "rows", "sse"), {"brier": F.sum("sse") / F.sum("rows")}, REPS, 5)
    both = rs.intervals(auc, ["auc"]).unionByName(rs.intervals(brier, ["brier"]))
    point = e.auc(rows, "p", "y").selectExpr("'auc' as stat", "auc as value").unionByName(e.brier(rows, "p", "y").selectExpr("'brier' as stat", "brier as value"))
    return both.join(F.broadcast(point), "stat").withColumnRenamed("stat", "metric")


query(
    "a_54_head_report", "status:s reason:s n_rows:l n_days:l positives:l negatives:l positive_rate:d auc:d auc_low:d auc_high:d auc_valid:l brier:d brier_low:d brier_high:d",
    f"""{CLUSTER}, n AS (SELECT count(*) AS n_rows, count(DISTINCT day) AS n_days, sum(y) AS positives, sum(1 - y) AS negatives, avg(y) AS positive_rate FROM u)
 SELECT 'ok' AS status, NULL AS reason, n.*, (SELECT auc FROM au WHERE rep = {REPS}) AS auc, (SELECT quantile_cont(auc, 0.025) FROM au WHERE rep < {REPS}) AS auc_low,
 (SELECT quantile_cont(auc, 0.975) FROM au WHERE rep < {REPS}) AS auc_high, (SELECT count(auc) FROM au WHERE rep < {REPS}) AS auc_valid, (SELECT brier FROM br WHERE rep = {REPS}) AS brier,
 (SELECT quantile_cont(brier, 0.025) FROM br WHERE rep < {REPS}) AS brier_low, (SELECT quantile_cont(brier, 0.975) FROM br WHERE rep < {REPS}) AS brier_high FROM n""",
)(lambda s, d: rs.head_report(hy(s, d), "p_up10", "y", REPS, 5))

EDGES = [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 1.0]
query(
    "a_54_calibration_bins", "bin:l n_rows:l n_days:l predicted:d observed:d low:d high:d error_share:d",
    f"""{H}, u AS (SELECT day, p_up10 AS p, y.y AS y, {" + ".join(f"(p_up10 >= {e})::INT" for e in EDGES[1:-1])} AS bin FROM y), pd AS (SELECT bin, day, count(*) AS k, sum(p) AS sp, sum(y) AS sy FROM u GROUP BY ALL),
 ix AS (SELECT *, sy / k AS rate, row_number() OVER (PARTITION BY bin ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY bin) AS n FROM pd),
 tb AS (SELECT bin, sum(k) AS n_rows, count(*) AS n_days, avg(sp / k) AS predicted, avg(rate) AS observed, abs(sum(sp) - sum(sy)) AS gap FROM ix GROUP BY bin),
 {drawn('ix', "(105 + bin)::VARCHAR", by='bin')}, re AS (SELECT bin, rep, avg(rate) AS x FROM dr JOIN ix USING (bin, i) GROUP BY ALL), ci AS (SELECT bin, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM re GROUP BY bin)
 SELECT tb.bin, n_rows, n_days, predicted, observed, CASE WHEN n_days >= 30 THEN low END AS low, CASE WHEN n_days >= 30 THEN high END AS high, gap / sum(n_rows) OVER () AS error_share FROM tb LEFT JOIN ci ON ci.bin = tb.bin""",
)(lambda s, d: rs.calibration_bins(hy(s, d), "p_up10", "y", EDGES, REPS))
