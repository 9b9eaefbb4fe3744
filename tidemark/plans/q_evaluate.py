"""Queries: evaluation, splits, replay and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import contracts as c
from tidemark.operators import evaluate as e
from tidemark.operators import features as f
from tidemark.operators import ranks as r
from tidemark.operators import selection as x
from tidemark.operators import splits as v
from tidemark.plans.duck import LEDGER
from tidemark.plans.duck import lag as lg
from tidemark.plans.q_features import FLAG, W
from tidemark.plans.q_selection import HEADS, ranked, universe
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, ledger

L = f"WITH {LEDGER}"
H = f"{HEADS}, y AS (SELECT *, (high / open - 1 >= 0.05)::INT AS y, close / open - 1 AS ret FROM d1)"


def hy(s, d):
    return ranked(s, d).withColumns({"y": (F.col("high") / F.col("open") - 1 >= 0.05).cast("int"), "ret": F.col("close") / F.col("open") - 1})


def pr_avg(col: str) -> str:
    """Average-tie rank from one within a day."""
    return f"rank() OVER (PARTITION BY day ORDER BY {col}) + (count(*) OVER (PARTITION BY day, {col}) - 1) / 2.0"


def _best(s, d):
    return bars_1d(s, d).withColumn("m", F.col("high") / F.col("open") - 1).withColumn("bin", F.least(F.floor(F.col("m") / 0.02), F.lit(5)))


query("a_01_label_bins", "bin:l n:l mean:d std:d median:d share:d", f"{W}, b AS (SELECT least(floor((high / open - 1) / 0.02), 5) AS bin, high / open - 1 AS m FROM bars) SELECT bin, count(*) AS n, avg(m) AS mean, stddev_samp(m) AS std, quantile_cont(m, 0.5) AS median, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM b GROUP BY bin")(
    lambda s, d: _best(s, d).groupBy("bin").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std")).join(r.quantiles(_best(s, d), "m", {"median": 0.5}, "bin"), "bin").withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
)
query("a_04_rule_lift", "rule:s fires:l hits:l precision:d lift:d recall:d", H + " " + " UNION ALL ".join(f"SELECT '{n}' AS rule, sum(({p})::INT) AS fires, sum(CASE WHEN {p} THEN y ELSE 0 END) AS hits, avg(CASE WHEN {p} THEN y END) AS precision, avg(CASE WHEN {p} THEN y END) / avg(y) AS lift, sum(CASE WHEN {p} THEN y ELSE 0 END) / sum(y)::DOUBLE AS recall FROM y" for n, p in {"top": "rk <= 3", "dump": "dump", "rr": "rr >= 1"}.items()))(
    lambda s, d: hy(s, d).select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.expr(p).alias("on")) for n, p in {"top": "rk <= 3", "dump": "dump", "rr": "rr >= 1"}.items()])).alias("z")).groupBy("z.rule").agg(F.sum(F.col("z.on").cast("int")).alias("fires"), F.sum(F.when(F.col("z.on"), F.col("y")).otherwise(0)).alias("hits"), F.avg(F.when(F.col("z.on"), F.col("y"))).alias("precision"), F.avg("y").alias("base"), F.sum("y").alias("all_hits")).withColumns({"lift": F.col("precision") / F.col("base"), "recall": F.col("hits") / F.col("all_hits")})
)
query("a_05_top_share_lift", "n:l precision:d lift:d", f"{FLAG}, q AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, day, market) AS i, count(*) OVER () AS m FROM o) SELECT count(*) AS n, avg(hit) AS precision, avg(hit) / (SELECT avg(hit) FROM o) AS lift FROM q WHERE i <= greatest(1, floor(m * 0.05))")(
    lambda s, d: _top_share(universe(s, d).withColumn("hit", (F.col("high") / F.col("open") - 1 >= 0.05).cast("int")), 0.05)
)


def _top_share(rows, share: float):
    """Precision of the best share of all rows, ties by day and market."""
    n = rows.count()
    k = max(1, int(n * share))
    best = rows.orderBy(F.round("score", 9).desc(), "day", "market").limit(k).agg(F.count("*").alias("n"), F.avg("hit").alias("precision"))
    return best.crossJoin(rows.agg(F.avg("hit").alias("base"))).withColumn("lift", F.col("precision") / F.col("base"))


query("a_07_reliability", "bin:l n:l mean_p:d rate:d", f"{H} SELECT least(floor(p_up10 * 10), 9) AS bin, count(*) AS n, avg(p_up10) AS mean_p, avg(y) AS rate FROM y GROUP BY 1")(lambda s, d: e.reliability(hy(s, d), "p_up10", "y"))
query("a_08_day_equal_calibration", "bin:l n:l day_rate:d day_p:d", f"{H}, z AS (SELECT day, (p_up10 >= 0.1)::INT + (p_up10 >= 0.2)::INT + (p_up10 >= 0.3)::INT AS bin, avg(y) AS r, count(*) AS k, avg(p_up10) AS q FROM y GROUP BY ALL) SELECT bin, sum(k) AS n, avg(r) AS day_rate, avg(q) AS day_p FROM z GROUP BY bin")(lambda s, d: e.day_equal_calibration(hy(s, d), "p_up10", "y", [0.1, 0.2, 0.3]))
query("a_08_calibration_error", "ece:d", f"{H}, z AS (SELECT least(floor(p_up10 * 10), 9) AS bin, count(*) AS n, avg(p_up10) AS p, avg(y) AS r FROM y GROUP BY 1) SELECT sum(abs(p - r) * n) / sum(n) AS ece FROM z")(lambda s, d: e.calibration_error(e.reliability(hy(s, d), "p_up10", "y")))
query("a_09_brier", "brier:d n:l", f"{H} SELECT avg(pow(p_up10 - y, 2)) AS brier, count(*) AS n FROM y")(lambda s, d: e.brier(hy(s, d), "p_up10", "y"))
query("a_10_coverage", "coverage:d n:l", f"{W}, q AS (SELECT quantile_cont(close / open - 1, 0.1) AS a, quantile_cont(close / open - 1, 0.9) AS b FROM bars WHERE day < DATE '1998-01-01') SELECT avg((close / open - 1 BETWEEN a AND b)::INT) AS coverage, count(*) AS n FROM bars, q WHERE day >= DATE '1998-01-01'")(
    lambda s, d: (b := bars_1d(s, d).withColumn("r", F.col("close") / F.col("open") - 1)).where("day >= date'1998-01-01'").crossJoin(F.broadcast(r.quantiles(b.where("day < date'1998-01-01'"), "r", {"lo": 0.1, "hi": 0.9}))).agg(F.avg(F.col("r").between(F.col("lo"), F.col("hi")).cast("int")).alias("coverage"), F.count("*").alias("n"))
)
AUC = "sum(CASE WHEN y = 1 THEN rk_ END)"
query("a_11_auc", "auc:d positives:l n:l", f"{H}, z AS (SELECT y, rank() OVER (ORDER BY p_up10) + (count(*) OVER (PARTITION BY p_up10) - 1) / 2.0 AS rk_ FROM y) SELECT (sum(CASE WHEN y = 1 THEN rk_ ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc, sum(y) AS positives, count(*) AS n FROM z")(lambda s, d: e.auc(hy(s, d), "p_up10", "y"))
query("a_11_auc_by_day", "day:s auc:d n:l", f"{H}, z AS (SELECT day, y, rank() OVER (PARTITION BY day ORDER BY p_up10) + (count(*) OVER (PARTITION BY day, p_up10) - 1) / 2.0 AS rk_ FROM y) SELECT day, (sum(CASE WHEN y = 1 THEN rk_ ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)::DOUBLE AS auc, count(*) AS n FROM z GROUP BY day")(lambda s, d: e.auc(hy(s, d), "p_up10", "y", "day"))
G = "CASE WHEN {0} <= 3 THEN 1 / log2({0} + 1) ELSE 0 END"
query("a_12_ndcg", "day:s ndcg:d", f"{H}, z AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, market) AS i, row_number() OVER (PARTITION BY day ORDER BY y DESC, market) AS j FROM y) SELECT day, sum({G.format('i')} * y) / sum({G.format('j')} * y) AS ndcg FROM z GROUP BY day HAVING sum(y) > 0")(lambda s, d: e.ndcg(hy(s, d), "score", "y"))
query("a_13_daily_ic", "day:s n:l ic:d", f"{H}, z AS (SELECT day, {pr_avg('round(score, 9)')} AS a, {pr_avg('round(ret, 9)')} AS b FROM y) SELECT day, count(*) AS n, CASE WHEN isfinite(corr(a, b)) THEN corr(a, b) END AS ic FROM z GROUP BY day HAVING count(*) >= 5")(
    lambda s, d: e.daily_ic(hy(s, d), "score", "ret")
)
query("a_14_bucket_calibration", "day:s market:s calibrated:d", f"{FLAG}, q AS (SELECT *, row_number() OVER (ORDER BY round(score, 9), day, market) AS i, count(*) OVER () AS n FROM o WHERE day < DATE '1998-01-01'), t AS (SELECT greatest(((i - 1) * 10 + n - 2) // (n - 1) - 1, 0) AS b, max(round(score, 9)) AS hi, avg(hit) AS rate FROM q GROUP BY 1) SELECT day, market, coalesce((SELECT arg_min(rate, b) FROM t WHERE hi >= round(score, 9)), (SELECT arg_max(rate, b) FROM t)) AS calibrated FROM o WHERE day >= DATE '1998-01-01'")(
    lambda s, d: (u := universe(s, d).withColumns({"hit": (F.col("high") / F.col("open") - 1 >= 0.05).cast("int"), "sc": F.round("score", 9)})) is not None and e.apply_buckets(u.where("day >= date'1998-01-01'"), "sc", r.global_buckets(u.where("day < date'1998-01-01'"), "score", 10, "day", "market").groupBy("bucket").agg(F.max("sc").alias("hi"), F.avg("hit").alias("rate")))
)
query("a_15_bucket_downside", "bucket:l downside:d", f"{FLAG}, q AS (SELECT *, row_number() OVER (ORDER BY round(score, 9), day, market) AS i, count(*) OVER () AS n FROM o) SELECT greatest(((i - 1) * 10 + n - 2) // (n - 1) - 1, 0) AS bucket, avg(low / open - 1) AS downside FROM q GROUP BY 1")(
    lambda s, d: r.global_buckets(universe(s, d), "score", 10, "day", "market").groupBy("bucket").agg(F.avg(F.col("low") / F.col("open") - 1).alias("downside"))
)
query("a_17_percentile_bands", "band:s n:l hit:d", f"{H}, q AS (SELECT quantile_cont(score, 0.9) AS a, quantile_cont(score, 0.99) AS b FROM y) SELECT CASE WHEN score >= b THEN 'p99' WHEN score >= a THEN 'p90' ELSE 'rest' END AS band, count(*) AS n, avg(y) AS hit FROM y, q GROUP BY 1")(
    lambda s, d: (u := hy(s, d)).crossJoin(F.broadcast(r.quantiles(u, "score", {"lo": 0.9, "hi": 0.99}))).groupBy(F.when(F.col("score") >= F.col("hi"), "p99").when(F.col("score") >= F.col("lo"), "p90").otherwise("rest").alias("band")).agg(F.count("*").alias("n"), F.avg("y").alias("hit"))
)
query("a_19_cumulative_probabilities", "day:s market:s expected:d p_ge_2:d", f"{HEADS} SELECT day, market, (1 - p_up10) * 0 + (p_up10 - p_up20) * 0.1 + p_up20 * 0.2 AS expected, p_up20 + (p_up10 - p_up20) AS p_ge_2 FROM h")(
    lambda s, d: x.heads(universe(s, d)).withColumn("p", F.array(1 - F.col("p_up10"), F.col("p_up10") - F.col("p_up20"), F.col("p_up20"))).withColumns({"expected": F.aggregate(F.zip_with("p", F.array(F.lit(0.0), F.lit(0.1), F.lit(0.2)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b), "p_ge_2": F.aggregate(F.slice("p", 2, 2), F.lit(0.0), lambda a, b: a + b)})
)
query("a_21_exit_summary", "model_id:s cost:s mean_net:d", f"{L} SELECT model_id, cost, avg(net_pct - c) AS mean_net FROM ledger, (VALUES ('standard', 0.15), ('conservative', 0.5)) v(cost, c) WHERE status = 'closed' GROUP BY ALL")(
    lambda s, d: ledger(s, d).where("status = 'closed'").selectExpr("model_id", "stack(2, 'standard', net_pct - 0.15, 'conservative', net_pct - 0.5) as (cost, x)").groupBy("model_id", "cost").agg(F.avg("x").alias("mean_net"))
)
EV = f"""{L}, cl AS (SELECT *, CASE WHEN net_pct % 2 < 0 THEN 'a' ELSE 'b' END AS setup FROM ledger WHERE status = 'closed'), b AS (SELECT DISTINCT coin, model_id FROM cl), l0 AS (SELECT coin, model_id, count(*) AS n, avg(net_pct) AS mean FROM cl GROUP BY ALL), l1 AS (SELECT coin, count(*) AS n, avg(net_pct) AS mean FROM cl GROUP BY ALL), l2 AS (SELECT count(*) AS n, avg(net_pct) AS mean FROM cl),
 ev AS (SELECT b.coin, b.model_id, CASE WHEN l0.n >= 80 THEN 0 WHEN l1.n >= 80 THEN 1 WHEN l2.n >= 80 THEN 2 END AS level, CASE WHEN l0.n >= 80 THEN l0.n WHEN l1.n >= 80 THEN l1.n WHEN l2.n >= 80 THEN l2.n END AS n, CASE WHEN l0.n >= 80 THEN l0.mean WHEN l1.n >= 80 THEN l1.mean WHEN l2.n >= 80 THEN l2.mean END AS mean FROM b LEFT JOIN l0 ON l0.coin = b.coin AND l0.model_id = b.model_id LEFT JOIN l1 ON l1.coin = b.coin, l2)"""


def evidence(s, d):
    return e.hierarchical_evidence(ledger(s, d).where("status = 'closed'"), [["coin", "model_id"], ["coin"], []], 80)


query("a_24_evidence", "coin:s model_id:s level:l n:l mean:d", f"{EV} SELECT * FROM ev")(evidence)
TIERS = "CASE WHEN n IS NULL THEN 'none' WHEN n >= 200 AND mean > 0 THEN 'high' WHEN n >= 50 AND mean > 0 THEN 'medium' WHEN mean > 0 THEN 'low' ELSE 'weak' END"
query("a_25_confidence", "coin:s model_id:s tier:s", f"{EV} SELECT coin, model_id, {TIERS} AS tier FROM ev")(lambda s, d: evidence(s, d).withColumn("tier", e.confidence_tier(F.col("n"), F.col("mean"))))
query("a_26_meta_filter", "trade_id:l demoted:b", f"{EV} SELECT trade_id, {TIERS} IN ('none', 'weak') AS demoted FROM ledger l JOIN ev ON ev.coin = l.coin AND ev.model_id = l.model_id")(
    lambda s, d: ledger(s, d).join(evidence(s, d), ["coin", "model_id"]).withColumn("demoted", e.confidence_tier(F.col("n"), F.col("mean")).isin("none", "weak"))
)
query("a_28_half_split", "model_id:s half:l n:l mean:d", f"{L}, dd AS (SELECT day, ntile(2) OVER (ORDER BY day) AS half FROM (SELECT DISTINCT day FROM ledger WHERE status = 'closed')) SELECT model_id, half, count(*) AS n, avg(net_pct) AS mean FROM ledger JOIN dd USING (day) WHERE status = 'closed' GROUP BY ALL")(
    lambda s, d: (q := ledger(s, d).where("status = 'closed'")).join(q.select("day").distinct().withColumn("half", F.ntile(2).over(Window.orderBy("day"))), "day").groupBy("model_id", "half").agg(F.count("*").alias("n"), F.avg("net_pct").alias("mean"))
)
query("a_29_setup_breakdown", "setup:s n:l hit:d", f"{H}, t AS (SELECT unnest([CASE WHEN r7 > 0.02 THEN 'S01' END, CASE WHEN s7 > 1.2 THEN 'S02' END, CASE WHEN r1 > 0 AND r3 < 0 THEN 'S03' END, CASE WHEN liq <= 5 THEN 'S04' END]) AS setup, y FROM y) SELECT setup, count(*) AS n, avg(y) AS hit FROM t WHERE setup IS NOT NULL GROUP BY setup")(
    lambda s, d: x.setups(hy(s, d)).withColumn("joined", F.concat_ws("+", "setups")).where("joined != ''").select("y", F.explode(F.split("joined", r"\+")).alias("setup")).groupBy("setup").agg(F.count("*").alias("n"), F.avg("y").alias("hit"))
)
query("a_30_failure_separators", "feature:s dump_mean:d sustain_mean:d", H + " " + " UNION ALL ".join(f"SELECT '{c_}' AS feature, avg(CASE WHEN ret < -0.02 THEN {c_} END) AS dump_mean, avg(CASE WHEN ret >= 0 THEN {c_} END) AS sustain_mean FROM y" for c_ in ("r1", "r3", "r7", "s7")))(
    lambda s, d: hy(s, d).unpivot(["ret"], ["r1", "r3", "r7", "s7"], "feature", "v").groupBy("feature").agg(F.avg(F.when(F.col("ret") < -0.02, F.col("v"))).alias("dump_mean"), F.avg(F.when(F.col("ret") >= 0, F.col("v"))).alias("sustain_mean"))
)
TWO = f"{L}, a AS (SELECT DISTINCT day, coin FROM ledger WHERE model_id = '1-URGENT'), b AS (SELECT DISTINCT day, coin FROM ledger WHERE model_id = '2-HIGH')"


def picks(s, d, model):
    return ledger(s, d).where(F.col("model_id") == model).select("day", "coin").distinct()


query("a_34_u_05_added_removed", "day:s coin:s change:s", f"{TWO} SELECT day, coin, 'removed' AS change FROM a ANTI JOIN b USING (day, coin) UNION ALL SELECT day, coin, 'added' FROM b ANTI JOIN a USING (day, coin)")(
    lambda s, d: picks(s, d, "1-URGENT").join(picks(s, d, "2-HIGH"), ["day", "coin"], "left_anti").withColumn("change", F.lit("removed")).unionByName(picks(s, d, "2-HIGH").join(picks(s, d, "1-URGENT"), ["day", "coin"], "left_anti").withColumn("change", F.lit("added")))
)
query("u_01_union_all", "model_id:s n:l", f"{L} SELECT model_id, count(*) AS n FROM (SELECT * FROM ledger WHERE status = 'closed' UNION ALL SELECT * FROM ledger WHERE status = 'open') GROUP BY model_id")(lambda s, d: ledger(s, d).where("status = 'closed'").unionByName(ledger(s, d).where("status = 'open'")).groupBy("model_id").agg(F.count("*").alias("n")))
query("u_02_intersection", "day:s coin:s", f"{TWO} SELECT * FROM a INTERSECT SELECT * FROM b")(lambda s, d: picks(s, d, "1-URGENT").intersect(picks(s, d, "2-HIGH")))
query("u_03_churn", "day:s churn:d", f"{TWO}, f AS (SELECT coalesce(a.day, b.day) AS day, a.coin AS x, b.coin AS y FROM a FULL JOIN b ON a.day = b.day AND a.coin = b.coin) SELECT day, avg((x IS NULL OR y IS NULL)::INT) AS churn FROM f GROUP BY day")(
    lambda s, d: picks(s, d, "1-URGENT").withColumn("x", F.lit(1)).join(picks(s, d, "2-HIGH").withColumn("y", F.lit(1)), ["day", "coin"], "full").groupBy("day").agg(F.avg((F.col("x").isNull() | F.col("y").isNull()).cast("int")).alias("churn"))
)
query("u_04_missing_markets", "day:s market:s", f"{W} SELECT d.day, m.market FROM (SELECT DISTINCT day FROM bars WHERE day < DATE '1996-01-01') d, (SELECT DISTINCT market FROM bars) m WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.day = d.day AND b.market = m.market)")(
    lambda s, d: (b := bars_1d(s, d)).where("day < date'1996-01-01'").select("day").distinct().crossJoin(F.broadcast(b.select("market").distinct())).join(b.select("day", "market"), ["day", "market"], "left_anti")
)
query("u_06_j_15_priority", "day:s coin:s model_id:s models:l", f"{L}, z AS (SELECT *, row_number() OVER (PARTITION BY day, coin ORDER BY model_id, trade_id) AS i FROM ledger), k AS (SELECT day, coin, count(DISTINCT model_id) AS models FROM ledger GROUP BY ALL) SELECT z.day, z.coin, model_id, models FROM z JOIN k ON k.day = z.day AND k.coin = z.coin WHERE i = 1 AND models >= 2")(
    lambda s, d: ledger(s, d).groupBy("day", "coin").agg(F.min_by("model_id", F.struct("model_id", "trade_id")).alias("model_id"), F.countDistinct("model_id").alias("models")).where("models >= 2")
)
query("j_12_predictions_actuals", "day:s coin:s net_pct:d close:d", f"{L}, {W[5:]} SELECT l.day, coin, net_pct, close FROM ledger l JOIN bars b ON b.day = l.day AND b.market = l.coin")(
    lambda s, d: ledger(s, d).join(bars_1d(s, d).withColumnRenamed("market", "coin"), ["day", "coin"])
)
query("j_13_bound_by_hash", "status:s n:l", f"{L}, a AS (SELECT trade_id, md5(trade_id::VARCHAR || coin) AS h FROM ledger), b AS (SELECT trade_id, md5(trade_id::VARCHAR || CASE WHEN trade_id % 50 = 0 THEN 'x' ELSE coin END) AS g FROM ledger WHERE trade_id % 20 <> 1) SELECT CASE WHEN g IS NULL THEN 'missing' WHEN g <> h THEN 'mismatch' ELSE 'bound' END AS status, count(*) AS n FROM a LEFT JOIN b USING (trade_id) GROUP BY 1")(
    lambda s, d: ledger(s, d).select("trade_id", F.md5(F.concat(F.col("trade_id").cast("string"), "coin").cast("binary")).alias("h")).join(ledger(s, d).where("trade_id % 20 != 1").select("trade_id", F.md5(F.concat(F.col("trade_id").cast("string"), F.when(F.col("trade_id") % 50 == 0, "x").otherwise(F.col("coin"))).cast("binary")).alias("g")), "trade_id", "left").groupBy(F.when(F.col("g").isNull(), "missing").when(F.col("g") != F.col("h"), "mismatch").otherwise("bound").alias("status")).agg(F.count("*").alias("n"))
)
query("j_14_fill_outcomes", "trade_id:l net_pct:d", f"{L} SELECT l.trade_id, coalesce(CASE WHEN l.trade_id % 3 <> 0 THEN l.net_pct END, p.v) AS net_pct FROM ledger l LEFT JOIN (SELECT trade_id, net_pct / 2 AS v FROM ledger WHERE trade_id % 2 = 0) p USING (trade_id)")(
    lambda s, d: ledger(s, d).join(ledger(s, d).where("trade_id % 2 = 0").select("trade_id", (F.col("net_pct") / 2).alias("v")), "trade_id", "left").withColumn("net_pct", F.coalesce(F.when(F.col("trade_id") % 3 != 0, F.col("net_pct")), F.col("v")))
)
query("j_21_overlap_recall", "day:s picks:l pumps:l caught:l", f"{HEADS}, p AS (SELECT day, market FROM d1 WHERE rk <= 3), q AS (SELECT day, market FROM bars WHERE high / open - 1 >= 0.1) SELECT c.day, count(p.market) AS picks, count(q.market) AS pumps, sum((p.market IS NOT NULL AND q.market IS NOT NULL)::INT) AS caught FROM (SELECT day, market FROM bars) c LEFT JOIN p ON p.day = c.day AND p.market = c.market LEFT JOIN q ON q.day = c.day AND q.market = c.market GROUP BY c.day")(
    lambda s, d: bars_1d(s, d).select("day", "market", (F.col("high") / F.col("open") - 1 >= 0.1).cast("int").alias("q")).join(ranked(s, d).where("rk <= 3").select("day", "market", F.lit(1).alias("p")), ["day", "market"], "left").groupBy("day").agg(F.count("p").alias("picks"), F.sum("q").alias("pumps"), F.sum(F.coalesce(F.col("p") * F.col("q"), F.lit(0))).alias("caught"))
)
DAYNET = f"{L}, dn AS (SELECT day, avg(net_pct) AS x FROM ledger WHERE status = 'closed' GROUP BY day)"


def day_net(s, d):
    return ledger(s, d).where("status = 'closed'").groupBy("day").agg(F.avg("net_pct").alias("x"))


query("a_35_leave_one_out", "day:s without:d", f"{DAYNET} SELECT day, (sum(x) OVER () - x) / (count(*) OVER () - 1) AS without FROM dn")(lambda s, d: e.leave_one_out(day_net(s, d), "day", "x"))
query("a_36_slot_legs", "day:s window_effect:d selection_effect:d total:d", f"{L}, g AS (SELECT day, avg(CASE WHEN model_id = '1-URGENT' THEN net_pct END) AS p, avg(CASE WHEN model_id = '2-HIGH' THEN net_pct END) AS q, avg(CASE WHEN model_id = '3-MEDIUM' THEN net_pct END) AS r FROM ledger WHERE status = 'closed' GROUP BY day) SELECT day, q - p AS window_effect, r - q AS selection_effect, r - p AS total FROM g WHERE p IS NOT NULL AND q IS NOT NULL AND r IS NOT NULL")(
    lambda s, d: ledger(s, d).where("status = 'closed'").groupBy("day").pivot("model_id", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.avg("net_pct")).toDF("day", "p", "q", "r").dropna().selectExpr("day", "q - p as window_effect", "r - q as selection_effect", "r - p as total")
)
query("a_38_mean_interval", "model_id:s n:l mean:d low:d high:d day_mean:d", f"{L}, t AS (SELECT model_id, count(*) AS n, avg(net_pct) AS mean, stddev_samp(net_pct) AS sd FROM ledger WHERE status = 'closed' GROUP BY model_id), u AS (SELECT model_id, avg(x) AS day_mean FROM (SELECT model_id, day, avg(net_pct) AS x FROM ledger WHERE status = 'closed' GROUP BY ALL) GROUP BY model_id) SELECT t.model_id, n, mean, mean - 1.96 * sd / sqrt(n) AS low, mean + 1.96 * sd / sqrt(n) AS high, day_mean FROM t JOIN u USING (model_id)")(
    lambda s, d: ledger(s, d).where("status = 'closed'").groupBy("model_id", "day").agg(F.count("*").alias("k"), F.sum("net_pct").alias("t"), F.sum(F.col("net_pct") * F.col("net_pct")).alias("tt")).groupBy("model_id").agg(F.sum("k").alias("n"), (F.sum("t") / F.sum("k")).alias("mean"), F.sum("tt").alias("tt"), F.avg(F.col("t") / F.col("k")).alias("day_mean")).withColumn("se", F.sqrt((F.col("tt") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1)) / F.sqrt("n")).withColumns({"low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se")})
)
query("a_39_cohort_counts", "status:s model_id:s n:l days:l", f"{L} SELECT status, model_id, count(*) AS n, count(DISTINCT day) AS days FROM ledger GROUP BY ALL")(lambda s, d: ledger(s, d).groupBy("status", "model_id").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days")))
query("a_40_null_ratio", "market:s r7_null:d s7_null:d last_day:s", f"{FLAG.replace('WHERE liq <= 10 AND history >= 70', '')} SELECT market, avg((r7 IS NULL)::INT) AS r7_null, avg((s7 IS NULL)::INT) AS s7_null, max(day) AS last_day FROM sc GROUP BY market")(
    lambda s, d: r.scored(bars_1d(s, d)).groupBy("market").agg(F.avg(F.col("r7").isNull().cast("int")).alias("r7_null"), F.avg(F.col("s7").isNull().cast("int")).alias("s7_null"), F.max("day").alias("last_day"))
)
query("a_44_universe_recall", "static_recall:d dynamic_recall:d", f"{FLAG.replace('WHERE liq <= 10 AND history >= 70', '')} SELECT sum(CASE WHEN liq <= 8 THEN h ELSE 0 END) / sum(h)::DOUBLE AS static_recall, sum(CASE WHEN liq <= 8 OR s7 >= 1.5 THEN h ELSE 0 END) / sum(h)::DOUBLE AS dynamic_recall FROM (SELECT *, (high / open - 1 >= 0.05)::INT AS h FROM sc)")(
    lambda s, d: r.scored(bars_1d(s, d)).withColumn("h", (F.col("high") / F.col("open") - 1 >= 0.05).cast("int")).agg((F.sum(F.expr("if(liq <= 8, h, 0)")) / F.sum("h")).alias("static_recall"), (F.sum(F.expr("if(liq <= 8 or s7 >= 1.5, h, 0)")) / F.sum("h")).alias("dynamic_recall"))
)
query("a_45_bar_qa", "market:s n:l span:l gaps:l longest_gap:l", f"{W}, g AS (SELECT *, day - {lg('day')} AS gap FROM bars) SELECT market, count(*) AS n, max(day) - min(day) AS span, sum((gap > 1)::INT) AS gaps, max(gap) AS longest_gap FROM g GROUP BY market")(lambda s, d: c.bar_gaps(bars_1d(s, d)))
query("a_48_policy_events", "event:s before:d after:d", f"{DAYNET}, ev(event, cut) AS (VALUES ('one', DATE '1995-01-01'), ('two', DATE '1997-01-01')) SELECT event, sum(CASE WHEN day < cut AND day >= cut - 365 THEN x ELSE 0 END) AS before, sum(CASE WHEN day >= cut AND day < cut + 365 THEN x ELSE 0 END) AS after FROM dn, ev GROUP BY event")(
    lambda s, d: day_net(s, d).withColumn("z", F.explode(F.array(F.struct(F.lit("one").alias("event"), F.lit("1995-01-01").cast("date").alias("at")), F.struct(F.lit("two").alias("event"), F.lit("1997-01-01").cast("date").alias("at"))))).withColumn("gap", F.datediff("day", "z.at")).groupBy("z.event").agg(F.sum(F.expr("if(gap < 0 and gap >= -365, x, 0)")).alias("before"), F.sum(F.expr("if(gap >= 0 and gap < 365, x, 0)")).alias("after"))
)
query("a_52_threshold_curve", "threshold:d base:d top_rate:d lift:d", f"{H}, z AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, market) AS i FROM y) SELECT threshold, avg((high / open - 1 >= threshold)::INT) AS base, avg(CASE WHEN i = 1 THEN (high / open - 1 >= threshold)::INT END) AS top_rate, avg(CASE WHEN i = 1 THEN (high / open - 1 >= threshold)::INT END) / avg((high / open - 1 >= threshold)::INT) AS lift FROM z, (VALUES (0.02), (0.04), (0.06)) v(threshold) GROUP BY threshold")(
    lambda s, d: hy(s, d).withColumn("i", F.row_number().over(x.day_window().orderBy(F.round("score", 9).desc(), "market"))).withColumn("threshold", F.explode(F.array(F.lit(0.02), F.lit(0.04), F.lit(0.06)))).withColumn("h", (F.col("high") / F.col("open") - 1 >= F.col("threshold")).cast("int")).groupBy("threshold").agg(F.avg("h").alias("base"), F.avg(F.when(F.col("i") == 1, F.col("h"))).alias("top_rate")).withColumn("lift", F.col("top_rate") / F.col("base"))
)
query("a_53_best_participant", "day:s model_id:s net_mean:d", f"{L}, g AS (SELECT day, model_id, avg(net_pct) AS net_mean, count(*) AS n FROM ledger WHERE status = 'closed' GROUP BY ALL) SELECT day, model_id, net_mean FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(net_mean, 9) DESC, n DESC, model_id) AS i FROM g) WHERE i = 1")(
    lambda s, d: ledger(s, d).where("status = 'closed'").groupBy("day", "model_id").agg(F.avg("net_pct").alias("net_mean"), F.count("*").alias("n")).withColumn("i", F.row_number().over(x.day_window().orderBy(F.round("net_mean", 9).desc(), F.desc("n"), "model_id"))).where("i = 1")
)
query("a_55_stratum_base", "day:s market:s base:d", f"{H}, z AS (SELECT *, liq <= 5 AS band FROM y) SELECT day, market, base FROM (SELECT *, avg(y) OVER (PARTITION BY day, band) AS base FROM z) WHERE rk <= 3")(lambda s, d: hy(s, d).withColumn("base", F.avg("y").over(Window.partitionBy("day", F.col("liq") <= 5))).where("rk <= 3"))
FD = f"{W}, dd AS (SELECT DISTINCT day FROM bars), di AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM dd)"
query("v_01_walk_forward", "fold:l role:s n:l first_day:s last_day:s", f"{W}, dd AS (SELECT DISTINCT day FROM bars), li AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM dd WHERE day <= (SELECT max(day) FROM dd) - 180), bl AS (SELECT *, (i * 6) // n AS block FROM li), st AS (SELECT block, min(day) AS a FROM bl WHERE block > 0 GROUP BY block), r AS (SELECT block - 1 AS fold, 'test' AS role, day FROM bl WHERE block > 0 UNION ALL SELECT st.block - 1, 'train', bl.day FROM bl, st WHERE bl.day < a - 5) SELECT fold, role, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM r GROUP BY ALL")(
    lambda s, d: v.walk_forward(bars_1d(s, d), 5, 5, 180).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
)
for name, two, cond in (("v_02_index_folds", False, "d.i < a - 5"), ("v_03_two_sided_folds", True, "(d.i < a - 5 OR d.i > b + 5)")):
    query(name, "fold:l role:s n:l first_day:s last_day:s", f"{FD}, bl AS (SELECT *, (i * 5) // n AS fold FROM di), st AS (SELECT fold, min(i) AS a, max(i) AS b FROM bl GROUP BY fold), r AS (SELECT fold, 'test' AS role, day FROM bl UNION ALL SELECT st.fold, 'train', d.day FROM bl d, st WHERE {cond}) SELECT fold, role, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM r GROUP BY ALL")(
        lambda s, d, two=two: v.index_folds(bars_1d(s, d), 5, 5, two).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    )
query("v_04_availability_purged", "fold:l n:l last_day:s", f"{W}, dd AS (SELECT DISTINCT day, day + 2 AS av FROM bars), fo(fold, cut) AS (VALUES (0, DATE '1995-01-01'), (1, DATE '1997-01-01')) SELECT fold, count(*) AS n, max(day) AS last_day FROM dd, fo WHERE av < cut GROUP BY fold")(
    lambda s, d: v.availability_purged(bars_1d(s, d).select("day").distinct().withColumn("available_at", F.date_add("day", 2)), s.createDataFrame([(0, "1995-01-01"), (1, "1997-01-01")], "fold int, at string").select("fold", F.col("at").cast("date").alias("decision_at"))).groupBy("fold").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))
)
query("v_05_common_days", "day:s", f"{L} SELECT day FROM ledger GROUP BY day HAVING count(DISTINCT model_id) = (SELECT count(DISTINCT model_id) FROM ledger)")(lambda s, d: v.common_days(ledger(s, d), "model_id"))
query("v_07_context_state", "day:s context:s", f"{W}, g AS (SELECT day, avg((close > open)::INT) AS b, sum(quote_volume) AS t FROM bars GROUP BY day), q AS (SELECT quantile_cont(b, 0.5) AS mb, quantile_cont(t, 0.5) AS mt FROM g) SELECT day, CASE WHEN b >= mb THEN 'broad' ELSE 'narrow' END || CASE WHEN t >= mt THEN '_active' ELSE '_thin' END AS context FROM g, q")(
    lambda s, d: (g := bars_1d(s, d).groupBy("day").agg(F.avg((F.col("close") > F.col("open")).cast("int")).alias("b"), F.sum("quote_volume").alias("t"))).crossJoin(F.broadcast(g.agg(F.percentile("b", 0.5).alias("mb"), F.percentile("t", 0.5).alias("mt")))).withColumn("context", F.concat(F.when(F.col("b") >= F.col("mb"), "broad").otherwise("narrow"), F.when(F.col("t") >= F.col("mt"), "_active").otherwise("_thin")))
)
DELTA = f"{L}, de AS (SELECT day, coalesce(avg(CASE WHEN model_id = '1-URGENT' THEN net_pct END), 0) - coalesce(avg(CASE WHEN model_id = '2-HIGH' THEN net_pct END), 0) AS delta, day + 2 AS av FROM ledger WHERE status = 'closed' GROUP BY day)"


def deltas(s, d):
    one = lambda m: F.coalesce(F.avg(F.when(F.col("model_id") == m, F.col("net_pct"))), F.lit(0.0))
    return ledger(s, d).where("status = 'closed'").groupBy("day").agg((one("1-URGENT") - one("2-HIGH")).alias("delta")).withColumn("available_day", F.date_add("day", 2))


query("v_08_causal_replay", "day:s n_known:l mean_delta:d arm:s", f"{DELTA}, k AS (SELECT a.day, b.delta, row_number() OVER (PARTITION BY a.day ORDER BY b.day DESC) AS i FROM de a JOIN de b ON b.av < a.day), m AS (SELECT day, count(*) AS n, avg(delta) AS mean FROM k WHERE i <= 20 GROUP BY day) SELECT de.day, coalesce(n, 0) AS n_known, mean AS mean_delta, CASE WHEN coalesce(n, 0) < 10 THEN 'control' WHEN mean > 0 THEN 'challenger' ELSE 'control' END AS arm FROM de LEFT JOIN m USING (day)")(
    lambda s, d: v.causal_replay(deltas(s, d), 20, 10)
)
query("v_12_fold_year_stability", "model_id:s year:l n:l mean:d", f"{L} SELECT model_id, year(day) AS year, count(*) AS n, avg(net_pct) AS mean FROM ledger WHERE status = 'closed' GROUP BY ALL")(lambda s, d: ledger(s, d).where("status = 'closed'").groupBy("model_id", F.year("day").alias("year")).agg(F.count("*").alias("n"), F.avg("net_pct").alias("mean")))
query("v_15_leak_check", "mismatches:l n:l", f"{W}, z AS (SELECT *, close / {lg('close')} - 1 AS r FROM bars), p AS (SELECT *, {lg('r')} AS lagged FROM z) SELECT sum((abs(p.lagged - q.r) > 1e-6)::INT) AS mismatches, count(*) AS n FROM p JOIN (SELECT market, lead(day) OVER (PARTITION BY market ORDER BY day) AS day, r FROM z) q ON q.market = p.market AND q.day = p.day")(
    lambda s, d: f.panel(bars_1d(s, d)).select("market", "day", "f_ret_1d").join(bars_1d(s, d).withColumn("r", f.ret()).select("market", F.lead("day").over(Window.partitionBy("market").orderBy("day")).alias("day"), "r"), ["market", "day"]).agg(F.sum((F.abs(F.col("f_ret_1d") - F.col("r")) > 1e-6).cast("int")).alias("mismatches"), F.count("*").alias("n"))
)
query("v_16_gates", "model_id:s passed:b", f"{L} SELECT model_id, count(*) >= 30 AND avg(net_pct) - 1.96 * stddev_samp(net_pct) / sqrt(count(*)) > 0 AS passed FROM ledger WHERE status = 'closed' GROUP BY model_id")(
    lambda s, d: ledger(s, d).where("status = 'closed'").groupBy("model_id").agg(((F.count("*") >= 30) & (F.avg("net_pct") - 1.96 * F.stddev_samp("net_pct") / F.sqrt(F.count("*")) > 0)).alias("passed"))
)
BOOT = "ix AS (SELECT x, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM dn), dr AS (SELECT rep, (('0x' || substr(md5('7|' || rep::VARCHAR || '|' || (k // {0})::VARCHAR), 1, 12))::BIGINT % n + k % {0}) % n AS i FROM range(200) a(rep), (SELECT i AS k, n FROM ix)), re AS (SELECT rep, avg(x) AS mean FROM dr JOIN ix USING (i) GROUP BY rep)"
query("b_03_paired_bootstrap", "low:d mid:d high:d reps:l", f"{DELTA}, dn AS (SELECT day, delta AS x FROM de), {BOOT.format(1)} SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.5) AS mid, quantile_cont(mean, 0.975) AS high, count(*) AS reps FROM re")(
    lambda s, d: v.interval(v.bootstrap(deltas(s, d).withColumnRenamed("delta", "x"), "x", 200, 7))
)
query("b_06_permutation", "observed:d p_value:d reps:l", f"{HEADS}, z AS (SELECT day, market, (liq <= 5)::INT AS g, close / open - 1 AS x FROM uni WHERE day >= DATE '1998-01-01'), e AS (SELECT rep, z.* FROM z, range(21) t(rep)), a AS (SELECT rep, day, x, row_number() OVER (PARTITION BY rep, day ORDER BY market) AS k FROM e), b AS (SELECT rep, day, g, row_number() OVER (PARTITION BY rep, day ORDER BY CASE WHEN rep = 0 THEN lpad(market, 20, '0') ELSE md5('3|' || rep::VARCHAR || '|' || market) END, market) AS k FROM e), r AS (SELECT rep, avg(CASE WHEN g = 1 THEN x END) - avg(CASE WHEN g = 0 THEN x END) AS diff FROM a JOIN b USING (rep, day, k) GROUP BY rep) SELECT max(CASE WHEN rep = 0 THEN diff END) AS observed, avg(CASE WHEN rep > 0 THEN (diff >= (SELECT diff FROM r WHERE rep = 0))::INT END) AS p_value, count(*) - 1 AS reps FROM r")(
    lambda s, d: (q := v.permutation(universe(s, d).where("day >= date'1998-01-01'").select("day", "market", (F.col("liq") <= 5).cast("int").alias("g"), (F.col("close") / F.col("open") - 1).alias("x")), "g", "x", "market", 20, 3)).crossJoin(F.broadcast(q.where("rep = 0").select(F.col("diff").alias("observed")))).where("rep > 0").groupBy("observed").agg(F.avg((F.col("diff") >= F.col("observed")).cast("int")).alias("p_value"), F.count("*").alias("reps"))
)
