"""Queries: further inventory rows built from the same operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import evaluate as e
from tidemark.operators import paths as p
from tidemark.operators import ranks as r
from tidemark.operators import selection as x
from tidemark.plans.duck import LEDGER
from tidemark.plans.q_evaluate import H, hy
from tidemark.plans.q_features import FLAG, REGIME
from tidemark.plans.q_paths import DEL, PATHS, P, each, en
from tidemark.plans.q_selection import HEADS, cells, ranked, universe
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, bars_intraday, ledger

L = f"WITH {LEDGER}"

query("a_16_range_lookup", "day:s market:s calibrated:d", f"{FLAG}, q AS (SELECT *, row_number() OVER (ORDER BY round(score, 9), day, market) AS i, count(*) OVER () AS n FROM o WHERE day < DATE '1998-01-01'), t AS (SELECT greatest(((i - 1) * 5 + n - 2) // (n - 1) - 1, 0) AS b, min(round(score, 9)) AS lo, max(round(score, 9)) AS hi, avg(hit) AS rate FROM q GROUP BY 1) SELECT day, market, coalesce((SELECT arg_min(rate, b) FROM t WHERE round(score, 9) BETWEEN lo AND hi), CASE WHEN round(score, 9) < (SELECT min(lo) FROM t) THEN (SELECT arg_min(rate, b) FROM t) END, (SELECT arg_max(rate, b) FROM t)) AS calibrated FROM o WHERE day >= DATE '1998-01-01'")(
    lambda s, d: (u := universe(s, d).withColumns({"hit": (F.col("high") / F.col("open") - 1 >= 0.05).cast("int"), "sc": F.round("score", 9)})) is not None and e.apply_ranges(u.where("day >= date'1998-01-01'"), "sc", r.global_buckets(u.where("day < date'1998-01-01'"), "score", 5, "day", "market").groupBy("bucket").agg(F.min("sc").alias("lo"), F.max("sc").alias("hi"), F.avg("hit").alias("rate")))
)
query("a_37_tie_diagnostics", "day:s n:l tied:l largest_tie:l", f"{HEADS}, z AS (SELECT day, round(p_up10, 1) AS t, count(*) AS k FROM h GROUP BY ALL) SELECT day, sum(k) AS n, sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS tied, max(k) AS largest_tie FROM z GROUP BY day")(
    lambda s, d: x.heads(universe(s, d)).groupBy("day", F.round("p_up10", 1).alias("t")).agg(F.count("*").alias("k")).groupBy("day").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("tied"), F.max("k").alias("largest_tie"))
)
query("a_47_early_hit_rates", "span:s rate:d", f"{PATHS}, z AS (SELECT entry_id, w AS span, coalesce(max(CASE WHEN idx < k THEN (high >= entry * (1 + 0.01))::INT END), 0) AS hit FROM pa, (VALUES ('15m', 1), ('30m', 2), ('60m', 4)) v(w, k) GROUP BY entry_id, w) SELECT span, avg(hit) AS rate FROM z GROUP BY span")(
    lambda s, d: each(s, d, lambda q: p.with_entry_price(q).groupBy("entry_id").agg(*[F.coalesce(F.max(F.when(F.col("idx") < k, (F.col("high") >= F.col("entry") * (1 + F.lit(0.01))).cast("int"))), F.lit(0)).alias(f"h{k}") for k in (1, 2, 4)])).selectExpr("stack(3, '15m', h1, '30m', h2, '60m', h4) as (span, hit)").groupBy("span").agg(F.avg("hit").alias("rate"))
)
query("a_50_delay_arms", "delay:l early:d late:d difference:d", f"{DEL}, g AS (SELECT k * 15 AS delay, avg(CASE WHEN entry_id < 50000 THEN eod END) AS early, avg(CASE WHEN entry_id >= 50000 THEN eod END) AS late FROM dz GROUP BY k) SELECT *, early - late AS difference FROM g")(
    lambda s, d: p.per_start(en(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select((F.col("entry_id") * 10 + F.col("k")).alias("entry_id"), "market", (F.timestamp_seconds(F.unix_seconds("start") + F.col("k") * 900)).alias("start")), bars_intraday(s, d), p.outcomes).groupBy((F.col("entry_id") % 10 * 15).alias("delay")).agg(F.avg(F.when(F.col("entry_id") < 50000, F.col("eod"))).alias("early"), F.avg(F.when(F.col("entry_id") >= 50000, F.col("eod"))).alias("late")).withColumn("difference", F.col("early") - F.col("late"))
)
query("a_56_one_schema", "source:s n:l mean:d", f"{L} SELECT 'paper' AS source, count(*) AS n, avg(net_pct) AS mean FROM ledger WHERE status = 'closed' AND model_id = '1-URGENT' AND abs(net_pct) <= 9.5 UNION ALL SELECT 'shadow', count(*), avg(net_pct / 100) FROM ledger WHERE status = 'closed' AND model_id <> '1-URGENT' AND abs(net_pct) <= 9.5")(
    lambda s, d: ledger(s, d).where("model_id = '1-URGENT'").select(F.lit("paper").alias("source"), "day", "status", F.col("net_pct").alias("net")).unionByName(ledger(s, d).where("model_id != '1-URGENT'").select(F.lit("shadow").alias("source"), "status", (F.col("net_pct") / 100).alias("net"), F.abs("net_pct").alias("size")), allowMissingColumns=True).where("status = 'closed' and coalesce(size, abs(net)) <= 9.5").groupBy("source").agg(F.count("*").alias("n"), F.avg("net").alias("mean"))
)
query("a_58_risk_reward_panel", "tier:l n:l mean_p:d mean_rr:d", f"{HEADS} SELECT least(rk, 5) AS tier, count(*) AS n, avg(p_up10) AS mean_p, avg(rr) AS mean_rr FROM r1 GROUP BY 1")(
    lambda s, d: x.order_risk_reward(x.heads(universe(s, d))).groupBy(F.least("rk", F.lit(5)).alias("tier")).agg(F.count("*").alias("n"), F.avg("p_up10").alias("mean_p"), F.avg("rr").alias("mean_rr"))
)
query("v_06_frozen_plan", "arm:s n:l mean_ret:d", f"{HEADS}, pl AS (SELECT day, market, CASE WHEN rk <= 3 THEN 'plan' ELSE 'rest' END AS arm FROM d1) SELECT arm, count(*) AS n, avg(close / open - 1) AS mean_ret FROM pl JOIN bars b ON b.day = pl.day AND b.market = pl.market GROUP BY arm")(
    lambda s, d: ranked(s, d).select("day", "market", F.when(F.col("rk") <= 3, "plan").otherwise("rest").alias("arm")).join(bars_1d(s, d).select("day", "market", (F.col("close") / F.col("open") - 1).alias("ret")), ["day", "market"]).groupBy("arm").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"))
)
query("v_21_fixed_rule_replay", "day:s picks:l ret:d", f"{HEADS}, ce AS (SELECT *, least(greatest(ceil(round(((rank() OVER (PARTITION BY day ORDER BY uq) + (count(*) OVER (PARTITION BY day, uq) - 1) / 2.0) / count(*) OVER (PARTITION BY day)) * 4, 9)) - 1, 0), 3)::BIGINT AS lq4 FROM d1), q AS (SELECT day, lq4, count(*) AS quota FROM ce WHERE rk <= 3 GROUP BY ALL), z AS (SELECT ce.*, quota, row_number() OVER (PARTITION BY ce.day, ce.lq4 ORDER BY p_dn5, market) AS i FROM ce JOIN q USING (day, lq4)) SELECT day, count(*) AS picks, avg(close / open - 1) AS ret FROM z WHERE i <= quota GROUP BY day")(
    lambda s, d: cells(s, d).withColumn("quota", F.sum((F.col("rk") <= 3).cast("int")).over(w := Window.partitionBy("day", "lq4"))).withColumn("i", F.row_number().over(w.orderBy("p_dn5", "market"))).where("i <= quota").groupBy("day").agg(F.count("*").alias("picks"), F.avg(F.col("close") / F.col("open") - 1).alias("ret"))
)
query("x_19_first_hours", "entry_id:l ret_1h:d max_4h:d", f"{PATHS} SELECT entry_id, arg_max(CASE WHEN idx < 4 THEN close END, CASE WHEN idx < 4 THEN idx END) / any_value(entry) - 1 AS ret_1h, max(CASE WHEN idx < 16 THEN high END) / any_value(entry) - 1 AS max_4h FROM pa GROUP BY entry_id")(
    lambda s, d: each(s, d, lambda q: p.with_entry_price(q).groupBy("entry_id").agg((F.max_by("close", F.when(F.col("idx") < 4, F.col("idx"))) / F.first("entry") - 1).alias("ret_1h"), (F.max(F.when(F.col("idx") < 16, F.col("high"))) / F.first("entry") - 1).alias("max_4h")))
)
query("x_20_execution_time", "entry_id:l source:s start:s", f"{P} SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN 'delivered' WHEN entry_id % 3 = 1 THEN 'created' ELSE 'scheduled' END AS source, strftime(to_timestamp(((epoch_us(seen) // 1000000 + CASE WHEN entry_id % 3 = 0 THEN 60 WHEN entry_id % 3 = 1 THEN 0 ELSE -30 END) // 900) * 900 + 900)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS start FROM en")(
    lambda s, d: en(s, d).withColumns({"delivered": F.when(F.col("entry_id") % 3 == 0, F.col("seen") + F.expr("interval 60 seconds")), "created": F.when(F.col("entry_id") % 3 == 1, F.col("seen")), "scheduled": F.col("seen") - F.expr("interval 30 seconds")}).select("entry_id", F.when(F.col("delivered").isNotNull(), "delivered").when(F.col("created").isNotNull(), "created").otherwise("scheduled").alias("source"), F.date_format(p.next_boundary(F.coalesce("delivered", "created", "scheduled")), "yyyy-MM-dd HH:mm:ss").alias("start"))
)
