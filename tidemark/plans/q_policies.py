"""Queries: policy competition, group summaries, day gates, precision by regime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import features as f
from tidemark.operators import policies as po
from tidemark.plans.duck import LEDGER
from tidemark.plans.q_audits import with_regime
from tidemark.plans.q_evaluate import H, hy
from tidemark.plans.q_features import REGIME, W
from tidemark.plans.q_resampling import drawn
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, ledger

query(
    "a_06_precision_by_regime", "btc_regime:s days:l n:l precision:d recall:d",
    f"""{H}, {REGIME}, z AS (SELECT y.*, coalesce(btc_regime, 'none') AS rg FROM y LEFT JOIN regime ON regime.day = y.day)
 SELECT rg AS btc_regime, count(DISTINCT day) AS days, sum((rk <= 3)::INT) AS n, avg(CASE WHEN rk <= 3 THEN z.y END) AS precision, sum(CASE WHEN rk <= 3 THEN z.y ELSE 0 END) / nullif(sum(z.y), 0)::DOUBLE AS recall FROM z GROUP BY rg""",
)(lambda s, d: with_regime(s, d, hy(s, d)).groupBy(F.col("regime").alias("btc_regime")).agg(
    F.countDistinct("day").alias("days"), F.sum((F.col("rk") <= 3).cast("int")).alias("n"), F.avg(F.when(F.col("rk") <= 3, F.col("y"))).alias("precision"), F.try_divide(F.sum(F.when(F.col("rk") <= 3, F.col("y")).otherwise(0)), F.sum("y")).alias("recall"),
))

#: name: (Spark predicate, SQL predicate); the strict one leaves many days without a pick.
POLICIES = {"all_5": "rk <= 5", "best": "rk <= 1", "two": "rk <= 2", "three_calm": "rk <= 3 AND NOT dump", "strict": "rk <= 3 AND p_up10 >= 0.38"}
OUTCOME = "CASE WHEN low / open - 1 <= -0.03 THEN 'SL' WHEN high / open - 1 >= 0.05 THEN 'TP' ELSE 'EOD' END"
GROSS = "CASE WHEN low / open - 1 <= -0.03 THEN -3.0 WHEN high / open - 1 >= 0.05 THEN 5.0 ELSE (close / open - 1) * 100 END"


def compete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hy(spark, sf_dir).selectExpr("day", "market", "rk", "dump", "p_up10", f"{GROSS} - 0.15 as net_pct", f"{OUTCOME} as exit_reason", "int(high / open - 1 >= 0.1) as pump")
    return po.competition(rows, {n: F.expr(p) for n, p in POLICIES.items()}, deep_loss=-3.0)


query(
    "a_20_policy_metrics", "policy:s n:l n_days:l selected_days:l net_sum:d net_mean:d deep_loss:d sl_rate:d tp_rate:d precision:d recall:d captured:l actual:l pump_days:l captured_days:l capture_rate:d",
    f"""{H}, o AS (SELECT *, {GROSS} - 0.15 AS net, {OUTCOME} AS reason, (high / open - 1 >= 0.1)::INT AS pump FROM y),
 pd AS (SELECT day, sum(pump) AS pumps FROM o GROUP BY day), wh AS (SELECT count(*) AS n_days, sum(pumps) AS actual, sum((pumps > 0)::INT) AS pump_days FROM pd),
 ta AS ({" UNION ALL ".join(f"SELECT '{n}' AS policy, * FROM o WHERE {p}" for n, p in POLICIES.items())}),
 de AS (SELECT policy, count(DISTINCT day) AS selected_days, count(DISTINCT CASE WHEN pump = 1 THEN day END) AS captured_days, count(*) AS n, sum(net) AS net_sum, avg(net) AS net_mean, avg((net <= -3)::INT) AS deep_loss, avg((reason = 'SL')::INT) AS sl_rate,
  avg((reason = 'TP')::INT) AS tp_rate, avg(pump) AS precision, sum(pump) AS captured FROM ta GROUP BY policy)
 SELECT de.*, n_days, captured / nullif(actual, 0)::DOUBLE AS recall, actual, pump_days, captured_days / nullif(pump_days, 0)::DOUBLE AS capture_rate FROM de, wh""",
)(compete)

REPS = 50
DIMENSIONS = {"model": "model_id", "coin": "coin", "pair": "model_id || '/' || substr(coin, 1, 2)", "quarter": "CAST(quarter(day) AS STRING)"}
GROUPS = f"""WITH {LEDGER}, ea AS ({" UNION ALL ".join(f"SELECT '{n}' AS dimension, {c.replace('STRING', 'VARCHAR')} AS value, day, CASE WHEN status = 'closed' THEN net_pct END AS x FROM ledger" for n, c in DIMENSIONS.items())}),
 co AS (SELECT dimension, value, count(*) AS candidates, count(x) AS closed, avg((x > 0)::INT) AS win_rate, sum(x) AS net_sum, avg(x) AS net_mean, quantile_cont(x, 0.5) AS net_median, min(x) AS worst FROM ea GROUP BY ALL),
 dy AS (SELECT dimension, value, day, avg(x) / 100 AS r FROM ea WHERE x IS NOT NULL GROUP BY ALL),
 ca AS (SELECT dimension, value, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM dy GROUP BY dimension, value), cu AS (SELECT ca.*, coalesce(r, 0) AS r FROM ca LEFT JOIN dy USING (dimension, value, day)),
 e0 AS (SELECT *, exp(sum(ln(1 + r)) OVER w) AS e FROM cu WINDOW w AS (PARTITION BY dimension, value ORDER BY day)), e1 AS (SELECT *, e / greatest(max(e) OVER w, 1) - 1 AS dd FROM e0 WINDOW w AS (PARTITION BY dimension, value ORDER BY day)),
 ri AS (SELECT dimension, value, coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) * sqrt(365) AS sharpe, min(dd) AS max_drawdown, arg_max(e, day) - 1 AS cumulative, count(*) AS calendar_days FROM e1 GROUP BY ALL),
 ix AS (SELECT *, row_number() OVER (PARTITION BY dimension, value ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY dimension, value) AS n FROM dy), {drawn("ix", "'42'", by="dimension, value", reps=REPS)},
 re AS (SELECT dimension, value, rep, avg(r) AS m FROM dr JOIN ix USING (dimension, value, i) GROUP BY ALL), ci AS (SELECT dimension, value, quantile_cont(m, 0.025) AS mean_low, quantile_cont(m, 0.975) AS mean_high FROM re GROUP BY ALL)"""
query(
    "a_27_group_summary", "dimension:s value:s candidates:l closed:l win_rate:d net_sum:d net_mean:d net_median:d worst:d sharpe:d max_drawdown:d cumulative:d calendar_days:l mean_low:d mean_high:d tier:s",
    f"""{GROUPS} SELECT co.*, sharpe, max_drawdown, cumulative, calendar_days, mean_low, mean_high, CASE WHEN closed = 0 THEN 'DIAGNOSTIC_ONLY' WHEN closed < 20 THEN 'COLLECT' WHEN net_mean > 0 AND (max_drawdown IS NULL OR max_drawdown > -0.25) THEN 'PROMOTE_CANDIDATE'
 WHEN net_mean < 0 THEN 'DEMOTE_CANDIDATE' ELSE 'WATCH' END AS tier FROM co LEFT JOIN ri USING (dimension, value) LEFT JOIN ci USING (dimension, value)""",
)(lambda s, d: po.group_summary(ledger(s, d), {n: F.expr(c) for n, c in DIMENSIONS.items()}, REPS))

#: Gates of one and two features of the day before.
GATES = (
    {f"pumps_l1>={k}": f"pumps_l1 >= {k}" for k in range(5)} | {f"pumps_3d>={k}": f"pumps_3d >= {k}" for k in (0.5, 1.0, 1.5, 2.0)} | {f"breadth_l1>={k}": f"breadth_l1 >= {k}" for k in (0.3, 0.4, 0.5, 0.6)}
    | {f"pumps_l1>={a} & breadth_l1>={b}": f"pumps_l1 >= {a} AND breadth_l1 >= {b}" for a in (1, 2, 3) for b in (0.4, 0.5)} | {"never": "pumps_l1 < 0"}
)


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars_1d(spark, sf_dir).withColumns({"p": (F.col("high") / F.col("open") - 1 >= 0.1).cast("int"), "u": (f.ret() > 0).cast("int")})
    days = rows.groupBy("day").agg(F.sum("p").alias("pumps"), F.avg("u").alias("breadth"))
    w = Window.orderBy("day")
    three = w.rowsBetween(-3, -1)
    days = days.withColumns({"pumps_l1": F.lag("pumps").over(w), "pumps_3d": F.when(F.count("pumps").over(three) == 3, F.avg("pumps").over(three)), "breadth_l1": F.lag("breadth").over(w)})
    return po.gate_sweep(days, {n: F.expr(g) for n, g in GATES.items()}, "pumps", 3)


query(
    "a_32_gate_sweep", "rule:s n:l base:d on_rate:d precision:d recall:d lift:d dead_off:d",
    f"""{W}, z AS (SELECT day, (high / open - 1 >= 0.1)::INT AS p, (close / lag(close) OVER (PARTITION BY market ORDER BY day) - 1 > 0)::INT AS u FROM bars), g0 AS (SELECT day, sum(p) AS pumps, avg(u) AS breadth FROM z GROUP BY day),
 g1 AS (SELECT *, lag(pumps) OVER w AS pumps_l1, CASE WHEN count(pumps) OVER t = 3 THEN avg(pumps) OVER t END AS pumps_3d, lag(breadth) OVER w AS breadth_l1 FROM g0 WINDOW w AS (ORDER BY day), t AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
 ru AS ({" UNION ALL ".join(f"SELECT '{n}' AS rule, pumps, (pumps >= 3)::INT AS rich, ({g})::INT AS o FROM g1" for n, g in GATES.items())}),
 m AS (SELECT rule, count(*) AS n, avg(rich) AS base, avg(o) AS on_rate, avg(CASE WHEN o = 1 THEN rich END) AS precision, sum(rich * o) / nullif(sum(rich), 0)::DOUBLE AS recall, avg(CASE WHEN o = 0 THEN (pumps = 0)::INT END) AS dead_off FROM ru WHERE o IS NOT NULL GROUP BY rule)
 SELECT rule, n, base, on_rate, precision, CASE WHEN on_rate > 0 THEN recall END AS recall, CASE WHEN on_rate > 0 THEN precision / nullif(base, 0) END AS lift, CASE WHEN on_rate > 0 THEN dead_off END AS dead_off FROM m""",
)(gates)
