"""Queries: risk-adjusted figures, extreme trades, contributions, sweeps, monthly results of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import returns as rt
from tidemark.plans.duck import LEDGER
from tidemark.plans.q_evaluate import H, hy
from tidemark.plans.q_portfolio import RET, ret
from tidemark.plans.registry import query
from tidemark.sources.adapters import ledger

query(
    "m_06_risk_adjusted", "series:s days:l cumulative:d annualized:d max_drawdown:d calmar:d profit_factor:d win_loss:d tail_ratio:d common_sense:d",
    f"""{RET}, e AS (SELECT series, count(*) AS days, arg_max(equity, day) - 1 AS cumulative, min(drawdown) AS max_drawdown FROM eq GROUP BY series),
 t AS (SELECT model_id AS series, coalesce(sum(net_pct) FILTER (net_pct > 0), 0) / nullif(abs(sum(net_pct) FILTER (net_pct < 0)), 0) AS profit_factor, abs(avg(net_pct) FILTER (net_pct > 0) / nullif(avg(net_pct) FILTER (net_pct < 0), 0)) AS win_loss,
  abs(quantile_cont(net_pct, 0.95) / nullif(quantile_cont(net_pct, 0.05), 0)) AS tail_ratio FROM ledger WHERE status = 'closed' GROUP BY model_id),
 a AS (SELECT *, CASE WHEN 1 + cumulative > 0 THEN pow(1 + cumulative, 365.0 / days) - 1 END AS annualized FROM e)
 SELECT a.*, CASE WHEN max_drawdown < 0 THEN annualized / abs(max_drawdown) END AS calmar, profit_factor, win_loss, tail_ratio, profit_factor * tail_ratio AS common_sense FROM a LEFT JOIN t USING (series)""",
)(lambda s, d: rt.risk_adjusted(ret(s, d), ledger(s, d).where("status = 'closed'").select(F.col("model_id").alias("series"), F.col("net_pct").alias("net"))))
query(
    "m_11_extreme_trades", "model_id:s side:s place:l trade_id:l day:s net_pct:d",
    f"""WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY net_pct DESC, trade_id) AS b, row_number() OVER (PARTITION BY model_id ORDER BY net_pct, trade_id) AS w FROM ledger WHERE status = 'closed')
 SELECT model_id, 'best' AS side, b AS place, trade_id, day, net_pct FROM r WHERE b <= 3 UNION ALL SELECT model_id, 'worst', w, trade_id, day, net_pct FROM r WHERE w <= 3""",
)(lambda s, d: rt.extreme_trades(ledger(s, d)))


def coin_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three by the score against the best three by risk and reward."""
    rows = hy(spark, sf_dir).withColumn("sr", F.expr("row_number() over (partition by day order by round(score, 9) desc, market)"))
    arms = F.array_compact(F.array(F.when(F.col("rk") <= 3, F.lit(1)), F.when(F.col("sr") <= 3, F.lit(-1))))
    picks = rows.select("day", F.col("market").alias("coin"), F.col("ret").alias("value"), F.explode(arms).alias("arm"))
    return rt.contributions(picks, rows.select("day").distinct())


query(
    "a_35_contributions", "coin:s contribution:d share:d place:l",
    f"""{H}, r AS (SELECT day, market AS coin, ret, rk, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, market) AS sr FROM y),
 p AS (SELECT day, coin, ret, 1 AS arm FROM r WHERE rk <= 3 UNION ALL SELECT day, coin, ret, -1 FROM r WHERE sr <= 3), k AS (SELECT *, count(*) OVER (PARTITION BY day, arm) AS k FROM p),
 c AS (SELECT coin, sum(arm * ret / k) / (SELECT count(DISTINCT day) FROM y) AS contribution FROM k GROUP BY coin)
 SELECT coin, contribution, contribution / nullif(sum(contribution) OVER (), 0) AS share, row_number() OVER (ORDER BY round(abs(contribution), 9) DESC, coin) AS place FROM c""",
)(coin_contributions)
TARGETS, COSTS = [0.03, 0.05, 0.08, 0.1], [0.0, 0.0015, 0.005]
query(
    "x_17_target_sweep", "target:d cost:d n:l mean_net:d win:d cumulative:d",
    f"""{H}, z AS (SELECT day, target, cost, CASE WHEN high / open - 1 >= target THEN target ELSE ret END - cost AS net FROM y, (VALUES {", ".join(f"({t}::DOUBLE)" for t in TARGETS)}) a(target), (VALUES {", ".join(f"({c}::DOUBLE)" for c in COSTS)}) b(cost) WHERE rk <= 3),
 p AS (SELECT target, cost, day, count(*) AS n, sum(net) AS s, sum((net > 0)::INT) AS w FROM z GROUP BY ALL) SELECT target, cost, sum(n) AS n, sum(s) / sum(n) AS mean_net, sum(w) / sum(n)::DOUBLE AS win, exp(sum(ln(1 + s / n))) - 1 AS cumulative FROM p GROUP BY ALL""",
)(lambda s, d: rt.target_cost_sweep(hy(s, d).where("rk <= 3").select("day", (F.col("high") / F.col("open") - 1).alias("best"), F.col("ret").alias("close")), TARGETS, COSTS))
RULES = {"tight": (0.03, 0.05), "wide": (0.06, 0.1)}


def monthly_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-equal results of two brackets on the daily picks, compounded by month, with the number of days that won."""
    specs = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(a).alias("sl"), F.lit(b).alias("tp")) for n, (a, b) in RULES.items()])
    each = hy(spark, sf_dir).where("rk <= 3").withColumn("v", F.explode(specs)).withColumn("g", F.expr("case when low / open - 1 <= -v.sl then -v.sl when high / open - 1 >= v.tp then v.tp else close / open - 1 end") - 0.0015)
    days = each.groupBy("v.rule", "day").agg(F.avg("g").alias("r"))
    return days.groupBy("rule", F.trunc("day", "month").alias("month")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("month_ret"), F.count("*").alias("days"), F.sum((F.col("r") > 0).cast("int")).alias("won"), F.min("r").alias("worst_day"))


query(
    "x_29_monthly_rules", "rule:s month:s month_ret:d days:l won:l worst_day:d",
    f"""{H}, g AS (SELECT rule, day, avg(CASE WHEN low / open - 1 <= -sl THEN -sl WHEN high / open - 1 >= tp THEN tp ELSE close / open - 1 END - 0.0015) AS r FROM y, (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, (a, b) in RULES.items())}) v(rule, sl, tp) WHERE rk <= 3 GROUP BY ALL)
 SELECT rule, date_trunc('month', day)::DATE AS month, exp(sum(ln(1 + r))) - 1 AS month_ret, count(*) AS days, sum((r > 0)::INT) AS won, min(r) AS worst_day FROM g GROUP BY ALL""",
)(monthly_rules)
