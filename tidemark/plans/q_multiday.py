"""Queries: exits over several days, champions of each date, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import champions as ch
from tidemark.operators import drift
from tidemark.operators import multiday as md
from tidemark.plans.duck import LEDGER
from tidemark.plans.q_evaluate import H, hy
from tidemark.plans.q_features import W
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, ledger

DAYS = 3
ARMS = [
    md.Arm("hold", "hold"), md.Arm("bracket", "bracket", target=0.06, stop=0.06), md.Arm("bracket_level", "bracket", target=0.06, stop=0.06, gaps=False),
    md.Arm("trail", "trail", trail=0.05), md.Arm("trail_level", "trail", trail=0.05, gaps=False),
]


def arm_sql(arm: md.Arm) -> str:
    """One arm over the leads o1, h1, l1, c1 ...: the first day on which it ends, and how."""
    cases = []
    for k in range(1, DAYS + 1):
        if arm.kind == "bracket":
            level, name, at_level = f"o1 * (1 - {arm.stop}::DOUBLE)", "sl", f"-{arm.stop}::DOUBLE"
        else:
            level, name = f"greatest(o1{''.join(f', h{j}' for j in range(1, k))}) * (1 - {arm.trail}::DOUBLE)", "trail"
            at_level = f"{level} / o1 - 1"
        if arm.kind != "hold":
            if arm.gaps:
                cases.append(f"WHEN o{k} <= {level} THEN {{{{'r': '{name}_gap', 'g': o{k} / o1 - 1, 'n': {k}}}}}")
            cases.append(f"WHEN l{k} <= {level} THEN {{{{'r': '{name}', 'g': {at_level}, 'n': {k}}}}}")
            if arm.kind == "bracket":
                cases.append(f"WHEN h{k} >= o1 * (1 + {arm.target}::DOUBLE) THEN {{{{'r': 'tp', 'g': {arm.target}::DOUBLE, 'n': {k}}}}}")
    last = {"hold": "hold", "bracket": "eod", "trail": "trail_eod"}[arm.kind]
    end = f"{{{{'r': '{last}', 'g': c{DAYS} / o1 - 1, 'n': {DAYS}}}}}"
    body = f"CASE {' '.join(cases)} ELSE {end} END" if cases else end
    return f"SELECT day, market, '{arm.name}' AS arm, {body} AS x FROM z WHERE c{DAYS} IS NOT NULL AND o1 > 0".replace("{{", "{").replace("}}", "}")


LEADS = ", ".join(f"lead({c}, {k}) OVER w AS {c[0]}{k}" for k in range(1, DAYS + 1) for c in ("open", "high", "low", "close"))
MULTI = f"{W}, z AS (SELECT day, market, {LEADS} FROM bars WINDOW w AS (PARTITION BY market ORDER BY day)), x AS ({' UNION ALL '.join(map(arm_sql, ARMS))})"
query("x_07_x_08_multiday_bracket", "day:s market:s arm:s reason:s gross:d held:l", f"{MULTI} SELECT day, market, arm, x.r AS reason, x.g AS gross, x.n AS held FROM x")(
    lambda s, d: md.exits(bars_1d(s, d), DAYS, ARMS)
)
query("x_07_multiday_summary", "arm:s n:l mean_net:d win:d mean_held:d stopped:d", f"{MULTI} SELECT arm, count(*) AS n, avg(x.g - 0.0015) AS mean_net, avg((x.g > 0.0015)::INT) AS win, avg(x.n) AS mean_held, avg((x.r IN ('sl', 'sl_gap', 'trail', 'trail_gap'))::INT) AS stopped FROM x GROUP BY arm")(
    lambda s, d: md.exits(bars_1d(s, d), DAYS, ARMS).groupBy("arm").agg(
        F.count("*").alias("n"), F.avg(F.col("gross") - 0.0015).alias("mean_net"), F.avg((F.col("gross") > 0.0015).cast("int")).alias("win"), F.avg("held").alias("mean_held"),
        F.avg(F.col("reason").isin("sl", "sl_gap", "trail", "trail_gap").cast("int")).alias("stopped"),
    )
)

CHAMPION = ch.Rules(last_days=30, min_days=30, min_net=-1.0, margin_deep=5.0, margin_net=0.3, streak=5, fallback="5-LOW", barred=("4-NOT SPECIFIED",))


def paths_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, whose paths count as complete where the coin has a bar on the day."""
    seen = bars_1d(spark, sf_dir).select(F.col("market").alias("coin"), "day", F.lit(True).alias("path_complete"))
    return ledger(spark, sf_dir).join(seen, ["coin", "day"], "left")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.metrics_as_of(ch.day_sums(paths_known(spark, sf_dir), CHAMPION), CHAMPION)


METRICS = f"""WITH RECURSIVE {LEDGER}, {W[5:]}, su AS (SELECT model_id, l.day, count(*) AS n, sum(net_pct) AS net, sum((net_pct > 0)::INT) AS hits, sum((b.market IS NOT NULL)::INT) AS paths,
  sum((b.market IS NOT NULL AND net_pct <= -5)::INT) AS deep FROM ledger l LEFT JOIN bars b ON b.market = l.coin AND b.day = l.day WHERE status = 'closed' GROUP BY ALL),
 ow AS (SELECT model_id, day, sum(n) OVER w AS n, count(*) OVER w AS n_days, sum((paths > 0)::INT) OVER w AS path_days, sum(paths) OVER w AS paths, sum(deep) OVER w AS deep, sum(net) OVER w AS net, sum(hits) OVER w AS hits FROM su
  WINDOW w AS (PARTITION BY model_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
 ca AS (SELECT c.day, m.model_id FROM (SELECT DISTINCT day FROM su) c, (SELECT DISTINCT model_id FROM su) m),
 ag AS (SELECT ca.day, ca.model_id, ow.day AS last_date, ow.* EXCLUDE (model_id, day) FROM ca ASOF JOIN ow ON ow.model_id = ca.model_id AND ca.day >= ow.day),
 me AS MATERIALIZED (SELECT model_id, day, n, n_days, path_days, deep / nullif(paths, 0)::DOUBLE AS deep_freq, net, net / n AS net_mean, hits / n::DOUBLE AS hit, paths / n::DOUBLE AS complete_share, last_date,
  n_days >= 30 AND path_days >= 30 AND round(net / n, 9) > -1.0 AND model_id <> '4-NOT SPECIFIED' AS gate FROM ag)"""
query("a_22_champion_metrics", "model_id:s day:s n:l n_days:l path_days:l deep_freq:d net_sum:d hit:d complete_share:d last_date:s gate:b", f"{METRICS} SELECT *, net AS net_sum FROM me")(lambda s, d: metrics(s, d).withColumnRenamed("net", "net_sum"))
query(
    "a_23_champion", "day:s champion_id:s best_id:s streak:l reason:s",
    f"""{METRICS},
 da AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM me)),
 be AS (SELECT day, model_id, round(deep_freq, 9) AS deep_freq, net_mean, last_date, row_number() OVER (PARTITION BY day ORDER BY round(deep_freq, 9), -round(net_mean, 9), -round(hit, 9), model_id) AS i FROM me WHERE gate),
 st AS MATERIALIZED (SELECT da.day, k, b.model_id AS best, b.deep_freq AS bd, b.net_mean AS bn, b.last_date AS bl FROM da LEFT JOIN be b ON b.day = da.day AND i = 1),
 ro AS (SELECT 0::BIGINT AS k, NULL::DATE AS day, NULL::VARCHAR AS champion, NULL::VARCHAR AS best, NULL::VARCHAR AS rival, 0 AS streak, 0 AS carried, NULL::DATE AS seen, NULL::VARCHAR AS reason
  UNION ALL SELECT k, day, CASE WHEN reason = 'fallback' THEN '5-LOW' WHEN reason = 'chosen_at_once' OR reason = 'leads' AND c >= 5 THEN best ELSE champion END, best,
   CASE WHEN reason = 'leads' AND c < 5 THEN best END, CASE WHEN reason = 'leads' THEN c ELSE 0 END, CASE WHEN reason = 'leads' AND c < 5 THEN c ELSE 0 END,
   CASE WHEN reason = 'leads' AND c < 5 THEN CASE WHEN rival IS DISTINCT FROM best OR bl > seen THEN bl ELSE seen END END,
   CASE WHEN reason = 'leads' THEN CASE WHEN c >= 5 THEN 'replaced' ELSE 'kept_streak' END ELSE reason END
  FROM (SELECT st.k, st.day, ro.champion, st.best, ro.rival, ro.seen, st.bl, CASE WHEN ro.rival IS DISTINCT FROM st.best THEN 1 WHEN st.bl > ro.seen THEN ro.carried + 1 ELSE ro.carried END AS c,
   CASE WHEN st.best IS NULL THEN 'fallback' WHEN me.gate IS NULL OR NOT me.gate THEN 'chosen_at_once' WHEN st.best = ro.champion THEN 'kept_best'
    WHEN round((me.deep_freq - st.bd) * 100, 9) >= 5 OR round(st.bn - me.net_mean, 9) >= 0.3 THEN 'leads' ELSE 'kept_margin' END AS reason
   FROM ro JOIN st ON st.k = ro.k + 1 LEFT JOIN me ON me.day = st.day AND me.model_id = ro.champion))
 SELECT day, champion AS champion_id, best AS best_id, streak, reason FROM ro WHERE k > 0""",
)(lambda s, d: ch.champions(metrics(s, d), CHAMPION))

#: Distances of each day's scores from those of the week before; correlations and hit rates over days.
PVALUE = "CASE WHEN x < 0.2 THEN 1.0 WHEN x IS NOT NULL THEN least(greatest(" + " + ".join(f"exp(-2.0::DOUBLE * {k * k} * x * x) * {2 if k % 2 else -2}" for k in range(1, 41)) + ", 0), 1) END"
DRIFT = f"""{H}, s AS (SELECT day, round(p_up10, 9) AS p, y.y AS y FROM y),
 ra AS (SELECT day, y, p, rank() OVER (PARTITION BY day ORDER BY p) + (count(*) OVER (PARTITION BY day, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY day ORDER BY y) + (count(*) OVER (PARTITION BY day, y) - 1) / 2.0 AS b FROM s),
 ic0 AS (SELECT day, count(*) AS n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 9) AS ic FROM ra GROUP BY day HAVING count(*) >= 5),
 ic AS (SELECT day, ic, CASE WHEN count(*) OVER w >= 7 THEN avg(ic) OVER w END AS ic_7 FROM ic0 WHERE ic IS NOT NULL WINDOW w AS (ORDER BY day ROWS 6 PRECEDING)),
 hi AS (SELECT day, avg(y) AS hit FROM s GROUP BY day), h2 AS (SELECT day, hit, CASE WHEN count(*) OVER m >= 30 THEN avg(hit) OVER w END AS hit_7, CASE WHEN count(*) OVER m >= 30 THEN avg(hit) OVER m END AS hit_30 FROM hi WINDOW w AS (ORDER BY day ROWS 6 PRECEDING), m AS (ORDER BY day ROWS 29 PRECEDING)),
 pe AS (SELECT day, p, count(*) AS k FROM (SELECT day, p_up10 AS p FROM y) GROUP BY ALL), se AS (SELECT day + j::INT AS day, p, sum(CASE WHEN j = 0 THEN k ELSE 0 END) AS nw, sum(CASE WHEN j > 0 THEN k ELSE 0 END) AS od FROM pe, range(8) t(j) GROUP BY ALL),
 sg AS (SELECT day, nw, od, abs(sum(nw) OVER w / nullif(sum(nw) OVER a, 0)::DOUBLE - sum(od) OVER w / nullif(sum(od) OVER a, 0)::DOUBLE) AS gap FROM se WHERE day IN (SELECT day FROM pe) WINDOW w AS (PARTITION BY day ORDER BY p ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY day)),
 k0 AS (SELECT day, max(gap) AS ks, sum(nw) AS n_new, sum(od) AS n_old FROM sg GROUP BY day), k1 AS (SELECT *, ks * sqrt(n_new * n_old / nullif(n_new + n_old, 0)::DOUBLE) AS x FROM k0), ks AS (SELECT day, ks, n_new, n_old, {PVALUE} AS ks_p FROM k1),
 al AS (SELECT h2.day, hit_7, hit_30, ic, ic_7, ks, n_new, n_old, ks_p, coalesce(ic * ic_7 < 0, FALSE) AS sign_flip, coalesce(ic_7 > 0 AND ic < ic_7 * 0.5, FALSE) AS half_drop, coalesce(hit_7 < hit_30 - 0.15, FALSE) AS hit_drop,
  coalesce(n_new >= 10 AND n_old >= 50 AND ks_p < 0.01, FALSE) AS dist_shift FROM h2 LEFT JOIN ic ON ic.day = h2.day LEFT JOIN ks ON ks.day = h2.day)"""
query(
    "a_41_ks_drift", "day:s ic:d ic_7:d hit_7:d hit_30:d ks:d ks_p:d n_new:l n_old:l sign_flip:b half_drop:b hit_drop:b dist_shift:b state:s",
    f"{DRIFT} SELECT *, CASE WHEN sign_flip OR half_drop THEN 'FREEZE' WHEN hit_drop OR dist_shift THEN 'WARN' ELSE 'OK' END AS state FROM al",
)(lambda s, d: drift.triggers(hy(s, d), "p_up10", "y"))
