"""Queries: features known before the day begins, ranges of four-hour bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import lagged as lg
from tidemark.operators import ranks as r
from tidemark.plans.duck import TRADES, intraday
from tidemark.plans.duck import lag as back
from tidemark.plans.duck import pct_rank as pr
from tidemark.plans.q_features import BREADTH, W
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, bars_intraday, trades

EPS = "1e-12"


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_1d(spark, sf_dir)
    days = r.breadth(bars).select("day", "breadth", "pumps", (F.col("advancers") / F.col("active")).alias("adv_ratio"), "med_ret", "turnover")
    w = Window.orderBy("day")
    bench = bars.where("market = 'M00'").select("day", *[(F.col("close") / F.lag("close", n).over(w) - 1).alias(f"bench_{n}") for n in (1, 3, 7)])
    return lg.market_trends(days, bench)


def past(agg: str, c: str, n: int) -> str:
    w = f"(ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) OVER {w} >= {n} THEN {agg}({c}) OVER {w} END"


NAMES = ["breadth", "pumps", "adv_ratio", "med_ret", "turnover", "bench_1", "bench_3", "bench_7"]
TREND = {f"{c}_lag1": f"lag({c}) OVER (ORDER BY day)" for c in NAMES} | {f"{c}_ma{n}": past("avg", c, n) for c in ("breadth", "pumps", "adv_ratio") for n in (3, 7, 14)} | {
    "turnover_7_30": f"({past('avg', 'turnover', 7)}) / (({past('avg', 'turnover', 30)}) + {EPS})",
    "turnover_z30": f"(lag(turnover) OVER (ORDER BY day) - ({past('avg', 'turnover', 30)})) / (({past('stddev_samp', 'turnover', 30)}) + {EPS})",
    "breadth_3_14": f"({past('avg', 'breadth', 3)}) - ({past('avg', 'breadth', 14)})", "decoupling": "lag(adv_ratio) OVER (ORDER BY day) - abs(lag(bench_1) OVER (ORDER BY day)) * 5.0",
}
query(
    "f_20_breadth_trend", "day:s " + " ".join(f"{n}:d" for n in TREND),
    f"""{W}, {BREADTH}, b AS (SELECT day, {", ".join(f"close / lag(close, {n}) OVER (ORDER BY day) - 1 AS bench_{n}" for n in (1, 3, 7))} FROM bars WHERE market = 'M00'),
 z AS (SELECT br.day, breadth, pumps, advancers / active::DOUBLE AS adv_ratio, med_ret, turnover, bench_1, bench_3, bench_7 FROM br LEFT JOIN b ON b.day = br.day) SELECT day, {", ".join(f"{v} AS {n}" for n, v in TREND.items())} FROM z""",
)(trends)

SPANS = (3, 7, 14)


def span(a: int, b: int) -> str:
    w = f"(PARTITION BY market ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"
    return f"(max(high) OVER {w} - min(low) OVER {w}) / close"


VALUES = {f"rc4h_{d}d": f"CASE WHEN k >= {12 * d} THEN ({span(12 * d - 1, 6 * d)}) / (({span(6 * d - 1, 0)}) + {EPS}) END" for d in SPANS} | {"rc4h_atr_pct": "CASE WHEN k >= 84 THEN avg(high - low) OVER (PARTITION BY market ORDER BY ts ROWS BETWEEN 41 PRECEDING AND CURRENT ROW) / close END"}
query(
    "f_26_contraction_4h", "session:s market:s " + " ".join(f"{n}:d" for n in VALUES),
    f"""WITH {TRADES}, {intraday(240)}, b AS (SELECT *, (ts - INTERVAL 9 HOUR)::DATE AS session, row_number() OVER (PARTITION BY market ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY market) AS n FROM ibars),
 v AS (SELECT market, session, ts, {", ".join(f"{v} AS {n}" for n, v in VALUES.items())} FROM b WHERE n >= 60),
 g AS (SELECT session, market, {", ".join(f"arg_max({n}, ts) FILTER ({n} IS NOT NULL) AS {n}" for n in VALUES)} FROM v GROUP BY ALL) SELECT * FROM g WHERE {" OR ".join(f"{n} IS NOT NULL" for n in VALUES)}""",
)(lambda s, d: lg.contractions(bars_intraday(s, d, 240), SPANS))

#: Days of the intraday markets, a month, are met with the last month of the daily ones.
SHIFT = 9497
CONTEXT = ["roc_7d", "roc_3d", "log_ret_1d", "atr_pct_14", "ret_5d", "d1_close", "d1_qv", "roc7_rank", "roc3_rank", "atr_rank"]
ATR = "(PARTITION BY market ORDER BY day ROWS 13 PRECEDING)"
query(
    "f_29_daily_context", "event_id:l " + " ".join(f"{n}:d" for n in CONTEXT) + " liq_rank:l",
    f"""WITH {TRADES}, {W[5:]}, a AS (SELECT *, (high - low) / (close + {EPS}) AS rg FROM bars),
 c AS (SELECT day, market, close / {back("close", 7)} - 1 AS roc_7d, close / {back("close", 3)} - 1 AS roc_3d, ln(close / {back("close")} + {EPS}) AS log_ret_1d, CASE WHEN count(rg) OVER {ATR} >= 5 THEN avg(rg) OVER {ATR} END AS atr_pct_14,
  close / {back("close", 5)} - 1 AS ret_5d, close AS d1_close, quote_volume AS d1_qv FROM a),
 k AS (SELECT market, day, {", ".join(f"{back(n)} AS {n}" for n in CONTEXT[:7])} FROM c),
 q AS (SELECT *, {pr("roc_7d")} AS roc7_rank, {pr("roc_3d")} AS roc3_rank, {pr("atr_pct_14")} AS atr_rank, dense_rank() OVER (PARTITION BY day ORDER BY d1_qv DESC NULLS LAST) AS liq_rank FROM k)
 SELECT event_id, {", ".join(f"q.{n}" for n in CONTEXT)}, liq_rank FROM trades t JOIN q ON q.market = 'M0' || substr(t.market, 2) AND q.day = t.ts::DATE - {SHIFT}""",
)(lambda s, d: trades(s, d).select("event_id", F.concat(F.lit("M0"), F.substring("market", 2, 1)).alias("market"), F.date_sub(F.to_date("ts"), SHIFT).alias("day")).join(lg.day_context(bars_1d(s, d)), ["market", "day"]))


def root(c: str, n: int) -> str:
    w = f"(PARTITION BY market ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) OVER {w} >= {n} THEN sqrt(avg({c}) OVER {w}) END"


query(
    "f_32_semivolatility", "day:s market:s source_day:s downside_semivol_7:d downside_semivol_21:d upside_semivol_21:d semivol_asym_21:d known:b",
    f"""{W}, r AS (SELECT day, market, close / {back("close")} - 1 AS r FROM bars), s AS (SELECT *, CASE WHEN r IS NOT NULL THEN pow(least(r, 0), 2) END AS dn, CASE WHEN r IS NOT NULL THEN pow(greatest(r, 0), 2) END AS up FROM r)
 SELECT day, market, {back("day")} AS source_day, {root("dn", 7)} AS downside_semivol_7, {root("dn", 21)} AS downside_semivol_21, {root("up", 21)} AS upside_semivol_21, ({root("up", 21)}) - ({root("dn", 21)}) AS semivol_asym_21, coalesce({back("day")} < day, FALSE) AS known FROM s""",
)(lambda s, d: lg.semivolatilities(bars_1d(s, d)))
