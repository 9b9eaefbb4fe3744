"""Queries: completeness of paths, closing of ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import closing as c
from tidemark.operators import paths as p
from tidemark.operators import quality as q
from tidemark.plans.duck import TRADES, intraday
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_intraday, index_intraday, trades

HOUR, STEPS = 3600, 24
NEXT_HOUR = f"to_timestamp((epoch_us(ts) // 1000000) // {HOUR} * {HOUR} + {HOUR})::TIMESTAMP"
#: Starts (market, start) with their quality. All bars made from trades are sound and on the grid, so those faults are left to tests.
QUALITY = f"""{TRADES}, {intraday(60)},
 ix AS (SELECT DISTINCT ts FROM ibars),
 en AS (SELECT event_id AS entry_id, market, ts AS seen, {NEXT_HOUR} AS start FROM trades),
 st AS (SELECT DISTINCT market, start FROM en),
 own AS (SELECT st.market, start, count(b.ts) AS raw, coalesce(max((b.ts = start)::INT), 0) AS at_start
  FROM st LEFT JOIN ibars b ON b.market = st.market AND b.ts >= start AND b.ts < start + INTERVAL 24 HOUR GROUP BY ALL),
 be AS (SELECT start, count(ix.ts) AS b_raw FROM (SELECT DISTINCT start FROM st) s LEFT JOIN ix ON ix.ts >= start AND ix.ts < start + INTERVAL 24 HOUR GROUP BY start),
 re AS (SELECT min(ts) AS a, max(ts) AS z FROM ix),
 fi AS (SELECT market, min(ts) AS f FROM ibars GROUP BY market),
 qu AS (SELECT market, start, raw, b_raw, CASE WHEN a > start THEN 'db_horizon_start_incomplete' WHEN z < start + INTERVAL 24 HOUR THEN 'db_horizon_end_incomplete'
  WHEN b_raw <> {STEPS} THEN 'benchmark_gap' WHEN raw = 0 THEN 'target_no_observations' WHEN at_start = 0 AND f >= start THEN 'market_start_horizon_incomplete'
  WHEN raw = {STEPS} THEN 'complete' ELSE 'flat_filled' END AS quality FROM own JOIN be USING (start) JOIN fi USING (market), re)"""


def hourly_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, market, seen, start): every trade as a decision, executed at the next hour."""
    return trades(spark, sf_dir).select(F.col("event_id").alias("entry_id"), "market", F.col("ts").alias("seen"), p.next_boundary(F.col("ts"), HOUR).alias("start"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.completeness(hourly_entries(spark, sf_dir), bars_intraday(spark, sf_dir, 60), index_intraday(spark, sf_dir, 60), STEPS, HOUR)


query(
    "x_18_completeness", "entry_id:l quality:s path_complete:b raw_bars:l benchmark_bars:l filled:l",
    f"""WITH {QUALITY} SELECT entry_id, quality, quality IN ('complete', 'flat_filled') AS path_complete, raw AS raw_bars, b_raw AS benchmark_bars,
 CASE WHEN quality IN ('complete', 'flat_filled') THEN {STEPS} - raw END AS filled FROM en JOIN qu USING (market, start)""",
)(completeness)


def open_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of open rows, one a trade: bids were delivered when they were received, asks have their decision's end alone."""
    t = trades(spark, sf_dir)
    bid = F.col("side") == "BID"
    return t.select(
        F.col("event_id").alias("trade_id"), F.to_date("ts").alias("day"), "market", F.lit("open").alias("status"), F.lit(0.01).alias("sl_pct"), F.lit(0.02).alias("tp_pct"), F.when(bid, True).alias("delivery_ok"),
        F.when(bid, F.timestamp_micros(F.floor(F.col("received_ns") / 1000).cast("long"))).alias("sent_at"), F.col("ts").cast("timestamp").alias("decision_completed_at"),
    )


CLOSED_ON = "2024-01-29"


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.close_rows(open_ledger(spark, sf_dir), bars_intraday(spark, sf_dir, 60), index_intraday(spark, sf_dir, 60), CLOSED_ON, steps=STEPS, seconds=HOUR, open_hour=0)


SENT = "CASE WHEN side = 'BID' THEN to_timestamp(received_ns / 1000000000.0)::TIMESTAMP END"
#: Closed rows; a delivery is received with its trade or later, so no delivery is muddled.
CLOSED = f"""{QUALITY},
 le AS (SELECT event_id AS trade_id, ts::DATE AS day, market, side, to_timestamp((greatest(epoch_us(ts), CASE WHEN side = 'BID' THEN received_ns // 1000 ELSE 0 END) // 1000000) // {HOUR} * {HOUR} + {HOUR})::TIMESTAMP AS start FROM trades),
 s2 AS (SELECT DISTINCT market, start FROM le WHERE day < DATE '{CLOSED_ON}'),
 o2 AS (SELECT s2.market, start, count(b.ts) AS raw, coalesce(max((b.ts = start)::INT), 0) AS at_start FROM s2 LEFT JOIN ibars b ON b.market = s2.market AND b.ts >= start AND b.ts < start + INTERVAL 24 HOUR GROUP BY ALL),
 b2 AS (SELECT start, count(ix.ts) AS b_raw FROM (SELECT DISTINCT start FROM s2) s LEFT JOIN ix ON ix.ts >= start AND ix.ts < start + INTERVAL 24 HOUR GROUP BY start),
 q2 AS (SELECT market, start, CASE WHEN a > start THEN 'db_horizon_start_incomplete' WHEN z < start + INTERVAL 24 HOUR THEN 'db_horizon_end_incomplete'
  WHEN b_raw <> {STEPS} THEN 'benchmark_gap' WHEN raw = 0 THEN 'target_no_observations' WHEN at_start = 0 AND f >= start THEN 'market_start_horizon_incomplete'
  WHEN raw = {STEPS} THEN 'complete' ELSE 'flat_filled' END AS quality FROM o2 JOIN b2 USING (start) JOIN fi USING (market), re),
 g0 AS (SELECT market, start, i AS idx, start + to_hours(i::INTEGER) AS ts FROM q2, range({STEPS}) t(i) WHERE quality IN ('complete', 'flat_filled')),
 g1 AS (SELECT g0.*, b.open, b.high, b.low, b.close, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g0.market, start ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM g0 LEFT JOIN ibars b ON b.market = g0.market AND b.ts = g0.ts),
 pr AS (SELECT s2.market, start, arg_max(b.close, b.ts) AS prior FROM s2 JOIN ibars b ON b.market = s2.market AND b.ts < start GROUP BY ALL),
 g2 AS (SELECT g1.market, g1.start, idx, coalesce(open, run, prior) AS o, coalesce(high, run, prior) AS h, coalesce(low, run, prior) AS l, coalesce(close, run, prior) AS c FROM g1 LEFT JOIN pr ON pr.market = g1.market AND pr.start = g1.start),
 g3 AS (SELECT *, first(o) OVER (PARTITION BY market, start ORDER BY idx) AS e FROM g2),
 pa AS (SELECT market, start, any_value(e) AS e, arg_max(c, idx) AS lc, max(h) AS mx, min(l) AS mn,
  {", ".join(f"min(CASE WHEN h >= e * (1 + {t}) THEN idx END) AS t{round(t * 100)}" for t in (0.02, 0.05, 0.08, 0.10))},
  {", ".join(f"min(CASE WHEN l <= e * (1 - {t}) THEN idx END) AS s{round(t * 100)}" for t in (0.01, 0.02, 0.03, 0.05))} FROM g3 GROUP BY market, start)"""


def _walk(target: str | None, stop: str | None) -> tuple[str, str]:
    """SQL of the net percent and the reason of an exit with a target and a stop in whole percent."""
    by_stop = f"s{stop} IS NOT NULL AND (t{target} IS NULL OR s{stop} <= t{target})" if stop else "FALSE"
    by_target = f"t{target} IS NOT NULL" if target else "FALSE"
    gross = f"CASE WHEN {by_stop} THEN -{stop or 0} / 100.0::DOUBLE WHEN {by_target} THEN {target or 0} / 100.0::DOUBLE ELSE lc / e - 1 END"
    return f"round(({gross} - 0.0015) * 100, 4)", f"CASE WHEN {by_stop} THEN 'SL' WHEN {by_target} THEN 'TP' ELSE 'EOD' END"


NET, REASON = _walk("2", "1")
LAB = {"tp10_nosl": ("10", None), "tp5_nosl": ("5", None), "eod": (None, None), "tp5_sl2": ("5", "2"), "tp10_sl5": ("10", "5"), "tp8_sl3": ("8", "3")}
PRICE = "CASE WHEN s1 IS NOT NULL AND (t2 IS NULL OR s1 <= t2) THEN e * (1 - 0.01::DOUBLE) WHEN t2 IS NOT NULL THEN e * (1 + 0.02::DOUBLE) ELSE lc END"
query(
    "x_22_close_batch", "trade_id:l status:s path_quality:s path_complete:b execution_entry_open:d exit_price:d exit_reason:s realized_pct:d pump_hit:l post_send_pump_hit:l entry_price_source:s",
    f"""WITH {CLOSED}, du AS (SELECT market, ts::DATE AS day, (max(high) / arg_min(open, ts) - 1 >= 0.2)::INT AS pump FROM ibars GROUP BY ALL)
 SELECT trade_id, CASE WHEN le.day >= DATE '{CLOSED_ON}' THEN 'open' WHEN e IS NOT NULL THEN 'closed' ELSE 'no_data' END AS status,
 quality AS path_quality, CASE WHEN le.day < DATE '{CLOSED_ON}' THEN e IS NOT NULL END AS path_complete, e AS execution_entry_open,
 CASE WHEN e IS NOT NULL THEN {PRICE} END AS exit_price, CASE WHEN e IS NOT NULL THEN {REASON} END AS exit_reason, CASE WHEN e IS NOT NULL THEN {NET} END AS realized_pct,
 CASE WHEN e IS NOT NULL THEN pump END AS pump_hit, CASE WHEN e IS NOT NULL THEN (mx / e - 1 >= 0.2)::INT END AS post_send_pump_hit,
 CASE WHEN e IS NOT NULL THEN CASE WHEN side = 'BID' THEN 'open_at_or_after_delivery' ELSE 'open_at_or_after_decision' END END AS entry_price_source
 FROM le LEFT JOIN q2 ON le.day < DATE '{CLOSED_ON}' AND q2.market = le.market AND q2.start = le.start LEFT JOIN pa ON le.day < DATE '{CLOSED_ON}' AND pa.market = le.market AND pa.start = le.start
 LEFT JOIN du ON du.market = le.market AND du.day = le.day""",
)(closed)
query(
    "x_02_exit_variants", "trade_id:l path_max_pct:d path_min_pct:d " + " ".join(f"exit_{n}_pct:d" + (f" exit_{n}_reason:s" if n != "eod" else "") for n in LAB),
    f"""WITH {CLOSED} SELECT trade_id, round((mx / e - 1) * 100, 4) AS path_max_pct, round((mn / e - 1) * 100, 4) AS path_min_pct,
 {", ".join(f"{_walk(*v)[0]} AS exit_{n}_pct" + (f", {_walk(*v)[1]} AS exit_{n}_reason" if n != "eod" else "") for n, v in LAB.items())}
 FROM le JOIN pa ON le.day < DATE '{CLOSED_ON}' AND pa.market = le.market AND pa.start = le.start""",
)(lambda s, d: closed(s, d).where("status = 'closed'"))
query(
    "x_26_candidate_results", "channel:s n:l hit:d mean_net:d mean_max:d mean_min:d mean_close:d replayed_same:d",
    f"""WITH {CLOSED}, z AS (SELECT CASE WHEN side = 'BID' THEN 'delivered' ELSE 'decided' END AS channel, {NET} AS net, {REASON} AS reason, {_walk("5", "2")[1]} AS other, mx, mn, e, lc
 FROM le JOIN pa ON le.day < DATE '{CLOSED_ON}' AND pa.market = le.market AND pa.start = le.start)
 SELECT channel, count(*) AS n, avg((reason = 'TP')::INT) AS hit, avg(net) AS mean_net, avg(round((mx / e - 1) * 100, 4)) AS mean_max, avg(round((mn / e - 1) * 100, 4)) AS mean_min,
 avg({_walk(None, None)[0]}) AS mean_close, avg((reason = other)::INT) AS replayed_same FROM z GROUP BY channel""",
)(lambda s, d: closed(s, d).where("status = 'closed'").groupBy(F.when(F.col("sent_at").isNotNull(), "delivered").otherwise("decided").alias("channel")).agg(
    F.count("*").alias("n"), F.avg((F.col("exit_reason") == "TP").cast("int")).alias("hit"), F.avg("realized_pct").alias("mean_net"), F.avg("path_max_pct").alias("mean_max"), F.avg("path_min_pct").alias("mean_min"),
    F.avg("exit_eod_pct").alias("mean_close"), F.avg((F.col("exit_reason") == F.col("exit_tp5_sl2_reason")).cast("int")).alias("replayed_same"),
))
