"""Queries: stream features over the recorded trades and books (batch form; tests run them as streams too)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import features as f
from tidemark.plans.duck import TRADES, intraday
from tidemark.plans.q_features import W
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, bars_intraday, trades
from tidemark.streaming import flow

T = f"WITH {TRADES}"
CUT = 1705741200000000000  # 2024-01-20 09:00 UTC in ns
BK = "bk AS (SELECT market, ts, event_ns, received_ns, price - 0.05 AS bid, price + 0.05 AS ask, (event_id % 9 + 1)::DOUBLE AS bid_size, (event_id * 7 % 9 + 1)::DOUBLE AS ask_size, event_id AS ingress_seq, event_id % 3 + 1 AS depth FROM trades)"
FMT = "'%Y-%m-%d %H:%M:%S'"


def cutoffs(s, d):
    days = trades(s, d).select(F.to_date("ts").alias("day")).distinct()
    return days.withColumn("cutoff_ns", (F.unix_seconds(F.col("day").cast("timestamp")) + 9 * 3600) * 1_000_000_000)


query("t_03_flow_imbalance", "day:s market:s n:l imbalance:d", f"{T}, c AS (SELECT DISTINCT ts::DATE AS day, (epoch(ts::DATE) + 32400)::BIGINT * 1000000000 AS cut FROM trades), g AS (SELECT c.day, market, count(*) AS n, sum(CASE WHEN side = 'BID' THEN price * volume ELSE 0 END) AS b, sum(CASE WHEN side = 'ASK' THEN price * volume ELSE 0 END) AS a FROM c, trades WHERE event_ns >= cut - 21600000000000 AND event_ns < cut AND received_ns >= cut - 21600000000000 AND received_ns < cut GROUP BY ALL) SELECT day, market, n, (b - a) / nullif(b + a, 0) AS imbalance FROM g")(
    lambda s, d: flow.flow_at_cutoffs(trades(s, d), cutoffs(s, d), 21600)
)
query("t_03_sliding_flow", "market:s start:s n:l imbalance:d", f"{T}, g AS (SELECT market, to_timestamp((epoch_us(ts) // 10800000000 - k) * 10800)::TIMESTAMP AS start, count(*) AS n, sum(CASE WHEN side = 'BID' THEN price * volume ELSE 0 END) AS b, sum(CASE WHEN side = 'ASK' THEN price * volume ELSE 0 END) AS a FROM trades, range(2) t(k) GROUP BY ALL) SELECT market, strftime(start, {FMT}) AS start, n, (b - a) / nullif(b + a, 0) AS imbalance FROM g")(
    lambda s, d: flow.sliding_flow(trades(s, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
)
query("t_04_dedup", "market:s n:l", f"{T} SELECT market, count(*) AS n FROM (SELECT DISTINCT market, event_id FROM (SELECT * FROM trades UNION ALL SELECT * FROM trades WHERE event_id % 3 = 0)) GROUP BY market")(
    lambda s, d: (t := trades(s, d)).unionByName(t.where("event_id % 3 = 0")).dropDuplicates(["market", "event_id"]).groupBy("market").agg(F.count("*").alias("n"))
)
query("t_04_conflicts", "market:s event_id:l kinds:l", f"{T}, u AS (SELECT market, event_id, price FROM trades UNION ALL SELECT market, event_id, price + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END FROM trades WHERE event_id % 3 = 0) SELECT market, event_id, count(DISTINCT price) AS kinds FROM u GROUP BY ALL HAVING count(DISTINCT price) > 1")(
    lambda s, d: flow.conflicts((t := trades(s, d)).unionByName(t.where("event_id % 3 = 0").withColumn("price", F.col("price") + F.when(F.col("event_id") % 6 == 0, 1).otherwise(0))))
)
query("t_05_lateness", "market:s before:l event_after:l received_after:l inside:l", f"{T} SELECT market, count(*) FILTER (event_ns < {CUT - 86400 * 10**9}) AS before, count(*) FILTER (event_ns >= {CUT}) AS event_after, count(*) FILTER (event_ns < {CUT} AND received_ns >= {CUT}) AS received_after, count(*) FILTER (event_ns >= {CUT - 86400 * 10**9} AND event_ns < {CUT} AND received_ns < {CUT}) AS inside FROM trades GROUP BY market")(
    lambda s, d: flow.lateness(trades(s, d), CUT, 86400)
)
query("t_06_t_08_last_book", "market:s bid:d spread:d pressure:d age_s:d", f"{T}, {BK}, l AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ingress_seq DESC) AS i FROM bk WHERE event_ns < {CUT} AND received_ns < {CUT} AND bid <= ask) SELECT market, bid, (ask - bid) / bid AS spread, (bid * bid_size - ask * ask_size) / (bid * bid_size + ask * ask_size) AS pressure, ({CUT} - event_ns) / 1e9 AS age_s FROM l WHERE i = 1")(
    lambda s, d: flow.last_books(flow.books(trades(s, d)), CUT)
)
query("t_07_book_readiness", "market:s ready:b", f"{T}, {BK} SELECT market, min(received_ns) < 1704070800000000000 AS ready FROM bk GROUP BY market")(lambda s, d: flow.ready(flow.books(trades(s, d)), trades(s, d).select("market").distinct(), 1704070800000000000))
query("t_09_watermarks", "market:s last_seq:l last_event_ns:l last_received_ns:l after_cutoff:l n:l", f"{T}, {BK} SELECT market, max(ingress_seq) AS last_seq, max(event_ns) AS last_event_ns, arg_max(received_ns, ingress_seq) AS last_received_ns, count(*) FILTER (event_ns > {CUT}) AS after_cutoff, count(*) AS n FROM bk GROUP BY market")(
    lambda s, d: flow.watermark_table(flow.books(trades(s, d)), CUT)
)
query("t_09_depth_histogram", "depth:l n:l", f"{T}, {BK} SELECT depth, count(*) AS n FROM bk GROUP BY depth")(lambda s, d: flow.books(trades(s, d)).groupBy("depth").agg(F.count("*").alias("n")))
query("t_10_sequence_checks", "market:s gaps:l backward:l longest_step:l", f"{T}, {BK}, z AS (SELECT market, ingress_seq - lag(ingress_seq) OVER w AS step, (received_ns < lag(received_ns) OVER w)::INT AS back FROM bk WINDOW w AS (PARTITION BY market ORDER BY ingress_seq)) SELECT market, sum((step > 1)::INT) AS gaps, sum(back) AS backward, max(step) AS longest_step FROM z GROUP BY market")(
    lambda s, d: flow.sequence_breaks(flow.books(trades(s, d)))
)
query("t_11_stream_stats", "market:s n:l first_ns:l last_ns:l sides:l", f"{T} SELECT market, count(*) AS n, min(event_ns) AS first_ns, max(event_ns) AS last_ns, count(DISTINCT side) AS sides FROM trades GROUP BY market")(
    lambda s, d: trades(s, d).groupBy("market").agg(F.count("*").alias("n"), F.min("event_ns").alias("first_ns"), F.max("event_ns").alias("last_ns"), F.countDistinct("side").alias("sides"))
)
for minutes in (15, 240):
    query(f"t_12_bars_{minutes}m", "market:s ts:s open:d high:d low:d close:d volume:d", f"{T}, {intraday(minutes)} SELECT market, strftime(ts, {FMT}) AS ts, open, high, low, close, volume FROM ibars")(
        lambda s, d, minutes=minutes: flow.tumbling_bars(trades(s, d), f"{minutes} minutes").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
query("t_12_session_bars", "market:s ts:s open:d close:d volume:d", f"{T}, z AS (SELECT *, (ts - INTERVAL 9 HOUR)::DATE + INTERVAL 9 HOUR AS s FROM trades) SELECT market, strftime(s, {FMT}) AS ts, first(price ORDER BY ts, event_id) AS open, last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM z GROUP BY market, s")(
    lambda s, d: flow.tumbling_bars(trades(s, d), "1 day", "9 hours").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
)
query("t_13_closed_bars", "market:s ts:s close:d", f"{T}, {intraday(15)}, l AS (SELECT market, max(ts) AS m FROM ibars GROUP BY market) SELECT b.market, strftime(b.ts, {FMT}) AS ts, close FROM ibars b JOIN l ON l.market = b.market AND b.ts < m")(
    lambda s, d: bars_intraday(s, d).withColumn("m", F.max("ts").over(Window.partitionBy("market"))).where("ts < m").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
)
query("e_01_time_zones", "event_id:l seoul:s back:s", f"{T} SELECT event_id, strftime(ts + INTERVAL 9 HOUR, {FMT}) AS seoul, strftime(ts, {FMT}) AS back FROM trades")(
    lambda s, d: trades(s, d).withColumn("k", F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), "ts")).select("event_id", F.date_format("k", "yyyy-MM-dd HH:mm:ss").alias("seoul"), F.date_format(F.convert_timezone(F.lit("Asia/Seoul"), F.lit("UTC"), "k"), "yyyy-MM-dd HH:mm:ss").alias("back"))
)
query("e_02_nanoseconds", "event_id:l event_ns:l", f"{T} SELECT event_id, event_ns FROM trades")(lambda s, d: trades(s, d))
query("e_04_stable_order", "day:s market:s place:l", f"{W} SELECT day, market, row_number() OVER (PARTITION BY day ORDER BY sha256(day::VARCHAR || '|' || market || '|salt')) AS place FROM bars")(
    lambda s, d: bars_1d(s, d).withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.sha2(F.concat_ws("|", F.col("day").cast("string"), "market", F.lit("salt")).cast("binary"), 256))))
)
query("e_05_clip_digitize", "day:s market:s clipped:d bin:l", f"{W} SELECT day, market, least(greatest(close / open - 1, -0.05), 0.05) AS clipped, (close / open - 1 >= -0.03)::INT + (close / open - 1 >= 0)::INT + (close / open - 1 >= 0.03)::INT AS bin FROM bars")(
    lambda s, d: bars_1d(s, d).withColumn("r", F.col("close") / F.col("open") - 1).withColumns({"clipped": F.least(F.greatest("r", F.lit(-0.05)), F.lit(0.05)), "bin": sum((F.when(F.col("r") >= e, 1).otherwise(0) for e in (-0.03, 0.0, 0.03)), F.lit(0))})
)
query("e_06_json_members", "k:l n:l", "SELECT (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.from_json("props", "k long")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n")))
query("f_33_session_date", "session:s n:l", f"{T} SELECT (ts - INTERVAL 9 HOUR)::DATE AS session, count(*) AS n FROM trades GROUP BY 1")(lambda s, d: trades(s, d).groupBy(F.to_date(F.col("ts") - F.expr("interval 9 hours")).alias("session")).agg(F.count("*").alias("n")))
IB = f"{T}, {intraday(240)}, ss AS (SELECT *, (ts - INTERVAL 9 HOUR)::DATE AS session, row_number() OVER (PARTITION BY market, (ts - INTERVAL 9 HOUR)::DATE ORDER BY ts) AS i FROM ibars)"
query("f_27_first_minutes", "session:s market:s first_vol:d vs_history:d", f"{IB}, v AS (SELECT session, market, sum(CASE WHEN i <= 2 THEN volume ELSE 0 END) AS fv FROM ss GROUP BY ALL), w AS (SELECT *, avg(fv) OVER r AS a, count(*) OVER r AS n FROM v WINDOW r AS (PARTITION BY market ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT session, market, fv AS first_vol, CASE WHEN n >= 5 THEN fv / a END AS vs_history FROM w")(
    lambda s, d: f.first_bars_vs_history(bars_intraday(s, d, 240), 2)
)
