"""Queries: contracts, filters, policies, decisions, orders, pairing and choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.windows import lag
from tidemark.operators import contracts as c
from tidemark.operators import features as f
from tidemark.operators import ranks as r
from tidemark.operators import selection as x
from tidemark.plans.duck import LEDGER, TRADES
from tidemark.plans.duck import lag as lg
from tidemark.plans.duck import pct_rank as pr
from tidemark.plans.q_features import REGIME, SCORE, W
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, ledger, trades

K = "day:s market:s "
SC = f"{W}, {SCORE}, uni AS (SELECT * FROM sc WHERE liq <= 10 AND history >= 70)"
HEADS = f"""{SC}, h0 AS (SELECT *, round(least(greatest(({pr('score')}) * 0.4, 0.01), 0.99), 6) AS p_up10, round(least(greatest(coalesce({pr('r1')}, 0.5) * 0.3, 0.01), 0.99), 6) AS p_dn5 FROM uni),
 h AS (SELECT *, floor(round(p_dn5 * 1e6) / 2 + 0.5) / 1e6 AS p_dn10, floor(round(p_up10 * 1e6) / 4 + 0.5) / 1e6 AS p_up20, round(p_up10 / greatest(p_dn5, 1e-3), 6) AS rr, -floor(round(p_dn5 * 1e6) / 10 + 0.5) / 1e6 AS exp_downside FROM h0),
 r1 AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rr DESC, p_dn10, p_up10 DESC, exp_downside DESC, market) AS rk FROM h),
 d0 AS (SELECT *, round((({pr('p_dn5')}) + coalesce({pr('uq')}, 0.5)) / 2, 6) AS dump_risk FROM r1), d1 AS (SELECT *, round({pr('dump_risk')}, 9) > 0.666666667 AS dump FROM d0)"""


def universe(s, d):
    return r.scored(bars_1d(s, d)).where("liq <= 10 and history >= 70")


def ranked(s, d):
    return x.with_dump_flag(x.order_risk_reward(x.heads(universe(s, d))))


query("s_01_scan", K + "open:d high:d low:d close:d volume:d", f"{W} SELECT * FROM bars WHERE market = 'M07' AND day >= DATE '1996-01-01' AND day < DATE '1998-01-01'")(lambda s, d: c.scan(bars_1d(s, d), "M07", "1996-01-01", "1998-01-01"))
query("s_02_markets", "market:s", f"{W} SELECT DISTINCT market FROM bars")(lambda s, d: bars_1d(s, d).select("market").distinct())
query("s_03_ranges", "market:s first_day:s last_day:s n:l", f"{W} SELECT market, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM bars GROUP BY market")(lambda s, d: c.market_ranges(bars_1d(s, d)))
query("s_04_upsert", K + "close:d", f"{W} SELECT day, market, CASE WHEN day_of_month % 5 = 0 THEN close * 2 ELSE close END AS close FROM (SELECT *, day(day) AS day_of_month FROM bars)")(
    lambda s, d: c.upsert((b := bars_1d(s, d)), b.where(F.dayofmonth("day") % 5 == 0).withColumn("close", F.col("close") * 2), ["market", "day"])
)
ODD = "odd AS (SELECT day, market, open, CASE WHEN trades % 7 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN trades % 5 = 0 THEN high + 1 ELSE low END AS low, CASE WHEN trades % 11 = 0 THEN -close ELSE close END AS close, volume FROM bars)"
query(
    "s_05_contract", "reason:s n:l",
    f"{W}, {ODD} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN least(open, high, low, close) <= 0 THEN 'not_positive' WHEN high < greatest(open, close) THEN 'high_too_low' WHEN low > least(open, close) THEN 'low_too_high' WHEN volume < 0 THEN 'negative_volume' ELSE 'valid' END AS reason FROM odd) GROUP BY reason",
)(
    lambda s, d: bars_1d(s, d).withColumns({"high2": F.when(F.col("trades") % 7 == 0, F.col("low") - 1).otherwise(F.col("high")), "low2": F.when(F.col("trades") % 5 == 0, F.col("high") + 1).otherwise(F.col("low")), "close2": F.when(F.col("trades") % 11 == 0, -F.col("close")).otherwise(F.col("close"))})
    .select("open", F.col("high2").alias("high"), F.col("low2").alias("low"), F.col("close2").alias("close"), "volume").withColumn("reason", F.coalesce(c.ohlc_reason(), F.lit("valid"))).groupBy("reason").agg(F.count("*").alias("n"))
)
query("s_06_duplicate_keys", "l_orderkey:l l_linenumber:l n:l", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(lambda s, d: c.duplicate_keys(s.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]))
query("s_07_market_names", "name:s valid:b", "SELECT DISTINCT event_type AS name, regexp_full_match(upper(event_type), '[A-Z0-9][A-Z0-9-]*') AND length(event_type) <= 32 AS valid FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("name")).distinct().withColumn("valid", c.valid_market(F.upper("name")))
)
query(
    "s_16_fingerprint", "market:s n:l digest:l",
    f"{W} SELECT market, count(*) AS n, sum(('0x' || substr(md5(market || '|' || day::VARCHAR || '|' || trades::VARCHAR || '|' || volume::BIGINT::VARCHAR), 1, 12))::BIGINT::HUGEINT) % 1000000007 AS digest FROM bars GROUP BY market",
)(lambda s, d: c.fingerprint(bars_1d(s, d).withColumn("v", F.col("volume").cast("long")), "market", "market", "day", "trades", "v"))
query("s_17_book_levels", "market:s level:l n:l mean_bid:d", f"WITH {TRADES} SELECT market, level, count(*) AS n, avg(price - 0.05 * (level + 1)) AS mean_bid FROM trades, (SELECT unnest([0, 1, 2]) AS level) GROUP BY ALL")(
    lambda s, d: trades(s, d).select("market", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("price") - F.lit(0.05) * (i + 1))).alias("level", "bid")).groupBy("market", "level").agg(F.count("*").alias("n"), F.avg("bid").alias("mean_bid"))
)
query("p_01_exclusions", "market:s n:l", f"{W} SELECT market, count(*) AS n FROM bars WHERE market NOT IN ('M03', 'M11') GROUP BY market")(
    lambda s, d: bars_1d(s, d).join(F.broadcast(s.createDataFrame([("M03",), ("M11",)], "market string")), "market", "left_anti").groupBy("market").agg(F.count("*").alias("n"))
)
query("p_02_aliases", "market:s n:l", f"{W} SELECT CASE market WHEN 'M05' THEN 'N05' WHEN 'M06' THEN 'N06' ELSE market END AS market, count(*) AS n FROM bars GROUP BY 1")(
    lambda s, d: bars_1d(s, d).join(F.broadcast(s.createDataFrame([("M05", "N05"), ("M06", "N06")], "market string, name string")), "market", "left").select(F.coalesce("name", "market").alias("market")).groupBy("market").agg(F.count("*").alias("n"))
)
query("p_03_closed_sessions", "market:s n:l last_ts:s", f"WITH {TRADES} SELECT market, count(*) AS n, strftime(max(ts), '%Y-%m-%d') AS last_ts FROM trades WHERE ts < TIMESTAMP '2024-01-20 09:00:00' GROUP BY market")(
    lambda s, d: trades(s, d).where(F.col("ts") < F.date_trunc("day", F.lit("2024-01-20 15:30:00").cast("timestamp_ntz") - F.expr("interval 9 hours")) + F.expr("interval 9 hours")).groupBy("market").agg(F.count("*").alias("n"), F.to_date(F.max("ts")).alias("last_ts"))
)
query("p_04_closed_utc", "market:s n:l", f"WITH {TRADES} SELECT market, count(*) AS n FROM trades WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY market")(
    lambda s, d: trades(s, d).where(F.col("ts") < F.date_trunc("day", F.lit("2024-01-20 15:30:00").cast("timestamp_ntz"))).groupBy("market").agg(F.count("*").alias("n"))
)
query("p_05_asof_cut", "market:s n:l", f"{W} SELECT market, count(*) AS n FROM bars WHERE day <= DATE '1997-06-30' GROUP BY market")(lambda s, d: bars_1d(s, d).where(F.col("day") <= F.lit("1997-06-30").cast("date")).groupBy("market").agg(F.count("*").alias("n")))
query("p_06_history_gate", K + "history:l", f"{W}, h AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY day) - 1 AS history FROM bars) SELECT day, market, history FROM h WHERE history >= 70")(
    lambda s, d: bars_1d(s, d).withColumn("history", F.row_number().over(Window.partitionBy("market").orderBy("day")) - 1).where("history >= 70")
)
query("p_07_gap_free", K + "close:d", f"{W} SELECT day, market, close FROM (SELECT *, {lg('day', 2)} AS b FROM bars) WHERE b = day - 2")(lambda s, d: bars_1d(s, d).withColumn("b", lag("day", 2)).where(F.col("b") == F.date_sub("day", 2)))
query(
    "p_08_relaxed_filter", K + "relaxed:b",
    f"{SC}, q AS (SELECT *, (s7 > 1.2 AND r7 > 0)::INT AS strict, (s7 > 0.8)::INT AS loose FROM uni), n AS (SELECT *, coalesce(sum(strict) OVER (PARTITION BY day), 0) AS k FROM q) SELECT day, market, k < 2 AS relaxed FROM n WHERE (k >= 2 AND strict = 1) OR (k < 2 AND loose = 1)",
)(
    lambda s, d: universe(s, d).withColumns({"strict": F.expr("int(s7 > 1.2 and r7 > 0)"), "loose": F.expr("int(s7 > 0.8)")}).withColumn("k", F.coalesce(F.sum("strict").over(x.day_window()), F.lit(0))).where("(k >= 2 and strict = 1) or (k < 2 and loose = 1)").withColumn("relaxed", F.col("k") < 2)
)
FAMILIES = {"quiet": "s7 < 0.7", "momentum": "r7 > 0.02 AND r3 > 0", "breakout": "s7 > 1.5", "reversal": "r3 < -0.02 AND r1 > 0", "strong": "r1 > 0.03", "all": "TRUE"}
query("p_09_setup_families", "family:s n:l mean_score:d", SC + " " + " UNION ALL ".join(f"SELECT '{n}' AS family, count(*) AS n, avg(score) AS mean_score FROM uni WHERE {p}" for n, p in FAMILIES.items()))(
    lambda s, d: x.per_policy(universe(s, d), "score", FAMILIES).withColumnsRenamed({"policy": "family", "mean": "mean_score"})
)
query("p_10_policies", "policy:s n:l mean_p:d", HEADS + " " + " UNION ALL ".join(f"SELECT '{n}' AS policy, count(*) AS n, avg(p_up10) AS mean_p FROM d1 WHERE {p}" for n, p in x.POLICIES.items()))(
    lambda s, d: x.per_policy(ranked(s, d), "p_up10").withColumnRenamed("mean", "mean_p")
)
TIER = "t AS (SELECT *, coalesce(r7 > 0.02, false) AS s1, coalesce(s7 > 1.2, false) AS s2, coalesce(r1 > 0 AND r3 < 0, false) AS s3, coalesce(liq <= 5, false) AS s4 FROM d1), tt AS (SELECT *, CASE WHEN s1 AND s2 AND s4 THEN 'A_TRIPLE' WHEN s3 THEN 'B_S03' WHEN s1 OR s2 THEN 'C_PRIMARY' ELSE 'NO_PRIMARY' END AS tier, ((p_up10 * 0.1 - (1 - p_up10) * 0.05 - 0.0015) * 100) AS edge FROM t)"
query(
    "p_11_decision", "decision:s reason:s tier:s n:l",
    f"{HEADS.replace('WITH ', 'WITH ' + '', 1)}, {REGIME}, {TIER} SELECT CASE WHEN btc_regime = 'bear_volatile' THEN 'SILENCE' WHEN tier = 'NO_PRIMARY' OR edge <= 0 THEN 'WATCH_ONLY' ELSE 'ACTIVE' END AS decision, CASE WHEN btc_regime = 'bear_volatile' THEN 'regime' WHEN tier = 'NO_PRIMARY' THEN 'no_setup' WHEN edge <= 0 THEN 'edge' ELSE 'ok' END AS reason, tier, count(*) AS n FROM tt LEFT JOIN regime g ON g.day = tt.day GROUP BY ALL",
)(
    lambda s, d: x.setups(ranked(s, d)).join(f.regime(bars_1d(s, d).where("market = 'M00'")).select("day", "btc_regime"), "day", "left").withColumn("o", x.decision(F.col("btc_regime"), F.col("tier"), F.col("p_up10"), x.edge(F.col("p_up10")))).groupBy("o.decision", "o.reason", "tier").agg(F.count("*").alias("n"))
)
query("p_13_edge", K + "edge_pct:d", f"{HEADS}, {TIER} SELECT day, market, edge AS edge_pct FROM tt")(lambda s, d: ranked(s, d).withColumn("edge_pct", x.edge(F.col("p_up10"))))
query("p_14_tiers", K + "tier:s", f"{HEADS}, {TIER} SELECT day, market, tier FROM tt")(lambda s, d: x.setups(ranked(s, d)))
query("p_15_setup_counts", "setup:s fires:l", f"{HEADS}, {TIER} SELECT setup, count(*) AS fires FROM (SELECT unnest([CASE WHEN s1 THEN 'S01' END, CASE WHEN s2 THEN 'S02' END, CASE WHEN s3 THEN 'S03' END, CASE WHEN s4 THEN 'S04' END]) AS setup FROM tt) WHERE setup IS NOT NULL GROUP BY setup")(
    lambda s, d: x.setups(ranked(s, d)).select(F.explode("setups").alias("setup")).groupBy("setup").agg(F.count("*").alias("fires"))
)
query(
    "p_16_pump_rules", K + "rule:s overheat:b pump_score:d",
    f"{SC}, q AS (SELECT *, {pr('r1')} AS a, {pr('s7')} AS b FROM uni) SELECT day, market, CASE WHEN a >= 0.9 AND b >= 0.7 THEN 'R1' ELSE 'R2' END AS rule, coalesce(r7 > 0.1, false) AS overheat, least(greatest(0.6 * a + 0.4 * b, 0), 1) AS pump_score FROM q WHERE (a >= 0.9 AND b >= 0.7) OR (a >= 0.7 AND b >= 0.9)",
)(
    lambda s, d: universe(s, d).withColumns({"a": r.pct_rank("r1", "day"), "b": r.pct_rank("s7", "day")}).withColumn("rule", F.when(F.expr("a >= 0.9 and b >= 0.7"), "R1").when(F.expr("a >= 0.7 and b >= 0.9"), "R2")).where("rule is not null").withColumns({"overheat": F.coalesce(F.col("r7") > 0.1, F.lit(False)), "pump_score": F.least(F.greatest(0.6 * F.col("a") + 0.4 * F.col("b"), F.lit(0.0)), F.lit(1.0))})
)
query(
    "p_17_exposure_cap", "btc_regime:s n:l max_open:l",
    f"{W}, {LEDGER}, {REGIME}, cap(btc_regime, cap) AS (VALUES ('bull_quiet', 3), ('bull_volatile', 2), ('bear_quiet', 1), ('bear_volatile', 0)), j AS (SELECT l.*, coalesce(g.btc_regime, 'bear_quiet') AS btc_regime FROM ledger l LEFT JOIN regime g ON g.day = l.day), k AS (SELECT j.*, row_number() OVER (PARTITION BY day ORDER BY trade_id) AS i, cap FROM j JOIN cap USING (btc_regime)) SELECT btc_regime, count(*) AS n, max(i) AS max_open FROM k WHERE cap > 0 AND i <= cap GROUP BY btc_regime",
)(
    lambda s, d: ledger(s, d).join(f.regime(bars_1d(s, d).where("market = 'M00'")).select("day", "btc_regime"), "day", "left").withColumn("btc_regime", F.coalesce("btc_regime", F.lit("bear_quiet")))
    .withColumn("cap", F.create_map(*[F.lit(v) for kv in {"bull_quiet": 3, "bull_volatile": 2, "bear_quiet": 1, "bear_volatile": 0}.items() for v in kv])[F.col("btc_regime")]).withColumn("i", F.row_number().over(x.day_window().orderBy("trade_id"))).where("cap > 0 and i <= cap").groupBy("btc_regime").agg(F.count("*").alias("n"), F.max("i").alias("max_open"))
)
query("p_18_consistency", "violation:s n:l", f"WITH {LEDGER} SELECT CASE WHEN status = 'open' AND net_pct IS NOT NULL THEN 'open_with_result' WHEN abs(net_pct) > 9 THEN 'magnitude' ELSE 'none' END AS violation, count(*) AS n FROM ledger GROUP BY 1")(
    lambda s, d: ledger(s, d).withColumn("violation", F.when((F.col("status") == "open") & F.col("net_pct").isNotNull(), "open_with_result").when(F.abs("net_pct") > 9, "magnitude").otherwise("none")).groupBy("violation").agg(F.count("*").alias("n"))
)
query("r_07_risk_reward_order", K + "rk:l rr:d", f"{HEADS} SELECT day, market, rk, rr FROM r1")(lambda s, d: x.order_risk_reward(x.heads(universe(s, d))))
query("r_08_penalised_order", K + "rk:l pen:d", f"{HEADS} SELECT day, market, pen, row_number() OVER (PARTITION BY day ORDER BY pen DESC, market) AS rk FROM (SELECT *, round(p_up10 - 0.5 * p_dn5, 6) AS pen FROM h)")(lambda s, d: x.order_penalised(x.heads(universe(s, d)), 0.5))
query("r_09_reselection", K + "rk2:l", f"{HEADS}, z AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY dump::INT, rk) AS slot FROM d1) SELECT day, market, row_number() OVER (PARTITION BY day ORDER BY rk) AS rk2 FROM z WHERE slot <= 3")(lambda s, d: x.reselect(ranked(s, d), 3))
query("r_10_dump_risk", K + "dump_risk:d dump:b", f"{HEADS} SELECT day, market, dump_risk, dump FROM d1")(ranked)
SHORT = f"{HEADS}, sh AS (SELECT *, CASE WHEN liq % 4 <> 0 THEN round(r3, 9) END AS flow FROM d1 WHERE rk <= 5), ok AS (SELECT day FROM sh GROUP BY day HAVING count(flow) = count(*))"
query("r_12_shortlist_rerank", K + "rk2:l", f"{SHORT}, z AS (SELECT sh.*, row_number() OVER (PARTITION BY day ORDER BY flow DESC, rk) AS rk2 FROM sh SEMI JOIN ok USING (day)) SELECT day, market, rk2 FROM z WHERE rk2 <= 3")(
    lambda s, d: ranked(s, d).where("rk <= 5").withColumn("flow", F.when(F.col("liq") % 4 != 0, F.round("r3", 9))).withColumns({"have": F.count("flow").over(x.day_window()), "n": F.count("*").over(x.day_window())}).where("have = n").withColumn("rk2", F.row_number().over(x.day_window().orderBy(F.desc("flow"), "rk"))).where("rk2 <= 3")
)
TIES = f"{HEADS}, ti AS (SELECT *, round(p_up10, 1) AS tie, CASE WHEN liq <> 7 THEN round(r3, 9) END AS flow FROM h), tr AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY tie DESC, market) AS rank FROM ti), bl AS (SELECT *, min(rank) OVER b AS lo, max(rank) OVER b AS hi, count(flow) OVER b AS have, count(*) OVER b AS n FROM tr WINDOW b AS (PARTITION BY day, tie))"
query("r_13_tie_reorder", K + "rank:l rank2:l", f"{TIES} SELECT day, market, rank, CASE WHEN lo <= 3 AND hi > 3 AND have = n THEN row_number() OVER (PARTITION BY day, tie ORDER BY flow DESC NULLS LAST, rank) + lo - 1 ELSE rank END AS rank2 FROM bl")(
    lambda s, d: x.tie_reorder(x.heads(universe(s, d)).withColumns({"tie": F.round("p_up10", 1), "flow": F.when(F.col("liq") != 7, F.round("r3", 9))}).withColumn("rank", F.row_number().over(x.day_window().orderBy(F.desc("tie"), "market"))), "rank", "tie", "flow")
)
CELL = "least(greatest(ceil(round(({0}) * 4, 9)) - 1, 0), 3)::BIGINT"
CELLS = f"{HEADS}, ce AS (SELECT *, {CELL.format(pr('uq'))} AS lq4, {CELL.format(pr('rr'))} AS rr4 FROM d1)"


def cells(s, d):
    return ranked(s, d).withColumns({"lq4": x.quartile_cell("uq"), "rr4": x.quartile_cell("rr")})


query("r_14_quota_top3", K + "lq4:l", f"{CELLS}, q AS (SELECT day, lq4, count(*) AS quota FROM ce WHERE rk <= 3 GROUP BY ALL), z AS (SELECT ce.*, quota, row_number() OVER (PARTITION BY ce.day, ce.lq4 ORDER BY p_dn5, market) AS i FROM ce JOIN q USING (day, lq4)) SELECT day, market, lq4 FROM z WHERE i <= quota")(
    lambda s, d: cells(s, d).withColumn("quota", F.sum((F.col("rk") <= 3).cast("int")).over(Window.partitionBy("day", "lq4"))).withColumn("i", F.row_number().over(Window.partitionBy("day", "lq4").orderBy("p_dn5", "market"))).where("i <= quota")
)
query("r_15_quartile_cells", K + "lq4:l rr4:l", f"{CELLS} SELECT day, market, lq4, rr4 FROM ce")(cells)
query("r_16_score_alignment", K + "aligned:d", f"{HEADS}, a AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY p_up10, market) AS i FROM h), b AS (SELECT day, rr, row_number() OVER (PARTITION BY day ORDER BY rr, market) AS i FROM h) SELECT a.day, a.market, floor(sum(round(b.rr * 1e6)) OVER (PARTITION BY a.day, a.p_up10) / count(*) OVER (PARTITION BY a.day, a.p_up10) + 0.5) / 1e6 AS aligned FROM a JOIN b USING (day, i)")(
    lambda s, d: (h := x.heads(universe(s, d))).withColumn("i", F.row_number().over(x.day_window().orderBy("p_up10", "market"))).join(h.select("day", F.col("rr").alias("level"), F.row_number().over(x.day_window().orderBy("rr", "market")).alias("i")), ["day", "i"]).withColumn("aligned", F.floor(F.avg(F.round(F.col("level") * 1e6)).over(Window.partitionBy("day", "p_up10")) + 0.5) / 1e6)
)
query("r_17_pump_v2", K + "v2:d rk:l", f"{SC}, q AS (SELECT *, round(0.6 * least(coalesce(s7, 0), 10) / 10 + 0.4 * {pr('score')}, 9) AS v2 FROM uni), z AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY v2 DESC, market) AS rk FROM q) SELECT day, market, v2, rk FROM z WHERE rk <= 5")(
    lambda s, d: r.top_k(universe(s, d).withColumn("v2", F.round(0.6 * F.least(F.coalesce("s7", F.lit(0.0)), F.lit(10.0)) / 10 + 0.4 * r.pct_rank("score", "day"), 9)), "v2", 5)
)
query("r_18_composite", K + "comp:d", f"{HEADS}, {TIER}, z AS (SELECT *, p_up10 + p_up20 + 5 * p_dn10 AS comp FROM tt WHERE s1), y AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(comp, 9) DESC, market) AS i FROM z) SELECT day, market, comp FROM y WHERE i <= 3")(
    lambda s, d: r.top_k(x.setups(ranked(s, d)).where(F.array_contains("setups", "S01")).withColumn("comp", F.col("p_up10") + F.col("p_up20") + 5 * F.col("p_dn10")).drop("rk"), "comp", 3)
)
HASH = "md5(day::VARCHAR || '|' || market || '|{}')"
STRATEGIES = {"momentum": ("round(r7, 9) DESC NULLS LAST", "r7"), "turnover": ("round(s7, 9) DESC NULLS LAST", "s7"), "random": (HASH.format("seed"), "hash")}
query("r_19_baselines", "strategy:s day:s market:s", SC + " " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, day, market FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY {o}, market) AS i FROM uni) WHERE i <= 2" for n, (o, _) in STRATEGIES.items()))(
    lambda s, d: universe(s, d).withColumn("hash", F.md5(F.concat_ws("|", F.col("day").cast("string"), F.col("market"), F.lit("seed")).cast("binary"))).withColumns({n: F.row_number().over(x.day_window().orderBy(F.col(o).asc() if o == "hash" else F.round(o, 9).desc_nulls_last(), "market")) for n, (_, o) in STRATEGIES.items()}).select("day", "market", F.explode(F.filter(F.array(*[F.when(F.col(n) <= 2, F.lit(n)) for n in STRATEGIES]), lambda v: v.isNotNull())).alias("strategy"))
)
query("r_20_threshold_cap", K + "p_up10:d", f"{HEADS}, z AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY p_up10 DESC, market) AS i FROM h WHERE p_up10 >= 0.25) SELECT day, market, p_up10 FROM z WHERE i <= 2")(lambda s, d: r.top_k(x.heads(universe(s, d)).where("p_up10 >= 0.25"), "p_up10", 2))
query("r_21_tercile", K + "scaled:d tercile:l", f"{SC}, q AS (SELECT *, (score - min(score) OVER (PARTITION BY day)) / nullif(max(score) OVER (PARTITION BY day) - min(score) OVER (PARTITION BY day), 0) AS scaled FROM uni) SELECT day, market, scaled, least(floor(round(scaled, 9) * 3), 2) AS tercile FROM q")(
    lambda s, d: universe(s, d).withColumn("scaled", (F.col("score") - F.min("score").over(x.day_window())) / F.nullif(F.max("score").over(x.day_window()) - F.min("score").over(x.day_window()), F.lit(0.0))).withColumn("tercile", F.least(F.floor(F.round("scaled", 9) * 3), F.lit(2)))
)
query("r_22_live_turnover", "market:s qv:d rk:l", f"{W}, l AS (SELECT market, arg_max(quote_volume, day) AS qv FROM bars WHERE day < DATE '1998-06-01' GROUP BY market), z AS (SELECT *, row_number() OVER (ORDER BY qv DESC, market) AS rk FROM l) SELECT * FROM z WHERE rk <= 10")(
    lambda s, d: bars_1d(s, d).where(F.col("day") < F.lit("1998-06-01").cast("date")).groupBy("market").agg(F.max_by("quote_volume", "day").alias("qv")).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("qv"), "market"))).where("rk <= 10")
)
query("r_23_live_universe", "day:s reason:s n:l", f"{W}, {SCORE}, z AS (SELECT day, CASE WHEN uq IS NULL THEN 'invalid_turnover' WHEN history < 70 THEN 'short_history' WHEN liq > 10 THEN 'lower_rank' ELSE 'expected' END AS reason FROM sc) SELECT day, reason, count(*) AS n FROM z GROUP BY ALL")(
    lambda s, d: r.scored(bars_1d(s, d)).withColumn("reason", F.when(F.col("uq").isNull(), "invalid_turnover").when(F.col("history") < 70, "short_history").when(F.col("liq") > 10, "lower_rank").otherwise("expected")).groupBy("day", "reason").agg(F.count("*").alias("n"))
)
GRID = [(lam, q) for lam in (0.0, 0.5, 1.0) for q in (0.7, 1.0)]
query("r_24_rerank_grid", "lam:d cut:d picks:l mean_dn:d", f"{HEADS}, g AS (SELECT d1.*, lam, cut, row_number() OVER (PARTITION BY lam, cut, day ORDER BY round(score - lam * dump_risk, 9) DESC, market) AS i FROM d1, (VALUES {', '.join(f'({a}, {b})' for a, b in GRID)}) v(lam, cut) WHERE dump_risk <= cut) SELECT lam, cut, count(*) AS picks, avg(p_dn5) AS mean_dn FROM g WHERE i <= 3 GROUP BY lam, cut")(
    lambda s, d: ranked(s, d).withColumn("g", F.explode(F.array(*[F.struct(F.lit(a).alias("lam"), F.lit(b).alias("cut")) for a, b in GRID]))).select("*", "g.lam", "g.cut").where("dump_risk <= cut").withColumn("i", F.row_number().over(Window.partitionBy("lam", "cut", "day").orderBy(F.round(F.col("score") - F.col("lam") * F.col("dump_risk"), 9).desc(), "market"))).where("i <= 3").groupBy("lam", "cut").agg(F.count("*").alias("picks"), F.avg("p_dn5").alias("mean_dn"))
)
query("r_25_degeneracy", "days:l picks_a_day:d top5_share:d names:l", f"{HEADS} SELECT count(DISTINCT day) AS days, count(*) / count(DISTINCT day)::DOUBLE AS picks_a_day, avg((liq <= 5)::INT) AS top5_share, count(DISTINCT market) AS names FROM d1 WHERE rk <= 3")(
    lambda s, d: ranked(s, d).where("rk <= 3").agg(F.countDistinct("day").alias("days"), (F.count("*") / F.countDistinct("day")).alias("picks_a_day"), F.avg((F.col("liq") <= 5).cast("int")).alias("top5_share"), F.countDistinct("market").alias("names"))
)
query("j_17_matched_pool", K + "pool_mean:d pool_n:l", f"{CELLS}, p AS (SELECT day, lq4, avg(score) AS pool_mean, count(*) AS pool_n FROM ce WHERE rk > 3 GROUP BY ALL) SELECT ce.day, market, pool_mean, pool_n FROM ce LEFT JOIN p USING (day, lq4) WHERE rk <= 3")(
    lambda s, d: x.matched_pool(cells(s, d).withColumn("picked", F.col("rk") <= 3), "picked", "score", ["lq4"])
)
query("j_18_hash_matched", K + "control:s", f"{CELLS}, z AS (SELECT *, row_number() OVER (PARTITION BY day, lq4, rk <= 3 ORDER BY {HASH.format('salt')}) AS k FROM ce) SELECT a.day, a.market, b.market AS control FROM z a LEFT JOIN z b ON b.day = a.day AND b.lq4 = a.lq4 AND b.k = a.k AND b.rk > 3 WHERE a.rk <= 3")(
    lambda s, d: x.matched_by_hash(cells(s, d).withColumn("picked", F.col("rk") <= 3), "picked", "lq4", "salt")
)
query("j_19_outside_in", "day:s low_market:s high_market:s low:d high:d", f"{CELLS}, z AS (SELECT *, row_number() OVER (PARTITION BY day, lq4 ORDER BY p_dn5, market) AS i, count(*) OVER (PARTITION BY day, lq4) AS n FROM ce) SELECT a.day, a.market AS low_market, b.market AS high_market, a.p_dn5 AS low, b.p_dn5 AS high FROM z a JOIN z b ON a.day = b.day AND a.lq4 = b.lq4 AND b.i = a.n + 1 - a.i WHERE a.i <= a.n // 2 AND a.p_dn5 <> b.p_dn5")(
    lambda s, d: x.outside_in(cells(s, d), ["day", "lq4"], "p_dn5")
)
query(
    "j_20_best_triple", "day:s first:s second:s third:s total:d",
    f"{HEADS}, t AS (SELECT a.day, a.market AS first, b.market AS second, c.market AS third, round(a.p_up10 + b.p_up10 + c.p_up10, 9) AS total FROM h a JOIN h b ON b.day = a.day AND b.market > a.market JOIN h c ON c.day = a.day AND c.market > b.market WHERE a.p_dn5 + b.p_dn5 + c.p_dn5 <= 0.45 AND a.liq + b.liq + c.liq <= 18) SELECT day, first, second, third, total FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, first, second, third) AS i FROM t) WHERE i = 1",
)(lambda s, d: x.best_triple(x.heads(universe(s, d)), "p_up10", [("p_dn5", 0.45), ("liq", 18)]))
