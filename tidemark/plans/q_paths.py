"""Queries: joins in time, paths, exits and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import features as f
from tidemark.operators import paths as p
from tidemark.operators import ranks as r
from tidemark.plans.duck import FOREIGN, TRADES, intraday
from tidemark.plans.duck import lag as lg
from tidemark.plans.q_features import REGIME, SCORE, W
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, bars_intraday, foreign_1d, trades

K = "day:s market:s "
NEXT = "to_timestamp(((epoch_us(ts) // 1000000) // 900) * 900 + 900)::TIMESTAMP"
P = f"WITH {TRADES}, {intraday(15)}, en AS (SELECT event_id AS entry_id, market, ts AS seen, {NEXT} AS start FROM trades)"
PATHS = P + """, pp AS (SELECT entry_id, en.market, start, b.ts, (epoch(b.ts) - epoch(start))::BIGINT // 900 AS idx, open, high, low, close FROM en JOIN ibars b ON b.market = en.market AND b.ts >= start AND b.ts < start + INTERVAL 24 HOUR),
 pa AS (SELECT *, first(open) OVER (PARTITION BY entry_id ORDER BY idx) AS entry, max(high) OVER (PARTITION BY entry_id ORDER BY idx) AS hh FROM pp)"""


def en(s, d):
    return p.entries(trades(s, d))


def paths(s, d):
    return p.interval_join(en(s, d), bars_intraday(s, d))


def each(s, d, fold):
    """fold(paths) for every entry, worked out once a start."""
    return p.per_start(en(s, d), bars_intraday(s, d), fold)


query("j_01_regime_join", K + "ret:d btc_regime:s", f"{W}, {REGIME} SELECT b.day, market, ret, btc_regime FROM (SELECT *, close / {lg('close')} - 1 AS ret FROM bars) b LEFT JOIN regime ON regime.day = b.day")(
    lambda s, d: bars_1d(s, d).withColumn("ret", f.ret()).join(f.regime(bars_1d(s, d).where("market = 'M00'")).select("day", "btc_regime"), "day", "left")
)
query("j_02_previous_regime", K + "btc_regime:s", f"{W}, {REGIME} SELECT bars.day, market, g AS btc_regime FROM bars LEFT JOIN (SELECT day, lag(btc_regime) OVER (ORDER BY day) AS g FROM regime) q ON q.day = bars.day")(
    lambda s, d: bars_1d(s, d).join(f.regime(bars_1d(s, d).where("market = 'M00'")).select("day", F.lag("btc_regime").over(Window.orderBy("day")).alias("btc_regime")), "day", "left")
)
query("j_03_feature_outcome", K + "score:d up:d", f"{W}, {SCORE} SELECT sc.day, sc.market, score, b.high / b.open - 1 AS up FROM sc JOIN bars b ON b.day = sc.day AND b.market = sc.market")(
    lambda s, d: r.scored(bars_1d(s, d)).select("day", "market", "score").join(bars_1d(s, d).select("day", "market", (F.col("high") / F.col("open") - 1).alias("up")), ["day", "market"])
)
query("j_04_symbol_map", "day:s market:s ratio:d", f"{W}, {FOREIGN} SELECT bars.day, market, fx.close / bars.close AS ratio FROM bars JOIN fx ON fx.symbol = 'X' || substr(market, 2) AND fx.day = bars.day")(
    lambda s, d: bars_1d(s, d).withColumn("symbol", F.regexp_replace("market", "^M", "X")).join(foreign_1d(bars_1d(s, d)).withColumnRenamed("close", "fc"), ["symbol", "day"]).withColumn("ratio", F.col("fc") / F.col("close"))
)
query("j_05_strict_d1", K + "fc:d missing:b", f"{W}, {FOREIGN} SELECT bars.day, market, fx.close AS fc, fx.close IS NULL AS missing FROM bars LEFT JOIN fx ON fx.symbol = 'X' || substr(market, 2) AND fx.day = bars.day - 1")(
    lambda s, d: bars_1d(s, d).withColumn("symbol", F.regexp_replace("market", "^M", "X")).join(foreign_1d(bars_1d(s, d)).select("symbol", F.date_add("day", 1).alias("day"), F.col("close").alias("fc")), ["symbol", "day"], "left").withColumn("missing", F.col("fc").isNull())
)
query("j_06_asof_prior", "entry_id:l prior:d", f"{P} SELECT entry_id, (SELECT arg_max(close, ts) FROM ibars b WHERE b.market = en.market AND b.ts < start) AS prior FROM en")(lambda s, d: p.prior_close(en(s, d), bars_intraday(s, d)))
query("j_07_interval_join", "entry_id:l idx:l close:d", f"{PATHS} SELECT entry_id, idx, close FROM pp")(paths)
query("j_08_grid", "entry_id:l idx:l close_f:d observed:b", f"""{P}, g AS (SELECT en.*, i AS idx, start + to_seconds(i * 900) AS ts FROM en, range(96) t(i)), o AS (SELECT g.*, b.close FROM g LEFT JOIN ibars b ON b.market = g.market AND b.ts = g.ts)
 SELECT entry_id, idx, coalesce(close, last_value(close IGNORE NULLS) OVER (PARTITION BY entry_id ORDER BY idx ROWS UNBOUNDED PRECEDING), (SELECT arg_max(close, ts) FROM ibars b WHERE b.market = o.market AND b.ts < o.start)) AS close_f, close IS NOT NULL AS observed FROM o""")(lambda s, d: p.grid(en(s, d), bars_intraday(s, d)))
query("j_09_next_boundary", "entry_id:l start:s open:d", f"{P} SELECT entry_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, open FROM en LEFT JOIN ibars b ON b.market = en.market AND b.ts = start")(
    lambda s, d: en(s, d).join(bars_intraday(s, d).select("market", F.col("ts").alias("start"), "open"), ["market", "start"], "left").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
)
query("j_10_requested_keys", K + "hit:l", f"{W}, {SCORE}, k AS (SELECT DISTINCT day, market FROM sc WHERE liq <= 3) SELECT k.day, k.market, (high / open - 1 >= 0.05)::INT AS hit FROM k LEFT JOIN bars b USING (day, market)")(
    lambda s, d: r.scored(bars_1d(s, d)).where("liq <= 3").select("day", "market").distinct().join(bars_1d(s, d), ["day", "market"], "left").withColumn("hit", (F.col("high") / F.col("open") - 1 >= 0.05).cast("int"))
)
query("j_22_breadth_window", K + "up_share:d", f"{W}, x AS (SELECT *, (close / {lg('close')} - 1 > 0)::INT AS u FROM bars) SELECT day, market, avg(u) OVER (PARTITION BY day) AS up_share FROM x")(
    lambda s, d: bars_1d(s, d).withColumn("u", (f.ret() > 0).cast("int")).withColumn("up_share", F.avg("u").over(Window.partitionBy("day")))
)
FT = "ft AS (SELECT entry_id, any_value(entry) AS entry, min(CASE WHEN low <= entry * (1 - {0}) THEN idx END) AS i_sl, min(CASE WHEN high >= entry * (1 + {1}) THEN idx END) AS i_tp, arg_max(close, idx) AS lc FROM pa GROUP BY entry_id)"
query("x_01_first_touch", "entry_id:l reason:s gross:d", f"{PATHS}, {FT.format(0.02, 0.02)} SELECT entry_id, CASE WHEN i_sl <= coalesce(i_tp, 999) THEN 'sl' WHEN i_tp IS NOT NULL THEN 'tp' ELSE 'eod' END AS reason, CASE WHEN i_sl <= coalesce(i_tp, 999) THEN -0.02 WHEN i_tp IS NOT NULL THEN 0.02 ELSE lc / entry - 1 END AS gross FROM ft")(
    lambda s, d: each(s, d, lambda q: p.first_touch(q, 0.02, 0.02))
)
SPECS = [("v1", 0.01, 0.01), ("v2", 0.02, 0.03), ("v3", 0.03, 0.02), ("v4", 0.05, 0.05)]
LAD = "min(CASE WHEN high >= entry * (1 + {0}) THEN idx END)"
query(
    "x_03_ladder", "entry_id:l gross:d n_sell:l floored:b",
    f"{PATHS}, h AS (SELECT entry_id, min(CASE WHEN low <= entry * (1 - 0.02) THEN idx END) AS fl, {LAD.format(0.01)} AS a, {LAD.format(0.02)} AS b, {LAD.format(0.04)} AS c, arg_max(close, idx) / any_value(entry) - 1 AS e FROM pa GROUP BY entry_id), z AS (SELECT *, coalesce(a < coalesce(fl, 999), false)::INT AS sa, coalesce(b < coalesce(fl, 999), false)::INT AS sb, coalesce(c < coalesce(fl, 999), false)::INT AS sc FROM h) SELECT entry_id, sa * 0.005 + sb * 0.006 + sc * 0.008 + (1 - 0.5 * sa - 0.3 * sb - 0.2 * sc) * CASE WHEN fl IS NOT NULL THEN -0.02 ELSE e END AS gross, sa + sb + sc + (sa + sb + sc < 3)::INT AS n_sell, fl IS NOT NULL AS floored FROM z",
)(lambda s, d: each(s, d, lambda q: p.ladder(q, 0.02, [(0.01, 0.5), (0.02, 0.3), (0.04, 0.2)])))
query("x_04_ladder_cost", "entry_id:l cost:d", f"{PATHS}, h AS (SELECT entry_id, min(CASE WHEN low <= entry * (1 - 0.02) THEN idx END) AS fl, {LAD.format(0.01)} AS a, {LAD.format(0.02)} AS b, {LAD.format(0.04)} AS c FROM pa GROUP BY entry_id), z AS (SELECT *, coalesce(a < coalesce(fl, 999), false)::INT + coalesce(b < coalesce(fl, 999), false)::INT + coalesce(c < coalesce(fl, 999), false)::INT AS n FROM h) SELECT entry_id, 0.001 + 0.0005 + greatest(n + (n < 3)::INT - 1, 0) * 0.0002 AS cost FROM z")(
    lambda s, d: each(s, d, lambda q: p.ladder(q, 0.02, [(0.01, 0.5), (0.02, 0.3), (0.04, 0.2)])).withColumn("cost", 0.001 + 0.0005 + F.greatest(F.col("n_sell") - 1, F.lit(0)) * 0.0002)
)
query(
    "x_05_trailing", "entry_id:l reason:s gross:d",
    f"{PATHS}, q AS (SELECT *, CASE WHEN low <= entry * (1 - 0.03) THEN 'stop' WHEN hh >= entry * (1 + 0.01) AND low <= hh * (1 - 0.015) THEN 'trail' WHEN high >= entry * (1 + 0.04) THEN 'target' WHEN idx >= 80 THEN 'time' END AS rs FROM pa), z AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY rs IS NULL, CASE WHEN rs IS NOT NULL THEN idx END, idx DESC) AS i FROM q) SELECT entry_id, coalesce(rs, 'eod') AS reason, CASE rs WHEN 'stop' THEN -0.03 WHEN 'trail' THEN hh * (1 - 0.015) / entry - 1 WHEN 'target' THEN 0.04 ELSE close / entry - 1 END AS gross FROM z WHERE i = 1",
)(lambda s, d: each(s, d, lambda q: p.trailing(q, 0.01, 0.015, 0.03, 0.04, 80)))
D1 = "CASE WHEN low <= open * (1 - 0.05) THEN -0.05 WHEN high >= open * (1 + 0.08) THEN 0.08 ELSE close / open - 1 END"
query("x_09_daily_tp_sl", K + "gross:d net:d", f"{W} SELECT day, market, {D1} AS gross, {D1} - 0.0015 AS net FROM bars")(
    lambda s, d: bars_1d(s, d).withColumn("gross", F.when(F.col("low") <= F.col("open") * (1 - F.lit(0.05)), -0.05).when(F.col("high") >= F.col("open") * (1 + F.lit(0.08)), 0.08).otherwise(F.col("close") / F.col("open") - 1)).withColumn("net", F.col("gross") - 0.0015)
)
query("x_11_downside_summary", "entry_id:l path_min:d stopped:b net:d net_no_stop:d", f"{PATHS} SELECT entry_id, min(low) / any_value(entry) - 1 AS path_min, min(low) <= any_value(entry) * (1 - 0.02) AS stopped, CASE WHEN min(low) <= any_value(entry) * (1 - 0.02) THEN -0.02 ELSE arg_max(close, idx) / any_value(entry) - 1 END - 0.0015 AS net, arg_max(close, idx) / any_value(entry) - 1 - 0.0015 AS net_no_stop FROM pa GROUP BY entry_id")(
    lambda s, d: each(s, d, lambda q: p.with_entry_price(q).groupBy("entry_id").agg(F.first("entry").alias("e"), F.min("low").alias("lo"), F.max_by("close", "idx").alias("c"))).withColumns({"path_min": F.col("lo") / F.col("e") - 1, "stopped": F.col("lo") <= F.col("e") * (1 - F.lit(0.02)), "net_no_stop": F.col("c") / F.col("e") - 1 - 0.0015}).withColumn("net", F.when(F.col("stopped"), F.lit(-0.02) - 0.0015).otherwise(F.col("net_no_stop")))
)
query("x_12_what_hit_first", "first_hit:s n:l", f"{PATHS}, {FT.format(0.01, 0.01)} SELECT CASE WHEN i_sl < i_tp THEN 'stop' WHEN i_sl = i_tp THEN 'same_bar' ELSE 'target' END AS first_hit, count(*) AS n FROM ft WHERE i_sl IS NOT NULL AND i_tp IS NOT NULL GROUP BY 1")(
    lambda s, d: each(s, d, lambda q: p.first_touch(q, 0.01, 0.01)).where("i_sl is not null and i_tp is not null").withColumn("first_hit", F.when(F.col("i_sl") < F.col("i_tp"), "stop").when(F.col("i_sl") == F.col("i_tp"), "same_bar").otherwise("target")).groupBy("first_hit").agg(F.count("*").alias("n"))
)
DEL = P + """, de AS (SELECT entry_id * 10 + k AS entry_id, market, to_timestamp(((epoch_us(seen) // 1000000) // 900) * 900 + 900 + k * 900)::TIMESTAMP AS start, k FROM en, range(3) t(k)),
 dp AS (SELECT entry_id, k, (epoch(b.ts) - epoch(start))::BIGINT // 900 AS idx, open, high, low, close FROM de JOIN ibars b ON b.market = de.market AND b.ts >= start AND b.ts < start + INTERVAL 24 HOUR), da AS (SELECT *, first(open) OVER (PARTITION BY entry_id ORDER BY idx) AS entry FROM dp),
 dz AS (SELECT entry_id, any_value(k) AS k, max(high) / any_value(entry) - 1 AS mfe, arg_max(close, idx) / any_value(entry) - 1 AS eod FROM da GROUP BY entry_id)"""
query("x_15_entry_delay", "delay:l n:l mfe:d eod:d", f"{DEL} SELECT k * 15 AS delay, count(*) AS n, avg(mfe) AS mfe, avg(eod) AS eod FROM dz GROUP BY k")(
    lambda s, d: p.per_start(en(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select((F.col("entry_id") * 10 + F.col("k")).alias("entry_id"), "market", (F.timestamp_seconds(F.unix_seconds("start") + F.col("k") * 900)).alias("start")), bars_intraday(s, d), p.outcomes).withColumn("delay", F.col("entry_id") % 10 * 15).groupBy("delay").agg(F.count("*").alias("n"), F.avg("mfe").alias("mfe"), F.avg("eod").alias("eod"))
)
EX = [(t, s_) for t in (0.03, 0.06, 0.1) for s_ in (0.03, 0.06)]
query("x_16_execution_grid", "tp:d sl:d n:l mean_gross:d", f"{W} SELECT tp, sl, count(*) AS n, avg(CASE WHEN low <= open * (1 - sl) THEN -sl WHEN high >= open * (1 + tp) THEN tp ELSE close / open - 1 END) AS mean_gross FROM bars, (VALUES {', '.join(map(str, EX))}) v(tp, sl) GROUP BY tp, sl")(
    lambda s, d: bars_1d(s, d).withColumn("g", F.explode(F.array(*[F.struct(F.lit(t).alias("tp"), F.lit(x).alias("sl")) for t, x in EX]))).select("*", "g.tp", "g.sl").withColumn("gr", F.when(F.col("low") <= F.col("open") * (1 - F.col("sl")), -F.col("sl")).when(F.col("high") >= F.col("open") * (1 + F.col("tp")), F.col("tp")).otherwise(F.col("close") / F.col("open") - 1)).groupBy("tp", "sl").agg(F.count("*").alias("n"), F.avg("gr").alias("mean_gross"))
)
query("x_23_path_shape", "entry_id:l path_max:d path_min:d end_ret:d max_idx:l first_hit:l", f"{PATHS} SELECT entry_id, max(high) / any_value(entry) - 1 AS path_max, min(low) / any_value(entry) - 1 AS path_min, arg_max(close, idx) / any_value(entry) - 1 AS end_ret, min(CASE WHEN high = mh THEN idx END) AS max_idx, min(CASE WHEN high >= entry * (1 + 0.02) THEN idx END) AS first_hit FROM (SELECT *, max(high) OVER (PARTITION BY entry_id) AS mh FROM pa) GROUP BY entry_id")(
    lambda s, d: each(s, d, lambda q: p.path_shape(q, 0.02))
)
query("x_27_path_policies", "policy:s n:l mean_gross:d", f"""{PATHS}, {FT.format(0.02, 0.03)}, t AS (SELECT entry_id, arg_max(close, idx) / any_value(entry) - 1 AS t16 FROM pa WHERE idx < 16 GROUP BY entry_id)
 SELECT 'stop_first' AS policy, count(*) AS n, avg(CASE WHEN i_sl <= coalesce(i_tp, 999) THEN -0.02 WHEN i_tp IS NOT NULL THEN 0.03 ELSE lc / entry - 1 END) AS mean_gross FROM ft UNION ALL SELECT 'no_stop', count(*), avg(CASE WHEN i_tp IS NOT NULL THEN 0.03 ELSE lc / entry - 1 END) FROM ft UNION ALL SELECT 'time_4h', count(*), avg(t16) FROM t""")(
    lambda s, d: (q := each(s, d, lambda x: p.first_touch(x, 0.02, 0.03))) is not None and q.select(F.lit("stop_first").alias("policy"), "gross").unionByName(q.select(F.lit("no_stop").alias("policy"), F.when(F.col("i_tp").isNotNull(), 0.03).otherwise(F.col("last_close") / F.col("entry") - 1).alias("gross"))).unionByName(each(s, d, lambda x: p.outcomes(x.where("idx < 16"))).select(F.lit("time_4h").alias("policy"), F.col("eod").alias("gross"))).groupBy("policy").agg(F.count("*").alias("n"), F.avg("gross").alias("mean_gross"))
)
query("x_28_extremes_result", K + "gross:d", f"{W} SELECT day, market, CASE WHEN low / open - 1 <= -0.04 THEN -0.04 WHEN high / open - 1 >= 0.06 THEN 0.06 ELSE close / open - 1 END AS gross FROM bars")(
    lambda s, d: bars_1d(s, d).withColumn("gross", F.when(F.col("low") / F.col("open") - 1 <= -0.04, -0.04).when(F.col("high") / F.col("open") - 1 >= 0.06, 0.06).otherwise(F.col("close") / F.col("open") - 1))
)
query("l_01_next_bar_bin", K + "next_max:d bin:l", f"{W}, n AS (SELECT *, lead(high) OVER w / lead(open) OVER w - 1 AS m FROM bars WINDOW w AS (PARTITION BY market ORDER BY day)) SELECT day, market, m AS next_max, CASE WHEN m < 0.01 THEN 0 WHEN m < 0.03 THEN 1 WHEN m < 0.05 THEN 2 WHEN m < 0.08 THEN 3 WHEN m < 0.12 THEN 4 WHEN m >= 0.12 THEN 5 END AS bin FROM n")(
    lambda s, d: bars_1d(s, d).withColumn("next_max", F.lead("high").over(w := Window.partitionBy("market").orderBy("day")) / F.lead("open").over(w) - 1).withColumn("bin", F.expr("case when next_max < 0.01 then 0 when next_max < 0.03 then 1 when next_max < 0.05 then 2 when next_max < 0.08 then 3 when next_max < 0.12 then 4 when next_max >= 0.12 then 5 end"))
)
query("l_02_binary", K + "label:l", f"{W} SELECT day, market, (lead(high) OVER w / lead(open) OVER w - 1 >= 0.05)::INT AS label FROM bars WINDOW w AS (PARTITION BY market ORDER BY day)")(
    lambda s, d: bars_1d(s, d).withColumn("label", (F.lead("high").over(w := Window.partitionBy("market").orderBy("day")) / F.lead("open").over(w) - 1 >= 0.05).cast("int"))
)
query("l_04_outcome_labels", K + "up5:l up10:l up20:l dn5:l dn10:l neg:l", f"{W} SELECT day, market, " + ", ".join(f"CASE WHEN day < DATE '1998-06-01' THEN ({e})::INT END AS {n}" for n, e in {"up5": "high / open - 1 >= 0.05", "up10": "high / open - 1 >= 0.1", "up20": "high / open - 1 >= 0.2", "dn5": "low / open - 1 <= -0.05", "dn10": "low / open - 1 <= -0.1", "neg": "close < open"}.items()) + " FROM bars")(
    lambda s, d: bars_1d(s, d).withColumns({n: F.when(F.col("day") < F.lit("1998-06-01").cast("date"), F.expr(f"int({e})")) for n, e in {"up5": "high / open - 1 >= 0.05", "up10": "high / open - 1 >= 0.1", "up20": "high / open - 1 >= 0.2", "dn5": "low / open - 1 <= -0.05", "dn10": "low / open - 1 <= -0.1", "neg": "close < open"}.items()})
)
query("l_07_hit_timing", "entry_id:l level:d idx:l minute:l", f"{PATHS} SELECT entry_id, lv AS level, min(CASE WHEN high >= entry * (1 + lv) THEN idx END) AS idx, min(CASE WHEN high >= entry * (1 + lv) THEN idx END) * 15 AS minute FROM pa, (VALUES (0.01), (0.02), (0.03)) v(lv) GROUP BY entry_id, lv")(
    lambda s, d: each(s, d, lambda q: p.with_entry_price(q).groupBy("entry_id").agg(*[F.min(F.when(F.col("high") >= F.col("entry") * (1 + F.lit(v)), F.col("idx"))).alias(f"i{k}") for k, v in enumerate((0.01, 0.02, 0.03))])).select("entry_id", F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"i{k}").alias("idx")) for k, v in enumerate((0.01, 0.02, 0.03))])).alias("x")).select("entry_id", "x.level", "x.idx", (F.col("x.idx") * 15).alias("minute"))
)
query("l_08_sustained", K + "same:l next:l", f"{W} SELECT day, market, (close / open - 1 >= 0.03)::INT AS same, (lead(close) OVER (PARTITION BY market ORDER BY day) / close - 1 >= 0.03)::INT AS next FROM bars")(
    lambda s, d: bars_1d(s, d).withColumns({"same": (F.col("close") / F.col("open") - 1 >= 0.03).cast("int"), "next": (F.lead("close").over(Window.partitionBy("market").orderBy("day")) / F.col("close") - 1 >= 0.03).cast("int")})
)
query("l_09_pump_dump", K + "label:l", f"{W} SELECT day, market, (high / open - 1 >= 0.05 AND close / open - 1 < -0.02)::INT AS label FROM bars")(lambda s, d: bars_1d(s, d).withColumn("label", F.expr("int(high / open - 1 >= 0.05 and close / open - 1 < -0.02)")))
query("l_11_gap_label", K + "label:l", f"{W}, n AS (SELECT *, lead(day) OVER w AS nd, lead(high) OVER w / lead(open) OVER w - 1 AS m FROM bars WINDOW w AS (PARTITION BY market ORDER BY day)) SELECT day, market, (m >= 0.05)::INT AS label FROM n WHERE nd - day BETWEEN 1 AND 2")(
    lambda s, d: bars_1d(s, d).withColumns({"nd": F.lead("day").over(w := Window.partitionBy("market").orderBy("day")), "m": F.lead("high").over(w) / F.lead("open").over(w) - 1}).where(F.datediff("nd", "day").between(1, 2)).withColumn("label", (F.col("m") >= 0.05).cast("int"))
)
query("l_12_forward_outcome", "entry_id:l market:s mfe:d mae:d eod:d net:d up1:l up2:l dn1:l dn3:l", f"{PATHS}, o AS (SELECT entry_id, any_value(market) AS market, max(high) / any_value(entry) - 1 AS mfe, min(low) / any_value(entry) - 1 AS mae, arg_max(close, idx) / any_value(entry) - 1 AS eod FROM pa GROUP BY entry_id) SELECT *, eod - 0.0015 AS net, (mfe >= 0.01)::INT AS up1, (mfe >= 0.02)::INT AS up2, (mae <= -0.01)::INT AS dn1, (mae <= -0.03)::INT AS dn3 FROM o")(
    lambda s, d: each(s, d, lambda q: p.outcomes(q))
)
query("l_13_first_passage", "entry_id:l side:s idx:l", f"{PATHS}, {FT.format(0.01, 0.015)} SELECT entry_id, CASE WHEN i_sl <= coalesce(i_tp, 999) THEN 'down' WHEN i_tp IS NOT NULL THEN 'up' ELSE 'none' END AS side, CASE WHEN i_sl <= coalesce(i_tp, 999) THEN i_sl ELSE i_tp END AS idx FROM ft")(
    lambda s, d: each(s, d, lambda q: p.first_touch(q, 0.01, 0.015)).withColumns({"side": F.when(F.col("reason") == "sl", "down").when(F.col("reason") == "tp", "up").otherwise("none"), "idx": F.when(F.col("reason") == "sl", F.col("i_sl")).otherwise(F.col("i_tp"))})
)
AT = "at_ AS (SELECT pa.*, greatest(0.005, least((first(high) OVER (PARTITION BY entry_id ORDER BY idx) - first(low) OVER (PARTITION BY entry_id ORDER BY idx)) / entry, 0.03)) AS b FROM pa)"
query("l_14_scaled_barriers", "entry_id:l reason:s", f"{PATHS}, {AT}, z AS (SELECT entry_id, min(CASE WHEN low <= entry * (1 - b) THEN idx END) AS i, min(CASE WHEN high >= entry * (1 + 2 * b) THEN idx END) AS j FROM at_ GROUP BY entry_id) SELECT entry_id, CASE WHEN i <= coalesce(j, 999) THEN 'sl' WHEN j IS NOT NULL THEN 'tp' ELSE 'eod' END AS reason FROM z")(
    lambda s, d: each(s, d, lambda q: p.first_touch(p.with_entry_price(q).withColumn("b", F.greatest(F.lit(0.005), F.least((F.first("high").over(p.path_window()) - F.first("low").over(p.path_window())) / F.col("entry"), F.lit(0.03)))), F.col("b"), 2 * F.col("b")))
)
query("l_16_barrier_quantiles", "q10:d q50:d q90:d extreme:l", f"{PATHS}, {AT}, z AS (SELECT entry_id, any_value(b) AS b FROM at_ GROUP BY entry_id) SELECT quantile_cont(b, 0.1) AS q10, quantile_cont(b, 0.5) AS q50, quantile_cont(b, 0.9) AS q90, sum((b >= 0.03)::INT) AS extreme FROM z")(
    lambda s, d: (z := each(s, d, lambda q: p.with_entry_price(q).groupBy("entry_id").agg(F.greatest(F.lit(0.005), F.least((F.min_by("high", "idx") - F.min_by("low", "idx")) / F.min_by("open", "idx"), F.lit(0.03))).alias("b")))).agg(F.sum((F.col("b") >= 0.03).cast("int")).alias("extreme")).crossJoin(r.quantiles(z, "b", {"q10": 0.1, "q50": 0.5, "q90": 0.9}))
)
