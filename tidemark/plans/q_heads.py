"""Queries: model heads, stores, and further evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import contracts as c
from tidemark.operators import evaluate as e
from tidemark.operators import features as f
from tidemark.operators import heads as h
from tidemark.operators import paths as p
from tidemark.operators import ranks as r
from tidemark.operators import selection as x
from tidemark.operators import splits as v
from tidemark.plans.duck import LEDGER, TRADES, intraday
from tidemark.plans.duck import lag as lg
from tidemark.plans.q_evaluate import DELTA, H, deltas, hy
from tidemark.plans.q_features import FLAG, SCORE, W
from tidemark.plans.q_paths import PATHS, each
from tidemark.plans.q_selection import HEADS, ranked, universe
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, bars_intraday, ledger, trades
from tidemark.sources.scratch import shared_path

FEATURES = ["r1", "r3", "r7", "s7", "lq"]
FOLDS = [("1997-01-01", "1997-01-06", "1998-01-01"), ("1998-01-01", "1998-01-06", "1999-01-01")]
L = f"WITH {LEDGER}"


def labelled(s, d):
    return universe(s, d).withColumn("y", (F.col("high") / F.col("open") - 1 >= 0.05).cast("double"))


query("h_02_dump_cutoff", "day:s market:s p:d dump:b")(
    lambda s, d: (m := h.fit_head((t := (u := labelled(s, d).withColumn("y", F.expr("double(close / open - 1 < -0.02)"))).where("day < date'1997-01-01'")), FEATURES, "y", "logistic")) is not None and h.predict(m, u.where("day >= date'1997-01-06'"), "p").crossJoin(F.broadcast(r.quantiles(h.predict(m, t, "p"), "p", {"cut": 0.6}))).withColumn("dump", F.col("p") > F.col("cut"))
)
query("h_03_walk_forward_heads", "fold:l day:s market:s p:d")(lambda s, d: h.walk_forward(labelled(s, d), FOLDS, FEATURES, "y", "p", "trees", iterations=5))
query("h_05_several_heads", "day:s market:s p_up:d p_down:d")(
    lambda s, d: h.predict(h.fit_head((u := labelled(s, d).withColumn("z", F.expr("double(low / open - 1 <= -0.05)"))).where("day < date'1997-01-01'"), FEATURES, "z", "logistic"), h.predict(h.fit_head(u.where("day < date'1997-01-01'"), FEATURES, "y", "logistic"), u.where("day >= date'1997-01-06'"), "p_up"), "p_down")
)
query("h_07_logistic_scorer", "day:s market:s p:d")(lambda s, d: h.walk_forward(labelled(s, d), FOLDS, FEATURES, "y", "p", "logistic"))
query("h_08_band_weights", "day:s market:s weight:d", f"{FLAG}, z AS (SELECT *, liq <= 5 AS band FROM o) SELECT day, market, CASE WHEN hit = 1 THEN count(*) OVER w / 2.0 / nullif(sum(hit) OVER w, 0) ELSE count(*) OVER w / 2.0 / nullif(count(*) OVER w - sum(hit) OVER w, 0) END AS weight FROM z WINDOW w AS (PARTITION BY band)")(
    lambda s, d: h.band_weights(labelled(s, d).withColumn("band", F.col("liq") <= 5), "band", "y")
)


def _json_round_trip(s, d):
    path = shared_path(s, "records")
    t = trades(s, d)
    t.select(F.lit("c1").alias("capture_id"), F.lit("trade").alias("channel"), "market", F.col("event_id").alias("ingress_seq"), F.col("received_ns").alias("received_at_ns"), (F.col("event_ns") / 1000000).cast("long").alias("event_at_ms"), F.lit("event").alias("record_type"), F.to_json(F.struct("price", "side")).alias("raw_payload")).write.option("compression", "gzip").json(path)
    from tidemark.streaming import flow

    return flow.raw_records(s, path).groupBy("market").agg(F.count("*").alias("n"), F.max("ingress_seq").alias("last_seq"), F.avg(F.from_json("raw_payload", "price double")["price"]).alias("mean_price"))


query("s_08_json_records", "market:s n:l last_seq:l mean_price:d", f"WITH {TRADES} SELECT market, count(*) AS n, max(event_id) AS last_seq, avg(price) AS mean_price FROM trades GROUP BY market")(_json_round_trip)


def _csv_union(s, d):
    path = shared_path(s, "ledgers")
    ledger(s, d).write.partitionBy("model_id").option("header", True).csv(path)
    back = s.read.schema("trade_id long, day date, coin string, status string, net_pct double, model_id string").option("header", True).csv(path)
    return back.groupBy("model_id", "status").agg(F.count("*").alias("n"), F.sum("net_pct").alias("net"))


query("s_11_csv_ledgers", "model_id:s status:s n:l net:d", f"{L} SELECT model_id, status, count(*) AS n, sum(net_pct) AS net FROM ledger GROUP BY ALL")(_csv_union)
query("s_12_append_new", "trade_id:l", f"{L} SELECT trade_id FROM ledger WHERE trade_id % 4 = 1")(lambda s, d: c.append_new((l := ledger(s, d)).where("trade_id % 4 != 1"), l.where("trade_id % 2 = 1"), ["trade_id"]))
query("s_13_write_once", "market:s n:l", f"{W} SELECT market, count(*) AS n FROM bars GROUP BY market")(lambda s, d: c.write_once(c.market_ranges(bars_1d(s, d)), path := shared_path(s, "snapshot")) and c.write_once(c.market_ranges(bars_1d(s, d)), path))


def _summary(s, d):
    path = shared_path(s, "summary")
    c.write_summary(e.policy_metrics(ledger(s, d), "model_id"), path)
    return s.read.parquet(f"{path}/parquet").select("model_id", "n").join(s.read.json(f"{path}/json").select("model_id", F.col("n").alias("n_json")), "model_id").join(s.read.option("header", True).csv(f"{path}/csv").select("model_id", F.col("n").cast("long").alias("n_csv")), "model_id")


query("s_15_summary_outputs", "model_id:s n:l n_json:l n_csv:l", f"{L} SELECT model_id, count(*) AS n, count(*) AS n_json, count(*) AS n_csv FROM ledger WHERE status = 'closed' GROUP BY model_id")(_summary)
query("f_28_ignition", "market:s session:s i:l ret:d", f"WITH {TRADES}, {intraday(240)}, z AS (SELECT *, (ts - INTERVAL 9 HOUR)::DATE AS session, row_number() OVER (PARTITION BY market, (ts - INTERVAL 9 HOUR)::DATE ORDER BY ts) AS i, first(open) OVER (PARTITION BY market, (ts - INTERVAL 9 HOUR)::DATE ORDER BY ts) AS o FROM ibars) SELECT market, session, i, close / o - 1 AS ret FROM z WHERE i <= 3")(
    lambda s, d: f.with_session(bars_intraday(s, d, 240)).withColumn("o", F.first("open").over(Window.partitionBy("market", "session").orderBy("ts"))).where("i <= 3").withColumn("ret", F.col("close") / F.col("o") - 1)
)
query("f_35_placeholder_day", "market:s f_close:d f_ret_3d:d", f"{W}, r AS (SELECT market, day, close, close / {lg('close', 3)} - 1 AS r3 FROM bars) SELECT market, arg_max(close, day) AS f_close, arg_max(r3, day) AS f_ret_3d FROM r GROUP BY market")(
    lambda s, d: (b := bars_1d(s, d).select("market", "day", "close", f.ret(3).alias("r3"))).unionByName(b.select("market").distinct().select("market", F.lit("9999-01-01").cast("date").alias("day"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("r3"))).withColumns({"f_close": f.lag("close"), "f_ret_3d": f.lag("r3")}).where("day = date'9999-01-01'")
)
query("l_03_path_label", "entry_id:l label:l", f"{PATHS}, z AS (SELECT entry_id, min(CASE WHEN low <= entry * (1 - 0.03) THEN idx END) AS i, min(CASE WHEN high >= entry * (1 + 0.02) THEN idx END) AS j FROM pa GROUP BY entry_id) SELECT entry_id, (j IS NOT NULL AND NOT coalesce(i <= j, false))::INT AS label FROM z")(
    lambda s, d: each(s, d, lambda q: p.first_touch(q, 0.03, 0.02)).withColumn("label", (F.col("reason") == "tp").cast("int"))
)
query("x_10_hold_hours", "reason:s n:l mean_hours:d", f"{PATHS}, z AS (SELECT entry_id, min(CASE WHEN low <= entry * (1 - 0.02) THEN idx END) AS i, min(CASE WHEN high >= entry * (1 + 0.02) THEN idx END) AS j, max(idx) AS m FROM pa GROUP BY entry_id), y AS (SELECT CASE WHEN i <= coalesce(j, 999) THEN 'sl' WHEN j IS NOT NULL THEN 'tp' ELSE 'eod' END AS reason, CASE WHEN i <= coalesce(j, 999) THEN i WHEN j IS NOT NULL THEN j ELSE m END AS k FROM z) SELECT reason, count(*) AS n, avg((k + 1) / 4.0) AS mean_hours FROM y GROUP BY reason")(
    lambda s, d: each(s, d, lambda q: p.first_touch(q, 0.02, 0.02).join(q.groupBy("entry_id").agg(F.max("idx").alias("m")), "entry_id")).withColumn("k", F.when(F.col("reason") == "sl", F.col("i_sl")).when(F.col("reason") == "tp", F.col("i_tp")).otherwise(F.col("m"))).groupBy("reason").agg(F.count("*").alias("n"), F.avg((F.col("k") + 1) / 4).alias("mean_hours"))
)
query("x_13_residual_day", "entry_id:l residual:d", f"{PATHS} SELECT entry_id, arg_max(close, idx) / arg_min(CASE WHEN idx >= 8 THEN open END, CASE WHEN idx >= 8 THEN idx END) - 1 AS residual FROM pa GROUP BY entry_id")(
    lambda s, d: each(s, d, lambda q: q.groupBy("entry_id").agg((F.max_by("close", "idx") / F.min_by("open", F.when(F.col("idx") >= 8, F.col("idx"))) - 1).alias("residual")))
)
query("x_17_cost_sweep", "cost:d net:d positive:d", f"{L} SELECT cost, avg(net_pct - cost) AS net, avg((net_pct > cost)::INT) AS positive FROM ledger, (VALUES (0.0), (0.15), (0.5)) v(cost) WHERE status = 'closed' GROUP BY cost")(
    lambda s, d: ledger(s, d).where("status = 'closed'").withColumn("cost", F.explode(F.array(F.lit(0.0), F.lit(0.15), F.lit(0.5)))).groupBy("cost").agg(F.avg(F.col("net_pct") - F.col("cost")).alias("net"), F.avg((F.col("net_pct") > F.col("cost")).cast("int")).alias("positive"))
)
query("x_29_rule_backtest", "rule:s day:s equity:d", f"{HEADS}, z AS (SELECT rule, day, avg(CASE WHEN low / open - 1 <= -sl THEN -sl WHEN high / open - 1 >= tp THEN tp ELSE close / open - 1 END - 0.0015) AS ret FROM d1, (VALUES ('tight', 0.03, 0.05), ('wide', 0.06, 0.1)) v(rule, sl, tp) WHERE rk <= 3 GROUP BY rule, day) SELECT rule, day, exp(sum(ln(1 + ret)) OVER (PARTITION BY rule ORDER BY day)) AS equity FROM z")(
    lambda s, d: ranked(s, d).where("rk <= 3").withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(a).alias("sl"), F.lit(b).alias("tp")) for n, a, b in (("tight", 0.03, 0.05), ("wide", 0.06, 0.1))]))).withColumn("g", F.expr("case when low / open - 1 <= -v.sl then -v.sl when high / open - 1 >= v.tp then v.tp else close / open - 1 end") - 0.0015).groupBy("v.rule", "day").agg(F.avg("g").alias("ret")).withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(Window.partitionBy("rule").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))))
)
query("a_03_fold_lift", "fold:l n:l precision:d lift:d", f"{FLAG}, fo(fold, a, b) AS (VALUES (0, DATE '1997-01-01', DATE '1998-01-01'), (1, DATE '1998-01-01', DATE '1999-01-01')), q AS (SELECT fold, a, b, quantile_cont(score, 0.9) AS c FROM o JOIN fo ON o.day < a GROUP BY ALL) SELECT fold, sum((score >= c)::INT) AS n, avg(CASE WHEN score >= c THEN hit END) AS precision, avg(CASE WHEN score >= c THEN hit END) / avg(hit) AS lift FROM o JOIN q ON o.day >= a AND o.day < b GROUP BY fold")(
    lambda s, d: (u := labelled(s, d)) is not None and _fold_lift(u, [(0, "1997-01-01", "1998-01-01"), (1, "1998-01-01", "1999-01-01")])
)


def _fold_lift(rows, folds):
    one = [F.struct(F.lit(k).alias("fold"), (F.col("day") < F.lit(a).cast("date")).alias("train"), ((F.col("day") >= F.lit(a).cast("date")) & (F.col("day") < F.lit(b).cast("date"))).alias("test")) for k, a, b in folds]
    tagged = rows.select("score", "y", F.explode(F.array(*one)).alias("f")).select("score", "y", "f.*")
    cuts = r.quantiles(tagged.where("train"), "score", {"c": 0.9}, "fold")
    return tagged.where("test").join(F.broadcast(cuts), "fold").groupBy("fold").agg(F.sum((F.col("score") >= F.col("c")).cast("int")).alias("n"), F.avg(F.when(F.col("score") >= F.col("c"), F.col("y"))).alias("precision"), F.avg("y").alias("base")).withColumn("lift", F.try_divide("precision", "base"))


query("a_33_hit_timing", "level:d hits:l share:d median:d p75:d", f"{PATHS}, z AS (SELECT entry_id, lv AS level, min(CASE WHEN high >= entry * (1 + lv) THEN idx END) * 15 AS m FROM pa, (VALUES (0.01), (0.02)) v(lv) GROUP BY entry_id, lv) SELECT level, count(m) AS hits, count(m) / count(*)::DOUBLE AS share, quantile_cont(m, 0.5) AS median, quantile_cont(m, 0.75) AS p75 FROM z GROUP BY level")(
    lambda s, d: each(s, d, lambda q: p.with_entry_price(q).groupBy("entry_id").agg(*[F.min(F.when(F.col("high") >= F.col("entry") * (1 + F.lit(lv)), F.col("idx") * 15)).alias(f"m{i}") for i, lv in enumerate((0.01, 0.02))])).selectExpr("stack(2, 0.01D, m0, 0.02D, m1) as (level, m)").groupBy("level").agg(F.count("m").alias("hits"), (F.count("m") / F.count("*")).alias("share"), F.percentile("m", 0.5).alias("median"), F.percentile("m", 0.75).alias("p75"))
)
query("a_43_case_study", "day:s market:s prev_surge:d prev_rank:l", f"{W}, {SCORE}, ev AS (SELECT day, market FROM bars WHERE high / open - 1 >= 0.18) SELECT ev.day, ev.market, sc.s7 AS prev_surge, sc.liq AS prev_rank FROM ev LEFT JOIN sc ON sc.day = ev.day AND sc.market = ev.market")(
    lambda s, d: bars_1d(s, d).where("high / open - 1 >= 0.18").select("day", "market").join(r.scored(bars_1d(s, d)).select("day", "market", F.col("s7").alias("prev_surge"), F.col("liq").alias("prev_rank")), ["day", "market"], "left")
)
query("a_46_decay_curve", "horizon:s mean_max:d mean_close:d", f"{PATHS}, z AS (SELECT entry_id, hz AS horizon, max(CASE WHEN idx < k THEN high END) / any_value(entry) - 1 AS mx, arg_max(CASE WHEN idx < k THEN close END, CASE WHEN idx < k THEN idx END) / any_value(entry) - 1 AS c FROM pa, (VALUES ('1h', 4), ('4h', 16), ('24h', 96)) v(hz, k) GROUP BY entry_id, hz) SELECT horizon, avg(mx) AS mean_max, avg(c) AS mean_close FROM z GROUP BY horizon")(
    lambda s, d: each(s, d, lambda q: p.with_entry_price(q).groupBy("entry_id").agg(*[F.struct(F.lit(n).alias("horizon"), (F.max(F.when(F.col("idx") < k, F.col("high"))) / F.first("entry") - 1).alias("mx"), (F.max_by("close", F.when(F.col("idx") < k, F.col("idx"))) / F.first("entry") - 1).alias("c")).alias(f"h{k}") for n, k in (("1h", 4), ("4h", 16), ("24h", 96))])).select(F.explode(F.array("h4", "h16", "h96")).alias("z")).groupBy("z.horizon").agg(F.avg("z.mx").alias("mean_max"), F.avg("z.c").alias("mean_close"))
)
query("a_49_decision_outcomes", "decision:s n:l next_ret:d", f"{HEADS}, nx AS (SELECT day, market, lead(close) OVER (PARTITION BY market ORDER BY day) / close - 1 AS nr FROM bars) SELECT CASE WHEN dump THEN 'silent' WHEN rk <= 3 THEN 'sent' ELSE 'watched' END AS decision, count(*) AS n, avg(nr) AS next_ret FROM d1 JOIN nx ON nx.day = d1.day AND nx.market = d1.market GROUP BY 1")(
    lambda s, d: ranked(s, d).join(bars_1d(s, d).select("day", "market", (F.lead("close").over(Window.partitionBy("market").orderBy("day")) / F.col("close") - 1).alias("nr")), ["day", "market"]).groupBy(F.when(F.col("dump"), "silent").when(F.col("rk") <= 3, "sent").otherwise("watched").alias("decision")).agg(F.count("*").alias("n"), F.avg("nr").alias("next_ret"))
)
query("a_51_joint_review", "mean_delta:d early:d late:d worst_without:d joint:b", f"{DELTA}, n AS (SELECT *, ntile(2) OVER (ORDER BY day) AS h, (sum(delta) OVER () - delta) / (count(*) OVER () - 1) AS wo FROM de), g AS (SELECT avg(delta) AS mean_delta, avg(CASE WHEN h = 1 THEN delta END) AS early, avg(CASE WHEN h = 2 THEN delta END) AS late, min(wo) AS worst_without FROM n) SELECT *, mean_delta > 0 AND early > 0 AND late > 0 AND worst_without > 0 AS joint FROM g")(
    lambda s, d: e.leave_one_out(deltas(s, d), "day", "delta").withColumn("h", F.ntile(2).over(Window.orderBy("day"))).agg(F.avg("delta").alias("mean_delta"), F.avg(F.when(F.col("h") == 1, F.col("delta"))).alias("early"), F.avg(F.when(F.col("h") == 2, F.col("delta"))).alias("late"), F.min("without").alias("worst_without")).withColumn("joint", F.expr("mean_delta > 0 and early > 0 and late > 0 and worst_without > 0"))
)
query("a_57_leaderboard", "model_id:s place:l net_mean:d", f"{L}, g AS (SELECT model_id, avg(net_pct) AS net_mean, count(*) AS n FROM ledger WHERE status = 'closed' GROUP BY model_id) SELECT model_id, rank() OVER (ORDER BY round(net_mean, 9) DESC) AS place, net_mean FROM g")(
    lambda s, d: e.policy_metrics(ledger(s, d), "model_id").withColumn("place", F.rank().over(Window.orderBy(F.round("net_mean", 9).desc())))
)
query("v_09_strategy_vs_universe", "context:s days:l edge:d", f"{H}, g AS (SELECT day, avg(CASE WHEN rk <= 3 THEN ret END) - avg(ret) AS edge, CASE WHEN avg((ret > 0)::INT) >= 0.5 THEN 'up' ELSE 'down' END AS context FROM y GROUP BY day) SELECT context, count(*) AS days, avg(edge) AS edge FROM g GROUP BY context")(
    lambda s, d: hy(s, d).groupBy("day").agg((F.avg(F.when(F.col("rk") <= 3, F.col("ret"))) - F.avg("ret")).alias("edge"), F.when(F.avg((F.col("ret") > 0).cast("int")) >= 0.5, "up").otherwise("down").alias("context")).groupBy("context").agg(F.count("*").alias("days"), F.avg("edge").alias("edge"))
)
query("v_10_veto_backfill", "day:s market:s rk2:l", f"{HEADS}, fa AS (SELECT least(greatest(avg((low / open - 1 <= -0.05)::INT) / avg(p_dn5), 0.25), 4) AS k FROM d1 WHERE day < DATE '1998-01-01'), z AS (SELECT d1.*, p_dn5 * k > 0.2 AS veto FROM d1, fa), y AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY veto::INT, rk) AS slot FROM z) SELECT day, market, row_number() OVER (PARTITION BY day ORDER BY rk) AS rk2 FROM y WHERE slot <= 3")(
    lambda s, d: (q := ranked(s, d)).crossJoin(F.broadcast(q.where("day < date'1998-01-01'").agg(F.least(F.greatest(F.avg((F.col("low") / F.col("open") - 1 <= -0.05).cast("int")) / F.avg("p_dn5"), F.lit(0.25)), F.lit(4.0)).alias("k")))).withColumn("dump", F.col("p_dn5") * F.col("k") > 0.2).transform(lambda z: x.reselect(z, 3))
)
query("v_13_threshold_sweep", "threshold:d cap:l n:l hit:d accepted:b", f"{H}, g AS (SELECT threshold, cap, y, row_number() OVER (PARTITION BY threshold, cap, day ORDER BY p_up10 DESC, market) AS i FROM y, (VALUES (0.1), (0.2), (0.3)) a(threshold), (VALUES (1), (3)) b(cap) WHERE p_up10 >= threshold), k AS (SELECT threshold, cap, count(*) AS n, avg(y) AS hit FROM g WHERE i <= cap GROUP BY ALL) SELECT *, n >= 100 AND hit > 0.2 AS accepted FROM k".replace("threshold, cap, y,", "threshold, cap, y.y,"))(
    lambda s, d: hy(s, d).withColumn("g", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(k).alias("cap")) for t in (0.1, 0.2, 0.3) for k in (1, 3)]))).select("*", "g.threshold", "g.cap").where("p_up10 >= threshold").withColumn("i", F.row_number().over(Window.partitionBy("threshold", "cap", "day").orderBy(F.desc("p_up10"), "market"))).where("i <= cap").groupBy("threshold", "cap").agg(F.count("*").alias("n"), F.avg("y").alias("hit")).withColumn("accepted", F.expr("n >= 100 and hit > 0.2"))
)
query("v_20_plan_then_outcome", "status:s n:l", f"{HEADS}, pl AS (SELECT day, market FROM d1 WHERE rk <= 3), oc AS (SELECT day, market, close / open - 1 AS ret FROM bars WHERE day < DATE '1998-06-01' AND trades > 1) SELECT CASE WHEN pl.day >= DATE '1998-06-01' THEN 'pending' WHEN ret IS NULL THEN 'excluded' ELSE 'comparable' END AS status, count(*) AS n FROM pl LEFT JOIN oc ON oc.day = pl.day AND oc.market = pl.market GROUP BY 1")(
    lambda s, d: c.write_once(ranked(s, d).where("rk <= 3").select("day", "market"), shared_path(s, "plan")).join(bars_1d(s, d).where("day < date'1998-06-01' and trades > 1").select("day", "market", (F.col("close") / F.col("open") - 1).alias("ret")), ["day", "market"], "left").groupBy(F.when(F.col("day") >= F.lit("1998-06-01").cast("date"), "pending").when(F.col("ret").isNull(), "excluded").otherwise("comparable").alias("status")).agg(F.count("*").alias("n"))
)
query("b_07_high_minus_low", "low:d mid:d high:d reps:l", f"{H}, dn AS (SELECT day, avg(CASE WHEN rk <= 3 THEN ret END) - avg(CASE WHEN rk > 3 THEN ret END) AS x FROM y GROUP BY day HAVING sum((rk > 3)::INT) > 0), ix AS (SELECT x, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM dn), dr AS (SELECT rep, ('0x' || substr(md5('9|' || rep::VARCHAR || '|' || k::VARCHAR), 1, 12))::BIGINT % n AS i FROM range(100) a(rep), (SELECT i AS k, n FROM ix)), re AS (SELECT rep, avg(x) AS mean FROM dr JOIN ix USING (i) GROUP BY rep) SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.5) AS mid, quantile_cont(mean, 0.975) AS high, count(*) AS reps FROM re")(
    lambda s, d: v.interval(v.bootstrap(hy(s, d).groupBy("day").agg((F.avg(F.when(F.col("rk") <= 3, F.col("ret"))) - F.avg(F.when(F.col("rk") > 3, F.col("ret")))).alias("x")).where("x is not null"), "x", 100, 9))
)
