"""Queries: fold dates, regime-split ranking, target windows, thresholds from inner blocks, realized columns, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import features as f
from tidemark.operators import heads as h
from tidemark.operators import notices
from tidemark.operators import paths as p
from tidemark.operators import ranks as r
from tidemark.operators import selection as x
from tidemark.plans.duck import LEDGER, TRADES
from tidemark.plans.q_evaluate import H, hy
from tidemark.plans.q_features import REGIME, W
from tidemark.plans.q_heads import FEATURES, labelled
from tidemark.plans.q_paths import PATHS, each
from tidemark.plans.q_selection import CELLS, HEADS, cells, ranked, universe
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, ledger, trades
from tidemark.sources.scratch import shared_path
from tidemark.streaming import flow

SPLIT = "date'1998-01-01'"


def with_regime(s, d, rows: DataFrame) -> DataFrame:
    regime = f.regime(bars_1d(s, d).where("market = 'M00'")).select("day", F.col("btc_regime").alias("regime"))
    return rows.join(regime, "day", "left").withColumn("regime", F.coalesce("regime", F.lit("none")))


# rows whose day is one of a fold's days
def fold_rows(s, d):
    days = universe(s, d).select("day").distinct().where("year(day) = 1997 and day(day) % 2 = 0")
    return universe(s, d).join(F.broadcast(days), "day", "left_semi").groupBy("market").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


query(
    "j_11_fold_rows", "market:s n:l first:s last:s",
    f"""{HEADS}, days AS (SELECT DISTINCT day FROM uni WHERE year(day) = 1997 AND day(day) % 2 = 0)
 SELECT market, count(*) AS n, min(day) AS first, max(day) AS last FROM uni WHERE day IN (SELECT day FROM days) GROUP BY market""",
)(fold_rows)


# splits over the days on which the benchmark's path is complete: it has a bar on the day and on the next one
def complete_splits(s, d):
    bench = bars_1d(s, d).where("market = 'M00'").select("day")
    complete = bench.join(bench.select(F.date_sub("day", 1).alias("day")), "day", "left_semi")
    numbered = complete.withColumns({"i": F.row_number().over(Window.orderBy("day")) - 1, "n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    folds = numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("start", F.floor(F.col("n") * F.col("fold") / 5))
    stop, embargo = F.floor(F.col("n") * (F.col("fold") + 1) / 5), 2
    return folds.groupBy("fold").agg(F.sum((F.col("i") < F.col("start") - embargo).cast("int")).alias("train_days"), F.sum(((F.col("i") >= F.col("start")) & (F.col("i") < stop)).cast("int")).alias("test_days"))


query(
    "v_22_complete_splits", "fold:l train_days:l test_days:l",
    f"""{W}, b AS (SELECT day FROM bars WHERE market = 'M00'), c AS (SELECT day FROM b WHERE day + 1 IN (SELECT day FROM b)),
 k AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM c)
 SELECT fold, sum((i < floor(n * fold / 5.0) - 2)::INT) AS train_days, sum((i >= floor(n * fold / 5.0) AND i < floor(n * (fold + 1) / 5.0))::INT) AS test_days
 FROM k, range(1, 5) t(fold) GROUP BY fold""",
)(complete_splits)


# operating thresholds: scores of each inner block are scaled by what earlier blocks taught, their high quantiles become cuts
def inner_thresholds(s, d):
    train = hy(s, d).where(f"day < {SPLIT}")
    blocks = train.select("day").distinct().withColumn("block", F.ntile(4).over(Window.orderBy("day")))
    train = train.join(F.broadcast(blocks), "day")
    taught = train.groupBy("block").agg(F.sum("y").alias("ys"), F.sum("p_up10").alias("ps"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scale = taught.select("block", F.try_divide(F.sum("ys").over(earlier), F.sum("ps").over(earlier)).alias("k")).where("k is not null")
    scaled = train.join(F.broadcast(scale), "block")
    cuts = r.quantiles(scaled, F.col("p_up10") * F.col("k"), {"c0": 0.999, "c1": 0.9995}).crossJoin(scale.agg(F.max_by("k", "block").alias("k")))
    levels = cuts.selectExpr("k", "stack(2, 0.999D, c0, 0.9995D, c1) as (level, cut)")
    test = hy(s, d).where(f"day >= {SPLIT}").select("p_up10", "y")
    over = (F.round(F.col("p_up10") * F.col("k"), 9) >= F.round("cut", 9)).cast("int")
    return test.crossJoin(F.broadcast(levels)).groupBy("level", "cut").agg(F.sum(over).alias("n"), F.sum(over * F.col("y")).alias("hits"))


query(
    "v_23_operating_threshold", "level:d cut:d n:l hits:l",
    f"""{H}, bl AS (SELECT day, ntile(4) OVER (ORDER BY day) AS block FROM (SELECT DISTINCT day FROM y WHERE day < DATE '1998-01-01')),
 tr AS (SELECT y.*, block FROM y JOIN bl ON bl.day = y.day), ta AS (SELECT block, sum(y) AS ys, sum(p_up10) AS ps FROM tr GROUP BY block),
 sk AS (SELECT block, sum(ys) OVER w / sum(ps) OVER w AS k FROM ta WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 oo AS (SELECT tr.p_up10 * k AS o, k, tr.block FROM tr JOIN sk ON sk.block = tr.block WHERE k IS NOT NULL),
 cu AS (SELECT 0.999::DOUBLE AS level, quantile_cont(o, 0.999) AS cut, arg_max(k, block) AS k FROM oo UNION ALL SELECT 0.9995::DOUBLE, quantile_cont(o, 0.9995), arg_max(k, block) FROM oo)
 SELECT level, cut, sum((round(p_up10 * k, 9) >= round(cut, 9))::INT) AS n, sum((round(p_up10 * k, 9) >= round(cut, 9))::INT * y.y) AS hits FROM y, cu WHERE day >= DATE '1998-01-01' GROUP BY level, cut""",
)(inner_thresholds)

KEYS = {"rr": "rr", "score": "round(score, 9)", "safe": "-p_dn5"}


# regime-split ranking: for each fold (a year) and regime the sort key that did best in earlier folds
def regime_split(s, d):
    rows = with_regime(s, d, hy(s, d)).withColumn("fold", F.year("day"))
    keyed = rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.expr(c).cast("double").alias("value")) for k, c in KEYS.items()])).alias("e")).select("*", "e.key", "e.value")
    top = keyed.withColumn("i", F.row_number().over(Window.partitionBy("key", "day").orderBy(F.desc("value"), "market"))).where("i <= 3")
    per = top.groupBy("fold", "regime", "key").agg(
        F.count("*").alias("n"), F.sum((F.col("low") / F.col("open") - 1 <= -0.03).cast("int")).alias("stops"),
        F.sum((F.col("ret") <= -0.05).cast("int")).alias("deep"), F.sum(F.round("ret", 9)).alias("net"),
    )
    folds = rows.select("fold", "regime").distinct()
    earlier = folds.join(per.withColumnRenamed("fold", "before"), "regime").where("before < fold")
    past = earlier.groupBy("fold", "regime", "key").agg(*[F.sum(c).alias(c) for c in ("n", "stops", "deep", "net")])
    order = F.struct(F.round(F.col("stops") / F.col("n"), 9), F.round(F.col("deep") / F.col("n"), 9), -F.round(F.col("net") / F.col("n"), 6), "key")
    best = past.where("n >= 60").groupBy("fold", "regime").agg(F.min_by(F.struct("key", "n", (F.col("net") / F.col("n")).alias("mean")), order).alias("b"))
    chosen = folds.join(best, ["fold", "regime"], "left")
    return chosen.select("fold", "regime", F.coalesce("b.key", F.lit("rr")).alias("key"), F.coalesce(F.col("b.n"), F.lit(0)).alias("n_train"), F.coalesce(F.round("b.mean", 6) < -0.001, F.lit(False)).alias("abstain"))


query(
    "v_11_regime_split_ranking", "fold:l regime:s key:s n_train:l abstain:b",
    f"""{H}, {REGIME}, z AS (SELECT y.*, coalesce(btc_regime, 'none') AS regime, year(y.day) AS fold FROM y LEFT JOIN regime ON regime.day = y.day),
 ky AS ({" UNION ALL ".join(f"SELECT *, '{k}' AS key, ({c})::DOUBLE AS value FROM z" for k, c in KEYS.items())}),
 tp AS (SELECT *, row_number() OVER (PARTITION BY key, day ORDER BY value DESC, market) AS i FROM ky),
 pe AS (SELECT fold, regime, key, count(*) AS n, sum((low / open - 1 <= -0.03)::INT) AS stops, sum((ret <= -0.05)::INT) AS deep, sum(round(ret, 9)) AS net FROM tp WHERE i <= 3 GROUP BY ALL),
 fo AS (SELECT DISTINCT fold, regime FROM z),
 pa AS (SELECT fo.fold, fo.regime, key, sum(n) AS n, sum(stops) AS stops, sum(deep) AS deep, sum(net) AS net FROM fo JOIN pe ON pe.regime = fo.regime AND pe.fold < fo.fold GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY fold, regime ORDER BY round(stops / n, 9), round(deep / n, 9), -round(net / n, 6), key) AS i FROM pa WHERE n >= 60)
 SELECT fo.fold, fo.regime, coalesce(key, 'rr') AS key, coalesce(n, 0) AS n_train, coalesce(round(net / n, 6) < -0.001, false) AS abstain FROM fo LEFT JOIN rk ON rk.fold = fo.fold AND rk.regime = fo.regime AND i = 1""",
)(regime_split)


# target windows: the picks' return over one, two and three bars against the mean of the pool of their liquidity cell
def with_windows(s, d, rows: DataFrame) -> DataFrame:
    ahead = Window.partitionBy("market").orderBy("day")
    bars = bars_1d(s, d).select("day", "market", *[F.lead(F.struct("day", "close"), k - 1).over(ahead).alias(f"w{k}") for k in (1, 2, 3)])
    arms = F.array(*[F.struct(F.lit(k).alias("arm"), F.col(f"w{k}.day").alias("end"), F.col(f"w{k}.close").alias("last")) for k in (1, 2, 3)])
    return rows.join(bars, ["day", "market"], "left").withColumn("a", F.explode(arms)).select("*", "a.arm", "a.end", "a.last").drop("a")


WINDOWS = "nx AS (SELECT day, market, {0} FROM bars WINDOW w AS (PARTITION BY market ORDER BY day))".format(", ".join(f"lead(day, {k - 1}) OVER w AS e{k}, lead(close, {k - 1}) OVER w AS c{k}" for k in (1, 2, 3)))
ARMS = " UNION ALL ".join(f"SELECT q.*, {k} AS arm, e{k} AS end_, c{k} AS last FROM q LEFT JOIN nx USING (day, market)" for k in (1, 2, 3))


def window_arms(s, d):
    rows = with_windows(s, d, cells(s, d)).withColumn("ret", F.col("last") / F.col("open") - 1).where("ret is not null")
    pool = rows.where("rk > 3").groupBy("arm", "day", "lq4").agg(F.avg("ret").alias("pool"))
    return rows.where("rk <= 3").join(pool, ["arm", "day", "lq4"]).groupBy("arm").agg(F.countDistinct("day").alias("days"), F.count("*").alias("n"), F.avg(F.col("ret") - F.col("pool")).alias("delta"))


query(
    "v_18_matched_windows", "arm:l days:l n:l delta:d",
    f"""{CELLS}, {WINDOWS}, q AS (SELECT * FROM ce), ar AS (SELECT *, last / open - 1 AS ret FROM ({ARMS}) WHERE last IS NOT NULL),
 po AS (SELECT arm, day, lq4, avg(ret) AS pool FROM ar WHERE rk > 3 GROUP BY ALL)
 SELECT ar.arm, count(DISTINCT ar.day) AS days, count(*) AS n, avg(ret - pool) AS delta FROM ar JOIN po ON po.arm = ar.arm AND po.day = ar.day AND po.lq4 = ar.lq4 WHERE rk <= 3 GROUP BY ar.arm""",
)(window_arms)


# coverage of decision rows by each target window: it ends within as many days, later, or not yet
def window_coverage(s, d):
    rows = with_windows(s, d, ranked(s, d).select("day", "market"))
    reason = F.when(F.col("end").isNull(), "open_end").when(F.datediff("end", "day") > F.col("arm") - 1, "gap").otherwise("covered")
    return rows.groupBy("arm", reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("market").alias("markets"))


query(
    "v_19_coverage_audit", "arm:l reason:s n:l markets:l",
    f"""{HEADS}, {WINDOWS}, q AS (SELECT day, market FROM d1), ar AS ({ARMS})
 SELECT arm, CASE WHEN end_ IS NULL THEN 'open_end' WHEN end_ - day > arm - 1 THEN 'gap' ELSE 'covered' END AS reason, count(*) AS n, count(DISTINCT market) AS markets FROM ar GROUP BY 1, 2""",
)(window_coverage)


# the pre-open channel, demoted or not
def preopen(s, d):
    rows = with_regime(s, d, ranked(s, d)).withColumn("composite", F.col("rr") + F.col("score"))
    return x.preopen_policy(rows, "p_up10", "composite", demoted=True).withColumn("demoted", F.lit(True)).unionByName(
        x.preopen_policy(rows, "p_up10", "composite", demoted=False).withColumn("demoted", F.lit(False))
    ).groupBy("demoted", "decision", "blocked_reason").agg(F.count("*").alias("n"), F.avg("edge_pct").alias("edge"))


query(
    "p_12_preopen_decision", "demoted:b decision:s blocked_reason:s n:l edge:d",
    f"""{HEADS}, {REGIME}, z AS (SELECT d1.*, coalesce(btc_regime, 'none') AS regime, rr + score AS composite, (least(greatest(p_up10, 0), 1) * 5.0 - (1 - least(greatest(p_up10, 0), 1)) * 3.0 - 0.15) AS e FROM d1 LEFT JOIN regime ON regime.day = d1.day),
 y AS (SELECT demoted, CASE WHEN regime = 'bear_volatile' THEN 'btc_bear_volatile' WHEN demoted THEN 'preopen_demoted' WHEN regime = 'bear_quiet' THEN 'bear_quiet_watch'
  WHEN round(composite, 9) >= 1.5 AND p_up10 >= 0.35 THEN '' ELSE 'preopen_threshold_watch' END AS blocked_reason, e FROM z, (VALUES (true), (false)) v(demoted))
 SELECT demoted, CASE blocked_reason WHEN 'btc_bear_volatile' THEN 'SILENCE' WHEN '' THEN 'ACTIVE' ELSE 'WATCH_ONLY' END AS decision, blocked_reason, count(*) AS n, avg(e) AS edge FROM y GROUP BY ALL""",
)(preopen)


# base rate of each regime, and the lift of the best three scores inside it
def regime_lift(s, d):
    rows = with_regime(s, d, hy(s, d)).withColumn("best", F.row_number().over(x.day_window().orderBy(F.round("score", 9).desc(), "market")) <= 3)
    return rows.groupBy("regime").agg(F.count("*").alias("n"), F.avg("y").alias("rate"), F.try_divide(F.avg(F.when(F.col("best"), F.col("y"))), F.avg("y")).alias("lift"))


query(
    "a_31_regime_base_rates", "regime:s n:l rate:d lift:d",
    f"""{H}, {REGIME}, z AS (SELECT y.*, coalesce(btc_regime, 'none') AS regime, row_number() OVER (PARTITION BY y.day ORDER BY round(score, 9) DESC, market) <= 3 AS best FROM y LEFT JOIN regime ON regime.day = y.day)
 SELECT regime, count(*) AS n, avg(y) AS rate, avg(CASE WHEN best THEN y END) / avg(y) AS lift FROM (SELECT regime, best, z.y AS y FROM z) GROUP BY regime""",
)(regime_lift)


# two pick lists of a day: names in both, and the rank correlation of the two orders among these
def list_overlap(s, d):
    both = ranked(s, d).withColumn("rs", F.row_number().over(x.day_window().orderBy(F.round("score", 9).desc(), "market"))).where("rk <= 5 and rs <= 5")
    placed = both.select("day", *[F.row_number().over(x.day_window().orderBy(c)).alias(a) for c, a in (("rk", "i"), ("rs", "j"))])
    n, gaps = F.count("*"), F.sum((F.col("i") - F.col("j")) ** 2)
    return placed.groupBy("day").agg(n.alias("overlap"), F.when(n > 1, 1 - 6 * gaps / (n * (n * n - 1))).alias("spearman"))


query(
    "a_42_list_overlap", "day:s overlap:l spearman:d",
    f"""{HEADS}, b AS (SELECT day, rk, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, market) AS rs FROM d1),
 c AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY rk) AS i, row_number() OVER (PARTITION BY day ORDER BY rs) AS j FROM b WHERE rk <= 5 AND rs <= 5)
 SELECT day, count(*) AS overlap, CASE WHEN count(*) > 1 THEN 1 - 6 * sum((i - j) * (i - j)) / (count(*) * (count(*) * count(*) - 1))::DOUBLE END AS spearman FROM c GROUP BY day""",
)(list_overlap)


# realized columns of entries: the first hour and the whole path
def realized(s, d):
    out = []
    for name, k in (("1h", 4), ("24h", 96)):
        inside = F.col("idx") < k
        out += [(F.max(F.when(inside, F.col("high"))) / F.first("entry") - 1).alias(f"max_{name}"), (F.min(F.when(inside, F.col("low"))) / F.first("entry") - 1).alias(f"min_{name}"), (F.max_by("close", F.when(inside, F.col("idx"))) / F.first("entry") - 1).alias(f"close_{name}")]
    return each(s, d, lambda q: p.with_entry_price(q).groupBy("entry_id").agg(*out))


query(
    "x_21_realized_columns", "entry_id:l max_1h:d min_1h:d close_1h:d max_24h:d min_24h:d close_24h:d",
    PATHS + " SELECT entry_id, " + ", ".join(f"max(CASE WHEN idx < {k} THEN high END) / any_value(entry) - 1 AS max_{n}, min(CASE WHEN idx < {k} THEN low END) / any_value(entry) - 1 AS min_{n}, arg_max(close, CASE WHEN idx < {k} THEN idx END) / any_value(entry) - 1 AS close_{n}" for n, k in (("1h", 4), ("24h", 96))) + " FROM pa GROUP BY entry_id",
)(realized)


# exit variants of rows that are closed already, from the bar of their day: the stop wins a shared bar
def exit_columns(s, d):
    rows = ledger(s, d).where("status = 'closed'").join(bars_1d(s, d).select(F.col("market").alias("coin"), "day", "open", "high", "low", "close"), ["coin", "day"], "left")
    net = lambda sl, tp: F.when(F.col("low") <= F.col("open") * (1 - sl), -sl).when(F.col("high") >= F.col("open") * (1 + tp), tp).otherwise(F.col("close") / F.col("open") - 1) * 100 - 0.15
    return rows.select("trade_id", "net_pct", net(0.03, 0.05).alias("tight"), net(0.05, 0.1).alias("wide"), net(1.0, 9.0).alias("hold"))


query(
    "x_25_exit_columns", "trade_id:l net_pct:d tight:d wide:d hold:d",
    f"WITH {LEDGER}, {W[5:]} SELECT trade_id, net_pct, "
    + ", ".join(f"CASE WHEN low <= open * (1 - {sl}) THEN -{sl} WHEN high >= open * (1 + {tp}) THEN {tp} ELSE close / open - 1 END * 100 - 0.15 AS {n}" for n, sl, tp in (("tight", 0.03, 0.05), ("wide", 0.05, 0.1), ("hold", 1.0, 9.0)))
    + " FROM ledger l LEFT JOIN bars b ON b.market = l.coin AND b.day = l.day WHERE status = 'closed'",
)(exit_columns)


# raw envelopes read as a stream, by channel
def channels(s, d):
    source, sink = shared_path(s, "envelopes"), shared_path(s, "channels")
    t = trades(s, d)
    t.select(
        F.lit("c1").alias("capture_id"), F.when(F.col("side") == "BID", "trade").otherwise("orderbook").alias("channel"), "market", F.col("event_id").alias("ingress_seq"), F.col("received_ns").alias("received_at_ns"),
        (F.col("event_ns") / 1000000).cast("long").alias("event_at_ms"), F.lit("event").alias("record_type"), F.to_json(F.struct("price", "side")).alias("raw_payload"),
    ).write.json(source)
    stream = flow.raw_records(s, source, stream=True).select("channel", "market", "ingress_seq")
    stream.writeStream.format("parquet").option("checkpointLocation", shared_path(s, "progress")).option("path", sink).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(sink).groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("market").alias("markets"), F.max("ingress_seq").alias("last_seq"))


query(
    "t_01_channels", "channel:s n:l markets:l last_seq:l",
    f"WITH {TRADES} SELECT CASE side WHEN 'BID' THEN 'trade' ELSE 'orderbook' END AS channel, count(*) AS n, count(DISTINCT market) AS markets, max(event_id) AS last_seq FROM trades GROUP BY 1",
)(channels)


# notices of an end of trading, one for each day and coin of the ledger, and whether one holds for each open trade
def titles(s, d):
    rows = ledger(s, d).groupBy("coin", "day").agg(F.max_by("model_id", "trade_id").alias("kind"))
    date = lambda n: F.date_format(F.date_add("day", n), "M/d")
    forms = {
        "1-URGENT": F.concat(F.lit(") 거래지원 종료 안내 ("), date(20), F.lit(" 15:00)")), "2-HIGH": F.lit(") 거래지원 종료 결정 철회 안내"), "3-MEDIUM": F.lit(") 거래지원 종료 안내 (일정 변경 안내)"),
        "4-NOT SPECIFIED": F.concat(F.lit(") 거래지원 종료 안내 (출금 지원 종료: "), date(9), F.lit(" 15:00)")), "5-LOW": F.concat(F.lit(") 거래지원 종료 안내 ("), date(3), F.lit(" 15:00) (일정 연장 안내: "), date(30), F.lit(" 15:00)")),
    }
    text = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in forms.items()])
    return rows.select(F.concat(F.lit("코인("), "coin", text).alias("title"), F.col("day").cast("timestamp").alias("listed_at"))


query(
    "j_23_notice_in_force", "trade_id:l active:b",
    f"""WITH {LEDGER}, n AS (SELECT coin, day, arg_max(model_id, trade_id) AS kind FROM ledger GROUP BY coin, day),
 u AS (SELECT coin, day, CASE kind WHEN '1-URGENT' THEN day + 20 + INTERVAL 15 HOUR WHEN '3-MEDIUM' THEN day + INTERVAL 45 DAY WHEN '4-NOT SPECIFIED' THEN day + INTERVAL 45 DAY WHEN '5-LOW' THEN day + 30 + INTERVAL 15 HOUR END AS until FROM n)
 SELECT trade_id, coalesce(until > l.day - INTERVAL 12 HOUR, false) AS active FROM ledger l ASOF LEFT JOIN u ON u.coin = l.coin AND u.day <= l.day - INTERVAL 12 HOUR WHERE status = 'open'""",
)(lambda s, d: notices.in_force(ledger(s, d).where("status = 'open'").select("trade_id", F.col("coin").alias("symbol"), (F.col("day").cast("timestamp") - F.expr("interval 12 hours")).alias("decided_at")), notices.parsed(titles(s, d))))


# the seven distribution heads, at a fifth of their percentages: paths of the events table move that much less
SCALE = 0.2


def head_sql(name: str) -> tuple[str, str]:
    target, close, drawdown, hours = p.HEADS[name]
    up = lambda percent: f"{1 + percent * SCALE / 100!r}::DOUBLE"
    first = f"min(CASE WHEN idx < {4 * hours} AND high >= entry * {up(target)} THEN idx END) OVER (PARTITION BY entry_id) AS {name}_i"
    label = f"any_value({name}_i) IS NOT NULL"
    if drawdown is not None:
        label += f" AND min(CASE WHEN idx <= {name}_i THEN low END) >= any_value(entry) * {up(-drawdown)} AND arg_max(close, idx) >= any_value(entry) * {up(close)}"
    return first, f"coalesce({label}, false)::INT AS {name}"


query(
    "l_05_distribution_heads", "entry_id:l " + " ".join(f"{n}:l" for n in p.HEADS),
    f"{PATHS}, hh AS (SELECT *, {', '.join(head_sql(n)[0] for n in p.HEADS)} FROM pa) SELECT entry_id, {', '.join(head_sql(n)[1] for n in p.HEADS)} FROM hh GROUP BY entry_id",
)(lambda s, d: each(s, d, lambda q: p.distribution_heads(q, SCALE)))


# trades known at nine o'clock of each day
def cutoffs(s, d):
    return trades(s, d).select(F.to_date("ts").alias("day")).distinct().withColumn("cutoff_ns", (F.unix_seconds(F.col("day").cast("timestamp")) + 32400) * 1_000_000_000)


query(
    "t_02_available", "day:s n:l",
    f"WITH {TRADES}, c AS (SELECT DISTINCT ts::DATE AS day, (epoch(ts::DATE) + 32400)::BIGINT * 1000000000 AS cut FROM trades) SELECT day, count(event_id) AS n FROM c LEFT JOIN trades ON event_ns <= cut AND received_ns <= cut GROUP BY day",
)(lambda s, d: flow.available_counts(trades(s, d), cutoffs(s, d)))

# five risk-reward heads of boosted trees (few rounds: parameters say how many), and a six-class model
FIVE = {"p_up5": "high / open - 1 >= 0.02", "p_up10": "high / open - 1 >= 0.05", "p_up20": "high / open - 1 >= 0.1", "p_dn5": "low / open - 1 <= -0.03", "p_dn10": "low / open - 1 <= -0.06"}


def five_heads(s, d, iterations: int = 4):
    rows = universe(s, d).withColumns({f"is_{n}": F.expr(c).cast("double") for n, c in FIVE.items()})
    out = rows.where("day >= date'1997-01-06'")
    for n in FIVE:
        out = h.predict(h.fit_head(rows.where("day < date'1997-01-01'"), FEATURES, f"is_{n}", iterations=iterations), out, n)
    return out


query("h_01_boosted_heads", "day:s market:s " + " ".join(f"{n}:d" for n in FIVE))(five_heads)


def six_classes(s, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    rows = universe(s, d).withColumn("k", sum(((F.col("high") / F.col("open") - 1) >= e).cast("double") for e in (0.02, 0.04, 0.06, 0.08, 0.1)))
    model = Pipeline(stages=[*h._inputs(FEATURES), RandomForestClassifier(featuresCol="x_", labelCol="k", numTrees=10, maxDepth=4, seed=7)]).fit(rows.where("day < date'1997-01-01'"))
    out = model.transform(rows.where("day >= date'1997-01-06'")).withColumn("pp", vector_to_array("probability"))
    return out.select("day", "market", *[F.coalesce(F.get("pp", F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(6)])


query("h_04_class_distribution", "day:s market:s " + " ".join(f"p{i}:d" for i in range(6)))(six_classes)


# time-ordered inner blocks: each block is scored by a model of the blocks before it, later rows by one of all blocks
def inner_blocks(s, d):
    folds = [("1996-07-01", "1996-07-06", "1997-01-01"), ("1997-01-01", "1997-01-06", "1997-07-01"), ("1997-07-01", "1997-07-06", "9999-01-01")]
    return h.walk_forward(labelled(s, d), folds, FEATURES, "y", "p", "logistic")


query("h_10_inner_blocks", "fold:l day:s market:s p:d")(inner_blocks)


# the intercept that makes mean scores meet the observed rate: Newton steps written out
NEWTON = f"{H}, zz AS (SELECT ln(least(greatest(p_up10, 1e-6), 1 - 1e-6) / (1 - least(greatest(p_up10, 1e-6), 1 - 1e-6))) AS z, y.y AS y FROM y), n0 AS (SELECT 0.0::DOUBLE AS b)"
for step in range(12):
    NEWTON += f", n{step + 1} AS (SELECT any_value(b) - greatest(-2.0, least(2.0, sum(q - y) / sum(q * (1 - q)))) AS b FROM (SELECT b, y, 1 / (1 + exp(-(z + b))) AS q FROM zz, n{step}))"


def shift(s, d):
    rows = hy(s, d)
    b = h.intercept_shift(rows, "p_up10", "y")
    return rows.agg(F.avg(h.shifted(F.col("p_up10"), b)).alias("mean_p"), F.avg("y").alias("rate")).withColumn("b", F.lit(b))


query("h_11_intercept_shift", "b:d mean_p:d rate:d", f"{NEWTON} SELECT any_value(b) AS b, avg(1 / (1 + exp(-(z + b)))) AS mean_p, avg(y) AS rate FROM zz, n12")(shift)

# isotonic calibration: the fit at each seen score is the largest, over runs that start at or before it, of the smallest mean of a run
# that goes on from there; unseen scores lie between their neighbours
ISOTONIC = f"""{H}, g AS (SELECT p_up10 AS p, sum(y.y)::DOUBLE AS s, count(*)::DOUBLE AS n FROM y WHERE day < DATE '1998-01-01' GROUP BY p_up10),
 o AS (SELECT p, s, n, row_number() OVER (ORDER BY p) AS i, sum(s) OVER (ORDER BY p) AS cs, sum(n) OVER (ORDER BY p) AS cn FROM g),
 m AS (SELECT a.i AS i, j.i AS j, min((k.cs - j.cs + j.s) / (k.cn - j.cn + j.n)) AS low FROM o a JOIN o j ON j.i <= a.i JOIN o k ON k.i >= a.i GROUP BY a.i, j.i),
 f AS (SELECT o.p, max(low) AS v FROM m JOIN o ON o.i = m.i GROUP BY o.p), t AS (SELECT DISTINCT p_up10 AS p FROM y WHERE day >= DATE '1998-01-01'),
 e AS (SELECT t.p, (SELECT max(f.p) FROM f WHERE f.p <= t.p) AS lo, (SELECT min(f.p) FROM f WHERE f.p >= t.p) AS hi FROM t),
 r AS (SELECT e.p, CASE WHEN lo IS NULL THEN b.v WHEN hi IS NULL OR lo = hi THEN a.v ELSE a.v + (b.v - a.v) * (e.p - lo) / (hi - lo) END AS iso FROM e LEFT JOIN f a ON a.p = lo LEFT JOIN f b ON b.p = hi)"""
query("a_18_isotonic", "day:s market:s iso:d", f"{ISOTONIC} SELECT day, market, iso FROM y JOIN r ON r.p = y.p_up10 WHERE day >= DATE '1998-01-01'")(
    lambda s, d: h.isotonic((q := hy(s, d)).where("day < date'1998-01-01'"), q.where("day >= date'1998-01-01'"), "p_up10", "y", "iso")
)


# calibration arms on two cohorts of days: the factor of days before 1997, of all days before the cohort, and of all days but the row's own half year
def calibration_arms(s, d):
    rows = hy(s, d).select("day", "y", "p_up10", F.year("day").alias("year"), F.when(F.month("day") <= 6, 1).otherwise(2).alias("half"))
    sums = rows.groupBy("year", "half").agg(F.sum("y").alias("ys"), F.sum("p_up10").alias("ps"))
    cohorts = F.broadcast(sums.select(F.col("year").alias("of"), F.col("half").alias("part")).where("of in (1998, 1999)"))
    arms = F.array(
        F.when(F.col("year") < 1997, F.lit("frozen")), F.when(F.col("year") < F.col("of"), F.lit("full_history")),
        F.when((F.col("year") < F.col("of")) | (F.col("year") == F.col("of")) & (F.col("half") != F.col("part")), F.lit("out_of_fold")),
    )
    taught = sums.crossJoin(cohorts).select("of", "part", "ys", "ps", F.explode(F.filter(arms, lambda a: a.isNotNull())).alias("arm"))
    factors = taught.groupBy("of", "part", "arm").agg(F.try_divide(F.sum("ys"), F.sum("ps")).alias("k"))
    asked = rows.join(F.broadcast(factors), (F.col("year") == F.col("of")) & (F.col("half") == F.col("part")))
    q = F.least(F.col("p_up10") * F.col("k"), F.lit(0.99))
    return asked.groupBy(F.col("of").alias("cohort"), "arm").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"), F.avg((q - F.col("y")) ** 2).alias("brier"), (F.avg(q) - F.avg("y")).alias("bias"))


query(
    "v_17_calibration_arms", "cohort:l arm:s n:l days:l brier:d bias:d",
    f"""{H}, r AS (SELECT day, y.y AS y, p_up10 AS p, year(day) AS yr, CASE WHEN month(day) <= 6 THEN 1 ELSE 2 END AS hf FROM y),
 co AS (SELECT DISTINCT yr AS of_, hf AS part FROM r WHERE yr IN (1998, 1999)),
 k AS (SELECT of_, part, 'frozen' AS arm, sum(y) / sum(p) AS k FROM r, co WHERE yr < 1997 GROUP BY ALL
  UNION ALL SELECT of_, part, 'full_history', sum(y) / sum(p) FROM r, co WHERE yr < of_ GROUP BY ALL
  UNION ALL SELECT of_, part, 'out_of_fold', sum(y) / sum(p) FROM r, co WHERE yr < of_ OR yr = of_ AND hf <> part GROUP BY ALL)
 SELECT of_ AS cohort, arm, count(*) AS n, count(DISTINCT day) AS days, avg(pow(least(p * k, 0.99) - y, 2)) AS brier, avg(least(p * k, 0.99)) - avg(y) AS bias FROM r JOIN k ON yr = of_ AND hf = part GROUP BY ALL""",
)(calibration_arms)


# frames by class, the raw record beside it: an event names its kind and payload, an error its message; the rest does not parse
def frames(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"error": {"name": "'), "event_type", F.lit('"}}'))).when(F.col("event_id") % 77 == 0, F.concat(F.lit('{"type": '), "props")).otherwise(F.concat(F.lit('{"type": "'), "event_type", F.lit('", "payload": '), "props", F.lit("}")))
    return e.select("event_id", text.alias("raw"))


def frame_classes(s, d):
    parsed = F.from_json("raw", "type string, error struct<name:string>, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    rows = frames(s, d).withColumn("f", parsed)
    kind = F.when(F.col("f.bad").isNotNull(), "parse_error").when(F.col("f.error").isNotNull(), "server_error").otherwise("event")
    return rows.select(kind.alias("record_type"), F.coalesce("f.type", "f.error.name").alias("name"), "raw").groupBy("record_type", "name").agg(F.count("*").alias("n"), F.sum(F.char_length("raw")).alias("raw_chars"))


query(
    "s_09_frame_classes", "record_type:s name:s n:l raw_chars:l",
    """WITH r AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'server_error' WHEN event_id % 77 = 0 THEN 'parse_error' ELSE 'event' END AS record_type, event_type,
 CASE WHEN event_id % 50 = 0 THEN '{"error": {"name": "' || event_type || '"}}' WHEN event_id % 77 = 0 THEN '{"type": ' || props ELSE '{"type": "' || event_type || '", "payload": ' || props || '}' END AS raw FROM events)
 SELECT record_type, CASE WHEN record_type <> 'parse_error' THEN event_type END AS name, count(*) AS n, sum(length(raw)) AS raw_chars FROM r GROUP BY 1, 2""",
)(frame_classes)


# payload rules of books of three units around each trade: positive numbers, and no bid above an ask of any unit
def payload_rules(s, d):
    unit = lambda k: F.struct((F.col("price") - 0.05 * k).alias("bid"), (F.col("price") + 0.05 * k - F.when(F.col("event_id") % 9 == 0, 0.15).otherwise(0.0)).alias("ask"), (F.col("event_id") % 11).alias("size"))
    rows = trades(s, d).withColumn("units", F.array(*[unit(k) for k in (1, 2, 3)]))
    positive = F.forall("units", lambda u: (u["bid"] > 0) & (u["ask"] > 0) & (u["size"] > 0))
    best_bid, best_ask = F.array_max(F.transform("units", lambda u: u["bid"])), F.array_min(F.transform("units", lambda u: u["ask"]))
    reason = F.when(~positive, "not_positive").when(F.round(best_bid, 6) > F.round(best_ask, 6), "crossed").when(F.col("received_ns") < F.col("event_ns"), "clock").otherwise("ok")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


query(
    "s_10_payload_rules", "reason:s n:l last:l",
    f"""WITH {TRADES} SELECT CASE WHEN event_id % 11 = 0 OR price - 0.15 <= 0 THEN 'not_positive' WHEN event_id % 9 = 0 THEN 'crossed' WHEN received_ns < event_ns THEN 'clock' ELSE 'ok' END AS reason, count(*) AS n, max(event_id) AS last FROM trades GROUP BY 1""",
)(payload_rules)


# do two feeds mean one instant? fifteen-minute bars summed to days that start at nine o'clock, and at midnight, against daily trade counts
def boundary_audit(s, d):
    t = trades(s, d)
    daily = t.groupBy("market", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
    out = None
    for hours in (0, 9):
        day = F.to_date(F.col("ts") - F.expr(f"interval {hours} hours"))
        fine = flow.tumbling_bars(t, "15 minutes").groupBy("market", day.alias("day")).agg(F.sum("volume").alias("fine"))
        both = daily.join(fine, ["market", "day"], "full").select("market", F.abs(F.coalesce("volume", F.lit(0.0)) - F.coalesce("fine", F.lit(0.0))).alias("error"), F.lit(hours).alias("shift"))
        out = both if out is None else out.unionByName(both)
    return out.groupBy("market", "shift").agg(F.count("*").alias("days"), F.sum((F.col("error") < 1e-9).cast("int")).alias("equal"), F.max("error").alias("max_error"))


query(
    "f_34_boundary_audit", "market:s shift:l days:l equal:l max_error:d",
    f"""WITH {TRADES}, a AS (SELECT market, ts::DATE AS day, sum(volume) AS v FROM trades GROUP BY ALL), b AS (SELECT shift, market, (ts - shift * INTERVAL 1 HOUR)::DATE AS day, sum(volume) AS f FROM trades, (VALUES (0), (9)) s(shift) GROUP BY ALL),
 e AS (SELECT shift, market, day FROM a, (VALUES (0), (9)) s(shift) UNION SELECT shift, market, day FROM b),
 g AS (SELECT e.market, e.shift, abs(coalesce(v, 0) - coalesce(f, 0)) AS x FROM e LEFT JOIN a ON a.market = e.market AND a.day = e.day LEFT JOIN b ON b.market = e.market AND b.day = e.day AND b.shift = e.shift)
 SELECT market, shift, count(*) AS days, sum((x < 1e-9)::INT) AS equal, max(x) AS max_error FROM g GROUP BY ALL""",
)(boundary_audit)
