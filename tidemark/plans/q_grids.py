"""Queries: label grids, tree rules by fold, greedy matches, sweeps of models and universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import features as f
from tidemark.operators import heads as h
from tidemark.operators import label_grid as lg
from tidemark.plans.duck import TRADES, intraday
from tidemark.plans.q_audits import with_regime
from tidemark.plans.q_evaluate import H, hy
from tidemark.plans.q_features import REGIME
from tidemark.plans.q_heads import FEATURES, FOLDS, labelled
from tidemark.plans.q_selection import HEADS, ranked
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_intraday, index_intraday

#: The grid of the reference's questions, at half its targets: day ranges of these markets are smaller.
GRID = lg.Grid(targets=(0.5, 1, 1.5, 2, 3, 5), closes=(0, 0.5, 1, 2), drawdowns=(0.5, 1, 2), horizons=(4, 8, 12, 24))


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of each session, with the regime (the index's session before rose or fell) and the tier (three most traded of the session before)."""
    bars = f.with_session(bars_intraday(spark, sf_dir, 240))
    own = Window.partitionBy("market").orderBy("session")
    turnover = bars.groupBy("market", "session").agg(F.sum("quote_volume").alias("qv")).withColumn("before", F.lag("qv").over(own))
    place = F.rank().over(Window.partitionBy("session").orderBy(F.col("before").desc_nulls_last()))
    tiers = turnover.select("market", "session", F.when(F.col("before").isNotNull(), F.when(place <= 3, "large").otherwise("small")).alias("tier"))
    index = f.with_session(index_intraday(spark, sf_dir, 240).withColumn("market", F.lit("index"))).groupBy("session").agg((F.max_by("close", "i") / F.min_by("open", "i") - 1).alias("r"))
    regimes = index.select("session", F.lag("r").over(Window.orderBy("session")).alias("r")).select("session", F.when(F.col("r") >= 0, "up").when(F.col("r") < 0, "down").alias("regime"))
    return lg.session_paths(bars, GRID).join(tiers, ["market", "session"]).join(F.broadcast(regimes), "session", "left")


def values(name: str, column: str, xs: tuple) -> str:
    return f"(VALUES {', '.join(f'({float(x)}::DOUBLE)' for x in xs)}) {name}({column})"


INDEX_BARS = """xbars AS (SELECT to_timestamp((epoch_us(ts) // 1000000) // 14400 * 14400)::TIMESTAMP AS ts, first(cents ORDER BY ts, event_id) / 100.0 AS open, last(cents ORDER BY ts, event_id) / 100.0 AS close
 FROM trades GROUP BY 1)"""
PANEL = f"""WITH {TRADES}, {intraday(240)}, {INDEX_BARS},
 b AS (SELECT *, (ts - INTERVAL 9 HOUR)::DATE AS session, row_number() OVER (PARTITION BY market, (ts - INTERVAL 9 HOUR)::DATE ORDER BY ts) - 1 AS i FROM ibars),
 s AS (SELECT market, session, arg_min(open, i) AS open, arg_max(close, i) AS close, sum(quote_volume) AS qv FROM b GROUP BY ALL),
 s2 AS (SELECT *, lag(qv) OVER (PARTITION BY market ORDER BY session) AS before FROM s),
 s3 AS (SELECT *, CASE WHEN before IS NULL THEN 'unknown' WHEN rank() OVER (PARTITION BY session ORDER BY before DESC NULLS LAST) <= 3 THEN 'large' ELSE 'small' END AS tier FROM s2),
 x AS (SELECT (ts - INTERVAL 9 HOUR)::DATE AS session, arg_max(close, ts) / arg_min(open, ts) - 1 AS r FROM xbars GROUP BY 1),
 x2 AS (SELECT session, CASE lag(r) OVER (ORDER BY session) >= 0 WHEN TRUE THEN 'up' WHEN FALSE THEN 'down' ELSE 'unknown' END AS regime FROM x),
 p AS (SELECT s3.*, coalesce(regime, 'unknown') AS regime, s3.close / s3.open - 1 AS ret FROM s3 LEFT JOIN x2 USING (session)),
 t AS (SELECT p.market, p.session, target, min(CASE WHEN b.high >= p.open * (1 + target / 100) THEN i END) AS bar FROM p JOIN b ON b.market = p.market AND b.session = p.session AND i < {GRID.bars}, {values("v", "target", GRID.targets)} GROUP BY ALL),
 u AS (SELECT t.market, t.session, target, bar, min(b.low) AS low FROM t LEFT JOIN b ON b.market = t.market AND b.session = t.session AND b.i <= bar GROUP BY ALL),
 w AS (SELECT u.*, p.regime, p.tier, p.ret, u.low / p.open - 1 AS dip FROM u JOIN p ON p.market = u.market AND p.session = u.session),
 g AS (SELECT w.*, close, drawdown, horizon, coalesce(bar < horizon // {GRID.bar_hours}, FALSE) AS hit FROM w, {values("c", "close", GRID.closes)}, {values("d", "drawdown", GRID.drawdowns)}, (VALUES {", ".join(f"({x})" for x in GRID.horizons)}) h(horizon)),
 k AS (SELECT *, hit AND dip >= -drawdown / 100 AND ret >= close / 100 AS ok FROM g),
 a AS (SELECT r AS regime, q AS tier, * EXCLUDE (regime, tier) FROM k, LATERAL (SELECT unnest([k.regime, 'all']) AS r) rr, LATERAL (SELECT unnest([k.tier, 'all']) AS q) qq)"""
query(
    "l_10_label_grid", "regime:s tier:s target:d close:d drawdown:d horizon:l n:l hits:l successes:l hit_rate:d base_rate:d no_hit_end:d no_hit_worst:d failed_end:d hit_hours:d success_low:d",
    f"""{PANEL} SELECT regime, tier, target, close, drawdown, horizon, count(*) AS n, sum(hit::INT) AS hits, sum(ok::INT) AS successes, avg(hit::INT) AS hit_rate, avg(ok::INT) AS base_rate,
 avg(CASE WHEN NOT hit THEN ret END) AS no_hit_end, quantile_cont(CASE WHEN NOT hit THEN round(ret * 10000) END, 0.05) / 10000 AS no_hit_worst, avg(CASE WHEN hit AND NOT ok THEN ret END) AS failed_end,
 avg(CASE WHEN ok THEN bar + 1 END) * {GRID.bar_hours} AS hit_hours, avg(CASE WHEN ok THEN dip END) AS success_low FROM a GROUP BY ALL""",
)(lambda s, d: lg.label_grid(session_rows(s, d), GRID))


def tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a shallow tree learned before 1997, on the rows that taught it (fold 0) and on each later year."""
    rows = labelled(spark, sf_dir).where("day < date'1999-01-01'").withColumn("fold", F.greatest(F.year("day") - 1996, F.lit(0)))
    model = h.fit_tree(h.class_weights(rows.where("fold = 0"), "y"), FEATURES, "y", min_rows=100)
    rules, medians = h.compile_rules(model, FEATURES)
    return h.rules_by_fold(rows, rules, medians, "y", "fold")


query("h_06_tree_rules", "fold:l leaf:l rule:s n:l hits:l rate:d base:d lift:d")(tree_rules)

#: Each pick in rank order takes the nearest free name: lists stand for what is free.
query(
    "j_16_greedy_matches", "day:s market:s control:s reason:s",
    f"""WITH RECURSIVE {HEADS.removeprefix("WITH ")}, ds AS (SELECT day, list({{'m': market, 'v': uq}} ORDER BY rk) FILTER (rk <= 2) AS picks, coalesce(list({{'m': market, 'v': uq}} ORDER BY market) FILTER (rk > 2 AND uq IS NOT NULL), []) AS free FROM d1 GROUP BY day),
 de AS (SELECT *, CASE WHEN len(list_filter(picks, lambda p: p.v IS NULL)) > 0 THEN 'selected_value_missing' WHEN len(free) < len(picks) THEN 'insufficient_controls' END AS reason FROM ds),
 st AS (SELECT day, 0::BIGINT AS k, picks, free, NULL::VARCHAR AS control FROM de WHERE reason IS NULL
  UNION ALL SELECT day, k + 1, picks, list_filter(free, lambda f: f.m <> c), c FROM (SELECT st.*, list_min(list_transform(free, lambda f: {{'g': round(abs(f.v - picks[k + 1].v), 9), 'm': f.m}})).m AS c FROM st WHERE k < len(picks)))
 SELECT day, picks[k].m AS market, control, NULL AS reason FROM st WHERE k > 0 UNION ALL SELECT day, unnest(picks).m, NULL, reason FROM de WHERE reason IS NOT NULL""",
)(lambda s, d: h.greedy_matches(ranked(s, d).withColumn("picked", F.col("rk") <= 2), "picked", "uq"))

SETS = {"all": FEATURES, "returns": ["r1", "r3", "r7"], "turnover": ["s7", "lq"]}
MODELS = {"logistic": {"kind": "logistic"}, "forest": {"kind": "forest", "trees": 8, "depth": 4}}


def model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of the best k of each universe: feature sets x models x universes x k from one table of scores, with a stable random order beside them."""
    rows = labelled(spark, sf_dir)
    scored = h.sweep(rows.where("day < date'1999-01-01'"), FOLDS, SETS, MODELS, ["y"], "sweep").select("set", "model", "fold", "day", "market", "liq", "y", F.col("p_y").alias("p"))
    tested = scored.where("set = 'all' and model = 'logistic'")
    chance = tested.withColumns({"set": F.lit("none"), "model": F.lit("random"), "p": F.xxhash64("day", "market") / 2.0**63})
    every = scored.unionByName(chance).withColumn("universe", F.explode(F.array(F.lit(5), F.lit(10)))).where("liq <= universe")
    by = Window.partitionBy("set", "model", "universe", "day")
    best = every.withColumn("i", F.row_number().over(by.orderBy(F.round("p", 9).desc(), "market"))).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3)))).where("i <= k")
    per_fold = best.groupBy("set", "model", "universe", "k", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    rate = F.col("hits") / F.col("n")
    return per_fold.groupBy("set", "model", "universe", "k").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("precision"), F.min(rate).alias("worst_fold"), F.max(rate).alias("best_fold"))


query("h_09_v_24_ablation_grid", "set:s model:s universe:l k:l n:l precision:d worst_fold:d best_fold:d")(model_grid)


def head_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate of the best k by each head, in each universe and regime ('all' too)."""
    rows = with_regime(spark, sf_dir, hy(spark, sf_dir)).select("day", "market", "regime", "liq", "p_up10", "p_dn5", "y", (F.col("low") / F.col("open") - 1 <= -0.05).cast("int").alias("z"))
    rows = rows.replace("none", "unknown", "regime")
    heads = F.array(F.struct(F.lit("up").alias("head"), F.col("p_up10").alias("p"), F.col("y").alias("hit")), F.struct(F.lit("down").alias("head"), F.col("p_dn5").alias("p"), F.col("z").alias("hit")))
    each = rows.select("day", "market", "regime", "liq", F.explode(heads).alias("x")).select("day", "market", "regime", "liq", "x.*").withColumn("universe", F.explode(F.array(F.lit(5), F.lit(10)))).where("liq <= universe")
    ranked_ = each.withColumn("i", F.row_number().over(Window.partitionBy("head", "universe", "day").orderBy(F.desc("p"), "market")))
    cells = ranked_.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).where("i <= k").withColumn("btc_regime", F.explode(F.array(F.col("regime"), F.lit("all"))))
    return cells.groupBy("head", "btc_regime", "universe", "k").agg(F.count("*").alias("n"), F.avg("hit").alias("hit"), F.countDistinct("day").alias("days"))


query(
    "v_14_head_regime_sweep", "head:s btc_regime:s universe:l k:l n:l hit:d days:l",
    f"""{H}, {REGIME}, z AS (SELECT y.day, market, coalesce(btc_regime, 'unknown') AS rg, liq, p_up10, p_dn5, y.y AS y, (low / open - 1 <= -0.05)::INT AS z FROM y LEFT JOIN regime ON regime.day = y.day),
 e AS (SELECT 'up' AS head, p_up10 AS p, y AS hit, * FROM z UNION ALL SELECT 'down', p_dn5, z, * FROM z), r AS (SELECT e.*, universe, row_number() OVER (PARTITION BY head, universe, day ORDER BY p DESC, market) AS i FROM e, (VALUES (5), (10)) u(universe) WHERE liq <= universe)
 SELECT head, g AS btc_regime, universe, k, count(*) AS n, avg(hit) AS hit, count(DISTINCT day) AS days FROM r, (VALUES (1), (3), (5)) v(k), LATERAL (SELECT unnest([rg, 'all']) AS g) q WHERE i <= k GROUP BY ALL""",
)(head_sweep)
