"""Queries: exit rules by volatility and regime, early heads, joint path labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import closing as c
from tidemark.operators import exit_rules as x
from tidemark.operators import features as f
from tidemark.plans.duck import TRADES, intraday
from tidemark.plans.q_precursors import SESSION, index_bars
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_intraday, index_intraday

#: These markets move less in a day than the originals: levels are a quarter.
SCALE = 0.25


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, session, path, atr, regime): the quarter hours of each session as they were seen; the range of the session before over its close; the
    index's direction and range of the session before."""
    bars = f.with_session(bars_intraday(spark, sf_dir))
    own = bars.groupBy("market", "session").agg(
        F.array_sort(F.collect_list(F.struct((F.col("i") - 1).alias("idx"), "open", "high", "low", "close"))).alias("path"), ((F.max("high") - F.min("low")) / F.max_by("close", "i")).alias("range"),
    )
    own = own.withColumn("atr", F.lag("range").over(Window.partitionBy("market").orderBy("session")))
    index = f.with_session(index_intraday(spark, sf_dir).withColumn("market", F.lit("index"))).groupBy("session").agg(
        (F.max_by("close", "i") / F.min_by("open", "i") - 1).alias("r"), ((F.max("high") - F.min("low")) / F.max_by("close", "i")).alias("range")
    )
    before = Window.orderBy("session")
    index = index.select("session", F.lag("r").over(before).alias("r"), F.lag("range").over(before).alias("range"))
    regime = F.when(F.col("r") >= 0, "bull").when(F.col("range") >= 0.2, "bear_volatile").when(F.col("r") < 0, "bear_quiet").otherwise("unknown")
    return own.join(F.broadcast(index.select("session", regime.alias("regime"))), "session", "left").drop("range")


INDEX = index_bars(15).replace("AS open,", "AS open, max(cents) / 100.0 AS high, min(cents) / 100.0 AS low,")
PANEL = f"""WITH {TRADES}, {intraday(15)}, {INDEX}, b AS (SELECT *, {SESSION} AS session, row_number() OVER (PARTITION BY market, {SESSION} ORDER BY ts) - 1 AS i FROM ibars),
 s0 AS (SELECT market, session, arg_min(open, i) AS e, arg_max(close, i) AS lc, max(high) AS mx, min(low) AS mn, count(*) AS bars, (max(high) - min(low)) / arg_max(close, i) AS range FROM b GROUP BY ALL),
 s1 AS (SELECT *, lag(range) OVER (PARTITION BY market ORDER BY session) AS atr FROM s0),
 x0 AS (SELECT (t - INTERVAL 9 HOUR)::DATE AS session, arg_max(close, t) / arg_min(open, t) - 1 AS r, (max(high) - min(low)) / arg_max(close, t) AS range FROM xb GROUP BY 1),
 x1 AS (SELECT session, CASE WHEN lag(r) OVER w >= 0 THEN 'bull' WHEN lag(range) OVER w >= 0.2 THEN 'bear_volatile' WHEN lag(r) OVER w < 0 THEN 'bear_quiet' ELSE 'unknown' END AS regime FROM x0 WINDOW w AS (ORDER BY session)),
 se AS (SELECT s1.*, regime FROM s1 LEFT JOIN x1 USING (session)),
 ba AS (SELECT b.market, b.session, i, open, high, low, close, e, greatest(e, max(high) OVER w) AS hh, least(e, min(low) OVER w) AS ll FROM b JOIN s0 ON s0.market = b.market AND s0.session = b.session WINDOW w AS (PARTITION BY b.market, b.session ORDER BY i))"""


def number(v: float) -> str:
    return f"{v!r}::DOUBLE"


def clip(k: int, lo: float, hi: float) -> str:
    return f"least(greatest({k} * coalesce(atr, {x.UNKNOWN_ATR}), {number(lo * SCALE)}), {number(hi * SCALE)})"


STOP, TARGET = number(x.STOP * SCALE), number(x.TARGET * SCALE)
PARAMETERS = f"""pm AS (SELECT se.*, rule,
 CASE rule WHEN 'vol' THEN {clip(2, 0.015, 0.05)} WHEN 'vol_tight' THEN {clip(2, 0.015, x.STOP)} WHEN 'regime' THEN CASE regime WHEN 'bear_volatile' THEN {number(0.02 * SCALE)} WHEN 'bear_quiet' THEN {STOP} ELSE {number(0.04 * SCALE)} END ELSE {STOP} END AS stop,
 CASE rule WHEN 'trail' THEN NULL WHEN 'vol' THEN {clip(4, 0.03, 0.10)} WHEN 'vol_tight' THEN {clip(4, 0.03, 0.10)} WHEN 'regime' THEN CASE WHEN regime IN ('bear_volatile', 'bear_quiet') THEN {TARGET} ELSE {number(0.08 * SCALE)} END ELSE {TARGET} END AS target,
 CASE WHEN rule = 'trail' THEN {number(0.03 * SCALE)} END AS arm, CASE WHEN rule = 'trail' THEN {number(0.02 * SCALE)} END AS trail,
 CASE WHEN rule = 'time' OR rule = 'regime' AND regime = 'bear_volatile' THEN 1 WHEN rule = 'regime' AND regime = 'bear_quiet' THEN 2 END AS hours
 FROM se, (VALUES {", ".join(f"('{r}')" for r in x.RULES)}) v(rule))"""
WALK = f"""{PANEL}, {PARAMETERS}, w0 AS (SELECT pm.*, i, hh, ll, close, CASE WHEN low <= ba.e * (1 - stop) THEN 'sl' WHEN trail IS NOT NULL AND hh >= ba.e * (1 + arm) AND low <= hh * (1 - trail) THEN 'trail'
 WHEN high >= ba.e * (1 + target) THEN 'tp' WHEN i + 1 >= hours * 4 THEN 'timestop' END AS o FROM pm JOIN ba ON ba.market = pm.market AND ba.session = pm.session),
 w1 AS (SELECT *, row_number() OVER (PARTITION BY market, session, rule ORDER BY o IS NULL, CASE WHEN o IS NOT NULL THEN i END, i DESC) AS k FROM w0),
 w2 AS (SELECT market, session, rule, regime, stop, target, arm, trail, hours, coalesce(o, 'eod') AS outcome, (i + 1) / 4.0 AS hold_hours, ll / e - 1 AS low_excursion,
  CASE o WHEN 'sl' THEN -stop WHEN 'trail' THEN hh * (1 - trail) / e - 1 WHEN 'tp' THEN target ELSE close / e - 1 END AS gross FROM w1 WHERE k = 1)"""


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.under_rules(sessions(spark, sf_dir), SCALE)


query(
    "x_06_exit_rules", "market:s session:s rule:s stop:d target:d arm:d trail:d hours:d gross:d outcome:s hold_hours:d low_excursion:d net:d",
    f"{WALK} SELECT *, gross - 0.0015 AS net FROM w2",
)(ruled)
#: The rules, and cells of a ladder, on the same sessions.
LADDERS = {"ladder_even": ((0.01, 0.5), (0.02, 0.5)), "ladder_late": ((0.01, 0.2), (0.02, 0.3), (0.03, 0.5))}


def ladder_gross(path, floor: float, arms: tuple[tuple[float, float], ...]):
    """Arms (gain, fraction) sold where they are first reached before the floor; the rest at the floor or the end."""
    entry = F.get(path, F.lit(0))["open"]
    low = c.first_index(path, lambda b: b["low"] <= entry * (1 - floor))
    gross, left = F.lit(0.0), F.lit(1.0)
    for gain, part in arms:
        level = entry * (1 + gain)
        at = c.first_index(path, (lambda level: lambda b: b["high"] >= level)(level))
        sold = at.isNotNull() & (low.isNull() | (at < low))
        gross, left = gross + F.when(sold, gain * part).otherwise(0.0), left - F.when(sold, part).otherwise(0.0)
    rest = F.when(low.isNotNull(), -floor).otherwise(F.element_at(path, -1)["close"] / entry - 1)
    return gross + left * rest


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir)
    ladders = rows.withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), ladder_gross(F.col("path"), 0.01, a).alias("gross")) for n, a in LADDERS.items()]))).select("v.policy", "v.gross", F.lit(None).cast("double").alias("hold_hours"))
    every = x.under_rules(rows, SCALE).select(F.col("rule").alias("policy"), "gross", "hold_hours").unionByName(ladders)
    return every.groupBy("policy").agg(F.count("*").alias("n"), F.avg("gross").alias("mean_gross"), F.stddev_samp("gross").alias("spread"), F.min("gross").alias("worst"), F.avg((F.col("gross") > 0.0015).cast("int")).alias("win"), F.avg("hold_hours").alias("hold_hours"))


def _ladder_sql(name: str, arms: tuple[tuple[float, float], ...]) -> str:
    sold = [f"coalesce(a{k} < coalesce(fl, 999), FALSE)" for k in range(len(arms))]
    gain = " + ".join(f"CASE WHEN {s} THEN {g * p!r}::DOUBLE ELSE 0 END" for s, (g, p) in zip(sold, arms))
    left = " - ".join(["1"] + [f"CASE WHEN {s} THEN {p!r}::DOUBLE ELSE 0 END" for s, (_, p) in zip(sold, arms)])
    hits = ", ".join(f"min(CASE WHEN high >= e * (1 + {g!r}::DOUBLE) THEN i END) AS a{k}" for k, (g, _) in enumerate(arms))
    return f"SELECT '{name}' AS policy, {gain} + ({left}) * CASE WHEN fl IS NOT NULL THEN -0.01::DOUBLE ELSE lc / e - 1 END AS gross, NULL::DOUBLE AS hold_hours FROM (SELECT any_value(e) AS e, arg_max(close, i) AS lc, min(CASE WHEN low <= e * (1 - 0.01::DOUBLE) THEN i END) AS fl, {hits} FROM ba GROUP BY market, session)"


query(
    "x_24_policy_comparison", "policy:s n:l mean_gross:d spread:d worst:d win:d hold_hours:d",
    f"""{WALK}, al AS (SELECT rule AS policy, gross, hold_hours FROM w2 UNION ALL {" UNION ALL ".join(_ladder_sql(n, a) for n, a in LADDERS.items())})
 SELECT policy, count(*) AS n, avg(gross) AS mean_gross, stddev_samp(gross) AS spread, min(gross) AS worst, avg((gross > 0.0015)::INT) AS win, avg(hold_hours) AS hold_hours FROM al GROUP BY policy""",
)(policies)
EARLY = ", ".join(f"CASE WHEN bars >= {k} THEN (SELECT (max(high) >= se.e * (1 + {p * SCALE / 100!r}::DOUBLE))::INT FROM b WHERE b.market = se.market AND b.session = se.session AND i < {k}) END AS {n}" for n, (k, p) in x.EARLY_HEADS.items())
query("l_06_early_hits", "market:s session:s " + " ".join(f"{n}:l" for n in x.EARLY_HEADS), f"{PANEL} SELECT market, session, {EARLY} FROM se")(
    lambda s, d: (rows := sessions(s, d)).select("market", "session", *[v.alias(n) for n, v in x.early_heads(rows["path"], SCALE).items()])
)


def _first(condition: str) -> str:
    return f"(SELECT min(i) FROM b WHERE b.market = se.market AND b.session = se.session AND {condition})"


def _outcome(down: str, up: str) -> str:
    return f"CASE WHEN {down} <= coalesce({up}, 999) THEN 'down_first' WHEN {up} IS NOT NULL THEN 'up_first' ELSE 'neither' END"


UP, DOWN = 0.10 * SCALE, 0.05 * SCALE
query(
    "l_15_up_before_down", "market:s session:s fp_fixed:l fp_fixed_outcome:s fp_atr:l fp_atr_outcome:s path_up10:l path_dn5:l path_mfe20:l path_mfe:d path_mae:d path_bracket_outcome:s path_bracket_net:d path_eod_net:d",
    f"""{PANEL}, j AS (SELECT se.*, {_first(f"low <= se.e * (1 - {number(DOWN)})")} AS fd, {_first(f"high >= se.e * (1 + {number(UP)})")} AS fu, {_first("low <= se.e * (1 - atr)")} AS ad, {_first("high >= se.e * (1 + 2 * atr)")} AS au,
 {_first(f"low <= se.e * (1 - {number(0.03 * SCALE)})")} AS bd, {_first(f"high >= se.e * (1 + {number(0.05 * SCALE)})")} AS bu FROM se)
 SELECT market, session, ({_outcome("fd", "fu")} = 'up_first')::INT AS fp_fixed, {_outcome("fd", "fu")} AS fp_fixed_outcome, CASE WHEN atr > 0 THEN ({_outcome("ad", "au")} = 'up_first')::INT END AS fp_atr,
 CASE WHEN atr > 0 THEN {_outcome("ad", "au")} ELSE 'invalid_atr' END AS fp_atr_outcome, (mx / e - 1 >= {number(UP)})::INT AS path_up10, (mn / e - 1 <= -{number(DOWN)})::INT AS path_dn5, (mx / e - 1 >= {number(0.20 * SCALE)})::INT AS path_mfe20,
 mx / e - 1 AS path_mfe, mn / e - 1 AS path_mae, CASE WHEN bd <= coalesce(bu, 999) THEN 'SL' WHEN bu IS NOT NULL THEN 'TP' ELSE 'EOD' END AS path_bracket_outcome,
 CASE WHEN bd <= coalesce(bu, 999) THEN -{number(0.03 * SCALE)} WHEN bu IS NOT NULL THEN {number(0.05 * SCALE)} ELSE lc / e - 1 END - 0.0015 AS path_bracket_net, lc / e - 1 - 0.0015 AS path_eod_net FROM j""",
)(lambda s, d: (rows := sessions(s, d)).select("market", "session", *[v.alias(n) for n, v in x.joint_labels(rows["path"], rows["atr"], SCALE).items()]))
