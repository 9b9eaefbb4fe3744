"""Filters, policies, decisions, and ways to order, pair and choose candidates within a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.windows import pct_rank

#: Send policies: a name and the predicate of a ranked row.
POLICIES = {"all": "true", "rank1": "rk <= 1", "rank2": "rk <= 2", "rank3_no_dump": "rk <= 3 and not dump", "rr75": "rr >= 0.75", "p20": "p_up20 >= 0.03"}


def day_window() -> WindowSpec:
    return Window.partitionBy("day")


def heads(scored: DataFrame) -> DataFrame:
    """Stand-in head probabilities of scored rows: two clipped ranks and what is derived from them."""
    rows = scored.withColumns({"a_": pct_rank("score", "day"), "b_": pct_rank("r1", "day")})
    up, dn = F.least(F.greatest(F.col("a_") * 0.4, F.lit(0.01)), F.lit(0.99)), F.least(F.greatest(F.coalesce("b_", F.lit(0.5)) * 0.3, F.lit(0.01)), F.lit(0.99))
    rows = rows.withColumns({"p_up10": F.round(up, 6), "p_dn5": F.round(dn, 6)})
    part = lambda c, k: F.floor(F.round(F.col(c) * 1e6) / k + 0.5) / 1e6  # noqa: E731, in whole millionths: a half goes up
    return rows.withColumns({"p_dn10": part("p_dn5", 2), "p_up20": part("p_up10", 4), "rr": F.round(F.col("p_up10") / F.greatest("p_dn5", F.lit(1e-3)), 6), "exp_downside": -part("p_dn5", 10)}).drop("a_", "b_")


def order_risk_reward(rows: DataFrame) -> DataFrame:
    w = day_window().orderBy(F.desc("rr"), F.asc("p_dn10"), F.desc("p_up10"), F.desc("exp_downside"), "market")
    return rows.withColumn("rk", F.row_number().over(w))


def order_penalised(rows: DataFrame, penalty: float) -> DataFrame:
    return rows.withColumn("pen", F.round(F.col("p_up10") - penalty * F.col("p_dn5"), 6)).withColumn("rk", F.row_number().over(day_window().orderBy(F.desc("pen"), "market")))


def with_dump_flag(rows: DataFrame) -> DataFrame:
    """Dump risk: the mean of two ranks; the top third of a day is flagged."""
    rows = rows.withColumns({"x_": pct_rank("p_dn5", "day"), "y_": pct_rank("uq", "day")}).withColumn("dump_risk", F.round((F.col("x_") + F.coalesce("y_", F.lit(0.5))) / 2, 6))
    return rows.withColumn("dump_pct", pct_rank("dump_risk", "day")).withColumn("dump", F.round("dump_pct", 9) > 0.666666667).drop("x_", "y_")


def reselect(rows: DataFrame, k: int) -> DataFrame:
    """The k first of each day with flagged rows demoted, then in their first order again."""
    chosen = rows.withColumn("slot_", F.row_number().over(day_window().orderBy(F.col("dump").cast("int"), "rk"))).where(F.col("slot_") <= k)
    return chosen.withColumn("rk2", F.row_number().over(day_window().orderBy("rk"))).drop("slot_")


def by_policy(rows: DataFrame, policies: dict[str, str] = POLICIES) -> DataFrame:
    """Each row once for every policy that sends it: one pass, without a join."""
    tags = F.filter(F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in policies.items()]), lambda x: x.isNotNull())
    return rows.withColumn("policy", F.explode(tags))


def per_policy(rows: DataFrame, value: str, policies: dict[str, str] = POLICIES) -> DataFrame:
    """(policy, n, mean): rows that each policy sends and their mean value; one that sends none has n 0 and no mean."""
    sent = by_policy(rows, policies).groupBy("policy").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    names = rows.sparkSession.createDataFrame([(n,) for n in policies], "policy string")
    return names.join(sent, "policy", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def edge(p: Column, target: float = 0.1, loss: float = 0.05, cost: float = 0.0015) -> Column:
    q = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return (q * target - (1 - q) * loss - cost) * 100


def decision(regime: Column, tier: Column, hit: Column, edge_pct: Column) -> Column:
    """(decision, reason)."""
    out = lambda d, why: F.struct(F.lit(d).alias("decision"), F.lit(why).alias("reason"))
    return (
        F.when(regime == "bear_volatile", out("SILENCE", "regime")).when(tier == "NO_PRIMARY", out("WATCH_ONLY", "no_setup")).when(hit.isNull(), out("WATCH_ONLY", "no_evidence"))
        .when(edge_pct <= 0, out("WATCH_ONLY", "edge")).otherwise(out("ACTIVE", "ok"))
    )


def setups(rows: DataFrame) -> DataFrame:
    """The setup rules that fire, and the tier of the set."""
    rules = {"S01": "r7 > 0.02", "S02": "s7 > 1.2", "S03": "r1 > 0 and r3 < 0", "S04": "liq <= 5"}
    fired = F.filter(F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in rules.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("setups", fired)
    has = lambda s: F.array_contains("setups", s)
    tier = F.when(F.size(F.array_intersect("setups", F.array(*map(F.lit, ("S01", "S02", "S04"))))) == 3, "A_TRIPLE").when(has("S03"), "B_S03").when(has("S01") | has("S02"), "C_PRIMARY").otherwise("NO_PRIMARY")
    return rows.withColumn("tier", tier)


def quartile_cell(x: str) -> Column:
    p = F.round(pct_rank(x, "day") * 4, 9)
    return F.least(F.greatest(F.ceil(p) - 1, F.lit(0)), F.lit(3))


def matched_pool(rows: DataFrame, picked: str, value: str, cells: list[str]) -> DataFrame:
    """Picked rows with the mean value of the rows not picked in their cell of the day."""
    pool = rows.where(f"not {picked}").groupBy("day", *cells).agg(F.avg(value).alias("pool_mean"), F.count("*").alias("pool_n"))
    return rows.where(picked).join(pool, ["day", *cells], "left")


def matched_by_hash(rows: DataFrame, picked: str, cell: str, salt: str) -> DataFrame:
    """(day, cell, market, control): the k-th picked row of a cell takes the k-th other row in hash order; none is used twice."""
    key = F.md5(F.concat_ws("|", F.col("day").cast("string"), F.col("market"), F.lit(salt)).cast("binary"))
    w = Window.partitionBy("day", cell).orderBy("h_")
    rows = rows.withColumn("h_", key)
    a = rows.where(picked).withColumn("k_", F.row_number().over(w)).select("day", cell, "k_", "market")
    b = rows.where(f"not {picked}").withColumn("k_", F.row_number().over(w)).select("day", cell, "k_", F.col("market").alias("control"))
    return a.join(b, ["day", cell, "k_"], "left")


def outside_in(rows: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Disjoint pairs of a cell, narrowest with widest: rows i and n + 1 - i; equal values are no pair."""
    w = Window.partitionBy(*cell)
    ranked = rows.withColumns({"i_": F.row_number().over(w.orderBy(value, "market")), "n_": F.count("*").over(w)})
    low = ranked.where(F.col("i_") <= F.floor(F.col("n_") / 2)).select(*cell, "i_", F.col("market").alias("low_market"), F.col(value).alias("low"))
    high = ranked.select(*cell, (F.col("n_") + 1 - F.col("i_")).alias("i_"), F.col("market").alias("high_market"), F.col(value).alias("high"))
    return low.join(high, [*cell, "i_"]).where("low != high")


def best_triple(rows: DataFrame, value: str, costs: list[tuple[str, float]]) -> DataFrame:
    """For each day the three names with the largest total value under the cost budgets, ties by names.

    Triples of one day are formed inside the day's row by array functions, from at most a universe of names: C(n, 3) candidates
    never become rows.
    """
    names = F.array_sort(F.collect_list(F.struct("market", value, *[c for c, _ in costs])))
    days = rows.groupBy("day").agg(names.alias("u"))
    total = " and ".join(f"a.{c} + b.{c} + c.{c} <= {limit}" for c, limit in costs)
    best = f"""aggregate(sequence(0, size(u) - 1), named_struct('v', cast(-1e18 as double), 'x', '', 'y', '', 'z', ''), (best, i) -> aggregate(sequence(i, size(u) - 1), best, (b1, j) ->
      if(j = i, b1, aggregate(slice(u, j + 2, size(u)), b1, (b2, c) -> if({total.replace('a.', 'u[i].').replace('b.', 'u[j].')} and round(u[i].{value} + u[j].{value} + c.{value}, 9) > b2.v,
        named_struct('v', round(u[i].{value} + u[j].{value} + c.{value}, 9), 'x', u[i].market, 'y', u[j].market, 'z', c.market), b2)))))"""
    return days.select("day", F.expr(best).alias("t")).select("day", F.col("t.x").alias("first"), F.col("t.y").alias("second"), F.col("t.z").alias("third"), F.col("t.v").alias("total")).where("first != ''")


def tie_reorder(rows: DataFrame, rank: str, tie: str, flow: str, edge_rank: int = 3) -> DataFrame:
    """rank2: only the tie block across ranks edge/edge+1 is put in flow order, and only if all its members have the flow."""
    block = Window.partitionBy("day", tie)
    r = rows.withColumns({"lo_": F.min(rank).over(block), "hi_": F.max(rank).over(block), "have_": F.count(flow).over(block), "all_": F.count("*").over(block)})
    moved = (F.col("lo_") <= edge_rank) & (F.col("hi_") > edge_rank) & (F.col("have_") == F.col("all_"))
    inside = F.row_number().over(block.orderBy(F.col(flow).desc_nulls_last(), rank)) + F.col("lo_") - 1
    return r.withColumn("rank2", F.when(moved, inside).otherwise(F.col(rank))).drop("lo_", "hi_", "have_", "all_")


def preopen_policy(rows: DataFrame, p: str, composite: str, demoted: bool, target: float = 5.0, loss: float = 3.0, cost: float = 0.15) -> DataFrame:
    """rows (regime, p, composite) with the pre-open channel's decision, blocked_reason and edge_pct, the expected edge in percent.

    A volatile bear market silences the channel; a demoted channel only watches; else a quiet bear market is watched, and strong rows
    of other regimes are sent.
    """
    q = F.least(F.greatest(F.coalesce(F.col(p), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    strong = (F.round(composite, 9) >= 1.5) & (q >= 0.35)
    reason = F.when(F.col("regime") == "bear_volatile", "btc_bear_volatile").when(F.lit(demoted), "preopen_demoted").when(F.col("regime") == "bear_quiet", "bear_quiet_watch").when(strong, "").otherwise("preopen_threshold_watch")
    decision = F.when(F.col("blocked_reason") == "btc_bear_volatile", "SILENCE").when(F.col("blocked_reason") == "", "ACTIVE").otherwise("WATCH_ONLY")
    return rows.withColumns({"blocked_reason": reason, "edge_pct": q * target - (1 - q) * loss - cost}).withColumn("decision", decision)
