"""Exit rules whose parameters depend on a row's volatility and regime, walked over the paths of starts; early-hit heads and joint path labels.

A path is an array of bars (closing.path_arrays); parameters are columns, null where a rule has none, so all rules are one fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.closing import COST, first_index, walked

# The rules, the stop and target of the first, and what volatility is taken to be where it is unknown.
RULES = ("baseline", "trail", "time", "vol", "vol_tight", "regime")
STOP, TARGET, UNKNOWN_ATR = 0.03, 0.05, 0.025
# Six heads as (bars, percent).
EARLY_HEADS = {"first15_3pct": (1, 3), "first15_5pct": (1, 5), "first30_3pct": (2, 3), "first30_5pct": (2, 5), "first1h_3pct": (4, 3), "first1h_5pct": (4, 5)}


def rule_parameters(rule: Column, regime: Column, atr: Column, scale: float = 1.0) -> Column:
    """struct(stop, target, arm, trail, hours) of a rule; null parts don't apply. Unknown volatility counts 2.5 %. scale: of all but the
    volatility itself and the hours, for markets that move less."""
    known = F.coalesce(F.when(~F.isnan(atr) & (F.abs(atr) < float("inf")), atr), F.lit(UNKNOWN_ATR))
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo * scale)), F.lit(hi * scale))
    none = F.lit(None).cast("double")

    def part(stop=None, target=None, arm=None, trail=None, hours=None) -> Column:
        lit = lambda x, s: none if x is None else (F.lit(float(x) * s) if not isinstance(x, Column) else x)
        return F.struct(lit(stop, scale).alias("stop"), lit(target, scale).alias("target"), lit(arm, scale).alias("arm"), lit(trail, scale).alias("trail"), lit(hours, 1).alias("hours"))

    by_regime = F.when(regime == "bear_volatile", part(0.02, TARGET, hours=1)).when(regime == "bear_quiet", part(STOP, TARGET, hours=2)).otherwise(part(0.04, 0.08))
    return (
        F.when(rule == "baseline", part(STOP, TARGET)).when(rule == "trail", part(STOP, arm=0.03, trail=0.02)).when(rule == "time", part(STOP, TARGET, hours=1))
        .when(rule == "vol", part(clip(2 * known, 0.015, 0.05), clip(4 * known, 0.03, 0.10))).when(rule == "vol_tight", part(clip(2 * known, 0.015, STOP), clip(4 * known, 0.03, 0.10)))
        .when(rule == "regime", by_regime)
    )


def walk_rule(path: Column, rule: Column, bars_an_hour: int = 4) -> Column:
    """struct(gross, outcome, hold_hours, low_excursion) of a path under parameters (as rule_parameters has them).

    Of one bar the order is stop, trail, target, time. A bar's own high raises the running high, and arms the trail, before its low is tested.
    The excursion is the lowest price up to and with the exit's bar. An empty path or an entry that is no positive number has nulls.
    """
    entry = F.get(path, F.lit(0))["open"]
    limit = F.round(rule["hours"] * bars_an_hour)
    none = F.lit(None).cast("string")

    def step(acc: Column, b: Column) -> Column:
        high, low, n = F.greatest(acc["high"], b["high"]), F.least(acc["low"], b["low"]), acc["n"] + 1
        armed = high >= entry * (1 + F.coalesce(rule["arm"], F.lit(0.0)))
        trail = high * (1 - rule["trail"])
        told = lambda name, gross: F.struct(F.lit(name).cast("string").alias("outcome"), gross.cast("double").alias("gross"), n.alias("n"), high.alias("high"), low.alias("low"))
        return (
            F.when(acc["outcome"].isNotNull(), acc)
            .when(b["low"] <= entry * (1 - rule["stop"]), told("sl", -rule["stop"]))
            .when(rule["trail"].isNotNull() & armed & (b["low"] <= trail), told("trail", trail / entry - 1))
            .when(b["high"] >= entry * (1 + rule["target"]), told("tp", rule["target"]))
            .when(n >= limit, told("timestop", b["close"] / entry - 1))
            .otherwise(told(None, b["close"] / entry - 1))
        )

    start = F.struct(none.alias("outcome"), F.lit(None).cast("double").alias("gross"), F.lit(0).alias("n"), entry.alias("high"), entry.alias("low"))
    done = F.aggregate(path, start, step)
    out = F.struct(done["gross"].alias("gross"), F.coalesce(done["outcome"], F.lit("eod")).alias("outcome"), (done["n"] / bars_an_hour).alias("hold_hours"), (done["low"] / entry - 1).alias("low_excursion"))
    return F.when((F.size(path) > 0) & (entry > 0), out)


def under_rules(rows: DataFrame, scale: float = 1.0, bars_an_hour: int = 4, cost: float = COST) -> DataFrame:
    """rows (path, regime, atr, ...) once a rule, with its parameters and what it comes to."""
    each = rows.withColumn("rule", F.explode(F.array(*map(F.lit, RULES)))).withColumn("p_", rule_parameters(F.col("rule"), F.col("regime"), F.col("atr"), scale))
    done = each.withColumn("x_", walk_rule(F.col("path"), F.col("p_"), bars_an_hour))
    return done.select(*rows.drop("path").columns, "rule", "p_.*", "x_.*").withColumn("net", F.col("gross") - cost)


def early_heads(path: Column, scale: float = 1.0) -> dict[str, Column]:
    """Six 0/1 heads of a session's first bars; null where it has fewer bars than a head asks for."""
    entry = F.get(path, F.lit(0))["open"]
    top = lambda k: F.array_max(F.transform(F.slice(path, 1, k), lambda b: b["high"]))
    return {name: F.when((F.size(path) >= k) & (entry > 0), (top(k) >= entry * (1 + percent * scale / 100)).cast("int")) for name, (k, percent) in EARLY_HEADS.items()}


def joint_labels(path: Column, atr: Column, scale: float = 1.0, cost: float = COST) -> dict[str, Column]:
    """The labels of one path together: up before down for fixed barriers (10 and 5 %) and for barriers of two and one times the volatility, with outcomes;
    reached levels, excursions, the bracket of 5 and 3 %, and the end. A shared bar is down. Volatility that is not a positive number has outcome invalid_atr."""
    entry = F.get(path, F.lit(0))["open"]
    sound = F.coalesce((atr > 0) & ~F.isnan(atr) & (atr < float("inf")), F.lit(False))

    def passage(up: Column, down: Column) -> Column:
        i, j = first_index(path, lambda b: b["low"] <= entry * (1 - down)), first_index(path, lambda b: b["high"] >= entry * (1 + up))
        return F.when(i.isNotNull() & (j.isNull() | (i <= j)), "down_first").when(j.isNotNull(), "up_first").otherwise("neither")

    fixed, by_atr = passage(F.lit(0.10 * scale), F.lit(0.05 * scale)), passage(2 * atr, atr)
    mfe, mae = F.array_max(F.transform(path, lambda b: b["high"])) / entry - 1, F.array_min(F.transform(path, lambda b: b["low"])) / entry - 1
    bracket = walked(path, 0.03 * scale, 0.05 * scale)
    return {
        "fp_fixed": (fixed == "up_first").cast("int"), "fp_fixed_outcome": fixed, "fp_atr": F.when(sound, (by_atr == "up_first").cast("int")), "fp_atr_outcome": F.when(sound, by_atr).otherwise("invalid_atr"),
        "path_up10": (mfe >= 0.10 * scale).cast("int"), "path_dn5": (mae <= -0.05 * scale).cast("int"), "path_mfe20": (mfe >= 0.20 * scale).cast("int"), "path_mfe": mfe, "path_mae": mae,
        "path_bracket_outcome": bracket["reason"], "path_bracket_net": bracket["gross"] - cost, "path_eod_net": F.element_at(path, -1)["close"] / entry - 1 - cost,
    }
