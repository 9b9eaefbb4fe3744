"""The champion of each date: metrics as they stood, a gate, and a challenger that must lead by a margin for days on end.

Ledgers are summed to one row a model and day first; everything after that is a table of the calendar, not of the trades.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Rules(NamedTuple):
    last_days: int = 30
    min_days: int = 30
    min_net: float = 0.0
    deep_loss: float = -5.0
    margin_deep: float = 5.0  # points of the deep-loss share
    margin_net: float = 0.3
    streak: int = 5
    fallback: str | None = None
    barred: tuple[str, ...] = ()  # models that may challenge but never be chosen


RULES = Rules()


def day_sums(ledger: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(model_id, day) of closed rows with a finite net_pct: counts and sums, of complete paths also deep losses. path_complete may be null (no)."""
    net = F.col("net_pct").cast("double")
    rows = ledger.where((F.col("status") == "closed") & net.isNotNull() & ~F.isnan(net) & (F.abs(net) < float("inf")) & F.col("day").isNotNull())
    whole = F.coalesce("path_complete", F.lit(False)).cast("int")
    return rows.groupBy("model_id", "day").agg(
        F.count("*").alias("n"), F.sum(net).alias("net"), F.sum((net > 0).cast("int")).alias("hits"), F.sum(whole).alias("paths"), F.sum(whole * (net <= rules.deep_loss).cast("int")).alias("deep"),
    )


def metrics_as_of(sums: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row a model and date of the calendar (all models' days), from the model's first day on: its last `last_days` own days up to then. deep_freq is the
    share of complete paths, null without any; complete_share of all rows; gate: enough days, enough days with a complete path, a mean net above the least,
    and not barred."""
    w = Window.partitionBy("model_id").orderBy("day").rowsBetween(-(rules.last_days - 1), 0)
    over = lambda c: F.sum(c).over(w)
    own = sums.select(
        "model_id", "day", over("n").alias("n"), F.count("*").over(w).alias("n_days"), over((F.col("paths") > 0).cast("int")).alias("path_days"), over("paths").alias("paths"), over("deep").alias("deep"),
        over("net").alias("net"), over("hits").alias("hits"), F.col("day").alias("last_date"),
    )
    calendar = sums.select("day").distinct().crossJoin(F.broadcast(sums.select("model_id").distinct()))
    carry = Window.partitionBy("model_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    names = [c for c in own.columns if c not in ("model_id", "day")]
    filled = calendar.join(own.select("model_id", "day", F.struct(*names).alias("m")), ["model_id", "day"], "left").withColumn("m", F.last("m", ignorenulls=True).over(carry))
    rows = filled.where("m is not null").select("model_id", "day", "m.*")
    rows = rows.withColumns({"deep_freq": F.col("deep") / F.nullif(F.col("paths"), F.lit(0)), "net_mean": F.col("net") / F.col("n"), "hit": F.col("hits") / F.col("n"), "complete_share": F.col("paths") / F.col("n")})
    allowed = ~F.col("model_id").isin(*rules.barred) if rules.barred else F.lit(True)
    return rows.withColumn("gate", (F.col("n_days") >= rules.min_days) & (F.col("path_days") >= rules.min_days) & (F.round("net_mean", 9) > rules.min_net) & allowed)


def champions(metrics: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(day, champion_id, best_id, streak, reason), a row a date: fallback where nobody passes the gate; the best at once where the champion
    lacks or no longer passes; otherwise the champion stays until one challenger has led it by a margin (deep losses or net) on `streak` dates in
    a row on which that challenger itself had new trades. Best: least deep losses, most net, most hits, then by name.

    A date's champion depends on those before: one fold over dates, a row a date and model.
    """

    def fold(table: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out, champion, rival, count, seen = [], None, None, 0, None
        for day, rows in table.sort_values("day").groupby("day", sort=True):
            known = {r.model_id: r for r in rows.itertuples(index=False)}
            passing = sorted((r for r in known.values() if r.gate), key=lambda r: (round(r.deep_freq, 9), -round(r.net_mean, 9), -round(r.hit, 9), r.model_id))
            best = passing[0] if passing else None
            held = known.get(champion)
            if best is None:
                champion, rival, count, seen, reason = rules.fallback, None, 0, None, "fallback"
            elif held is None or not held.gate:
                champion, rival, count, seen, reason = best.model_id, None, 0, None, "chosen_at_once"
            else:
                leads = best.model_id != champion and (round((held.deep_freq - best.deep_freq) * 100, 9) >= rules.margin_deep or round(best.net_mean - held.net_mean, 9) >= rules.margin_net)
                if not leads:
                    reason = "kept_best" if best.model_id == champion else "kept_margin"
                    rival, count, seen = None, 0, None
                else:
                    if rival != best.model_id:
                        rival, count, seen = best.model_id, 1, best.last_date
                    elif best.last_date > seen:
                        count, seen = count + 1, best.last_date
                    reason = "kept_streak"
                    if count >= rules.streak:
                        champion, reason = best.model_id, "replaced"
            out.append((day, champion, best.model_id if best else None, count, reason))
            if reason == "replaced":
                rival, count, seen = None, 0, None
        return pd.DataFrame(out, columns=["day", "champion_id", "best_id", "streak", "reason"])

    columns = ["model_id", "day", "deep_freq", "net_mean", "hit", "gate", "last_date"]
    return metrics.select(*columns).groupBy().applyInPandas(fold, "day date, champion_id string, best_id string, streak int, reason string")
