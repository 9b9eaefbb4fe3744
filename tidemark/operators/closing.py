"""Closing of ledgers: open rows whose path is complete become closed, with their exit, their variants and the path's extremes.

A ledger is kept in versions: a run writes a new folder and never touches an old one, and a run that changes nothing writes
none. Paths are laid out once for each (market, start); the rows of a start share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.paths import next_boundary
from tidemark.operators.quality import completeness, flat_filled

COST, PUMP = 0.0015, 0.2
# Exit variants as (target, stop), none where there is none.
VARIANTS: dict[str, tuple[float | None, float | None]] = {
    "tp10_nosl": (0.10, None), "tp5_nosl": (0.05, None), "eod": (None, None), "tp5_sl2": (0.05, 0.02), "tp10_sl5": (0.10, 0.05), "tp8_sl3": (0.08, 0.03),
}
OUTCOMES = ("path_quality", "path_complete", "raw_bars", "filled", "path_start", "execution_entry_open", "entry_price_source", "exit_price", "exit_reason", "realized_pct", "pump_hit", "post_send_pump_hit")


def path_arrays(starts: DataFrame, bars: DataFrame, steps: int, seconds: int) -> DataFrame:
    """(market, start, path): the flat-filled grid of each start in order, as one array of `steps` bars."""
    grid = flat_filled(starts, bars, steps, seconds)
    return grid.groupBy("market", "start").agg(F.array_sort(F.collect_list(F.struct("idx", "open", "high", "low", "close"))).alias("path"))


def first_index(path: Column, hit) -> Column:
    """The place of the first bar for which hit holds; null if none."""
    return F.get(F.filter(path, hit), F.lit(0))["idx"]


def walked(path: Column, stop: Column | float | None, target: Column | float | None) -> Column:
    """struct(gross, reason) of one pass: the stop wins a shared bar; neither: the last close."""
    entry = F.get(path, F.lit(0))["open"]
    none = F.lit(None).cast("int")
    lit = lambda x: F.lit(x) if isinstance(x, float) else x
    i = none if stop is None else first_index(path, lambda b: b["low"] <= entry * (1 - lit(stop)))
    j = none if target is None else first_index(path, lambda b: b["high"] >= entry * (1 + lit(target)))
    last = F.element_at(path, -1)["close"] / entry - 1
    by_stop = i.isNotNull() & (j.isNull() | (i <= j))
    gross = F.when(by_stop, -lit(stop if stop is not None else 0.0)).when(j.isNotNull(), lit(target if target is not None else 0.0)).otherwise(last)
    return F.struct(gross.alias("gross"), F.when(by_stop, "SL").when(j.isNotNull(), "TP").otherwise("EOD").alias("reason"))


def variant_columns(path: Column, cost: float = COST) -> dict[str, Column]:
    """Net percent and reason of each variant, and the path's extremes in percent; four decimals."""
    entry = F.get(path, F.lit(0))["open"]
    out = {}
    for name, (target, stop) in VARIANTS.items():
        x = walked(path, stop, target)
        out[f"exit_{name}_pct"] = F.round((x["gross"] - cost) * 100, 4)
        if target is not None or stop is not None:
            out[f"exit_{name}_reason"] = x["reason"]
    highs, lows = F.transform(path, lambda b: b["high"]), F.transform(path, lambda b: b["low"])
    out["path_max_pct"] = F.round((F.array_max(highs) / entry - 1) * 100, 4)
    out["path_min_pct"] = F.round((F.array_min(lows) / entry - 1) * 100, 4)
    return out


def close_rows(ledger: DataFrame, bars: DataFrame, benchmark: DataFrame, asof: str, decision_day: str | None = None, steps: int = 96, seconds: int = 900, open_hour: int = 9, strict_from: str | None = None, cost: float = COST) -> DataFrame:
    """The ledger with its eligible rows judged; all other rows, and columns that a row had before, stay as they are.

    ledger: trade_id, day, market, status, sl_pct, tp_pct, delivery_ok (boolean), sent_at, decision_completed_at; the outcome columns may lack.
    Eligible are rows of status open or no_data of the decision day (any day, if none is given) before asof. In this order:
    a delivery without a time, one before its decision's second, or (from strict_from on) a row without a decision's end is
    no_data; a failed delivery is not_delivered; the path starts at the first bar after both instants, or at open_hour
    where neither is known, and must be complete; stop and target must be positive numbers. The rest is closed.
    """
    if decision_day is not None and decision_day >= asof:
        raise ValueError(f"decision day {decision_day} isn't over before {asof}")
    names = list(ledger.columns)
    day = F.to_date("day")
    due = F.col("status").isin("open", "no_data") & (day < F.lit(asof).cast("date"))
    due = F.coalesce(due & (day == F.lit(decision_day).cast("date")) if decision_day else due, F.lit(False))
    sent, decided = F.col("sent_at").cast("timestamp"), F.col("decision_completed_at").cast("timestamp")
    strict = (day >= F.lit(strict_from).cast("date")) & decided.isNull() if strict_from else F.lit(False)
    muddled = (F.coalesce("delivery_ok", F.lit(False)) & sent.isNull()) | F.coalesce((sent < decided) & (F.date_trunc("second", sent) != F.date_trunc("second", decided)), F.lit(False)) | strict
    executed = F.greatest(sent, decided)
    start = F.coalesce(next_boundary(executed, seconds), F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + 3600 * open_hour))
    early = F.when(muddled, "invalid_delivery_metadata").when(~F.coalesce("delivery_ok", F.lit(True)), "delivery_failed")
    rows = ledger.withColumns({"due_": due, "early_": F.when(due, early), "start": F.when(due & early.isNull(), start), "source_": F.when(sent.isNotNull(), "open_at_or_after_delivery").when(decided.isNotNull(), "open_at_or_after_decision").otherwise("day_open")})
    starts = rows.where("start is not null").select("market", "start").distinct()
    found = completeness(starts, bars, benchmark, steps, seconds)
    arrays = path_arrays(found.where("path_complete"), bars, steps, seconds)
    # What doesn't depend on a row is worked out once a start.
    fixed = {n: f"v_{n}" for n in variant_columns(F.col("path"), cost)}
    arrays = arrays.select("*", *[v.alias(fixed[n]) for n, v in variant_columns(F.col("path"), cost).items()])
    whole = rows.join(found.select("market", "start", F.col("quality").alias("found_"), F.col("path_complete").alias("whole_"), F.col("raw_bars").alias("raw_"), F.col("filled").alias("filled_")), ["market", "start"], "left").join(arrays, ["market", "start"], "left")
    daily = bars.withColumn("day_", F.to_date(F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) - 3600 * open_hour)))
    daily = daily.groupBy("market", "day_").agg((F.max("high") / F.min_by("open", "ts") - 1 >= PUMP).cast("int").alias("pump_"))
    whole = whole.withColumn("day_", day).join(daily, ["market", "day_"], "left")
    stop, target = F.abs(F.col("sl_pct").cast("double")), F.col("tp_pct").cast("double")
    sound = lambda x: F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))
    quality = F.when(F.col("early_").isNotNull(), F.col("early_")).when(~F.coalesce("whole_", F.lit(False)), F.col("found_")).when(~(sound(stop) & sound(target)), "invalid_exit_contract").otherwise(F.col("found_"))
    closes = F.col("due_") & F.col("early_").isNull() & F.coalesce("whole_", F.lit(False)) & sound(stop) & sound(target)
    whole = whole.withColumns({"quality_": quality, "closes_": closes, "x_": F.when(closes, walked(F.col("path"), stop, target)), "entry_": F.get("path", F.lit(0))["open"]})
    status = F.when(~F.col("due_"), F.col("status")).when(F.col("closes_"), "closed").when(F.col("quality_") == "delivery_failed", "not_delivered").otherwise("no_data")
    price = F.when(F.col("x_.reason") == "SL", F.col("entry_") * (1 - stop)).when(F.col("x_.reason") == "TP", F.col("entry_") * (1 + target)).otherwise(F.element_at("path", -1)["close"])
    post = (F.array_max(F.transform("path", lambda b: b["high"])) / F.col("entry_") - 1 >= PUMP).cast("int")
    judged = F.col("early_").isNull()
    new = {
        "path_quality": (F.col("due_"), F.col("quality_")), "path_complete": (F.col("due_"), F.col("closes_")), "raw_bars": (judged, F.col("raw_")), "filled": (judged, F.col("filled_")),
        "path_start": (closes, F.col("start")), "execution_entry_open": (closes, F.round("entry_", 8)), "entry_price_source": (closes, F.col("source_")), "exit_price": (closes, F.round(price, 8)),
        "exit_reason": (closes, F.col("x_.reason")), "realized_pct": (closes, F.round((F.col("x_.gross") - cost) * 100, 4)), "pump_hit": (closes, F.col("pump_")), "post_send_pump_hit": (closes, post),
    } | {n: (closes, F.col(c)) for n, c in fixed.items()}
    kept = lambda n: F.col(f"`{n}`") if n in names else F.lit(None)
    columns = [F.when(F.col("due_") & when, value).otherwise(kept(n)).alias(n) for n, (when, value) in new.items()]
    return whole.withColumn("status", status).select(*[n for n in names if n not in new], *columns)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the whole versions under root, in order: folders v=N whose write was finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    whole = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(whole)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    found = versions(spark, root)
    if not found:
        raise ValueError(f"no ledger under {root}")
    return spark.read.parquet(f"{root}/v={version or found[-1]}")


def write_version(ledger: DataFrame, root: str) -> int:
    """The next version; trade_id must be there once in each row."""
    repeated = ledger.groupBy("trade_id").agg(F.count("*").alias("n")).where("n > 1 or trade_id is null").limit(1).count()
    if repeated:
        raise ValueError("trade_id is null or repeated")
    version = (versions(ledger.sparkSession, root) or [0])[-1] + 1
    ledger.write.parquet(f"{root}/v={version}")
    return version


def close_batch(spark: SparkSession, root: str, bars: DataFrame, benchmark: DataFrame, asof: str, **kw) -> int | None:
    """Closes what is due in the newest version and writes the next one; returns its number, or None where nothing changes."""
    ledger = read_version(spark, root)
    after = close_rows(ledger, bars, benchmark, asof, **kw)
    shared = [c for c in after.columns if c in ledger.columns]
    before = ledger.select("trade_id", F.struct(*shared).alias("was"))
    added = [c for c in after.columns if c not in ledger.columns]
    is_new = F.lit(False) if not added else F.coalesce(*[F.col(c).isNotNull() for c in added][:1], F.lit(False))
    for c in added[1:]:
        is_new = is_new | F.col(c).isNotNull()
    changed = after.select("trade_id", F.struct(*shared).alias("now"), is_new.alias("new")).join(before, "trade_id").where(~F.col("now").eqNullSafe(F.col("was")) | F.col("new"))
    return None if changed.isEmpty() else write_version(after, root)
