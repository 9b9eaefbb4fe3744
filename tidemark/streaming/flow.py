"""Trade-flow and book features, in batch and as Structured Streaming queries over the same columns.

Trades: event_id, market, ts, price, side, volume, event_ns, received_ns. Clocks that decide what was known
stay whole nanoseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import with_sums_before

ENVELOPE = "capture_id string, channel string, market string, ingress_seq long, received_at_ns long, event_at_ms long, record_type string, raw_payload string"


def raw_records(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Raw envelopes (gzipped JSON lines) of a folder, or of files as they arrive there."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ENVELOPE).json(folder)


def available(trades: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Trades known at each cutoff (both clocks at or before it). cutoffs: (cutoff_ns), few rows, sent to all tasks."""
    return trades.join(F.broadcast(cutoffs), (F.col("event_ns") <= F.col("cutoff_ns")) & (F.col("received_ns") <= F.col("cutoff_ns")))


def available_counts(trades: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """cutoffs (.., cutoff_ns) with n, the trades known at each: one sort of both by the instant at which a trade is known, and counts before."""
    known = trades.select(F.greatest("event_ns", "received_ns").alias("at_"), F.lit(1).alias("one_"), *[F.lit(None).cast(t).alias(c) for c, t in cutoffs.dtypes])
    asked = cutoffs.select(F.col("cutoff_ns").alias("at_"), F.lit(0).alias("one_"), *cutoffs.columns)
    counted = with_sums_before(known.unionByName(asked), [F.col("at_").asc(), F.col("one_").desc()], ["one_"])
    return counted.where("one_ = 0").select(*cutoffs.columns, F.col("one__before").alias("n"))


def imbalance(bid: Column, ask: Column) -> Column:
    """(bid - ask) / (bid + ask); NULL, not zero, without trades."""
    return (bid - ask) / F.nullif(bid + ask, F.lit(0.0))


def side_sums() -> list[Column]:
    notional = F.col("price") * F.col("volume")
    return [F.sum(F.when(F.col("side") == "BID", notional).otherwise(0.0)).alias("bid"), F.sum(F.when(F.col("side") == "ASK", notional).otherwise(0.0)).alias("ask"), F.count("*").alias("n")]


def flow_at_cutoffs(trades: DataFrame, cutoffs: DataFrame, seconds: int) -> DataFrame:
    """Imbalance over [cutoff - seconds, cutoff) for each cutoff and market, both clocks inside. A trade is sent
    to the cutoffs of its day and the next, so trades meet few cutoffs. cutoffs: (day, cutoff_ns)."""
    spread = trades.withColumn("day", F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1)))).join(F.broadcast(cutoffs), "day")
    start = F.col("cutoff_ns") - seconds * 1_000_000_000
    inside = (F.col("event_ns") >= start) & (F.col("event_ns") < F.col("cutoff_ns")) & (F.col("received_ns") >= start) & (F.col("received_ns") < F.col("cutoff_ns"))
    return spread.where(inside).groupBy("day", "market").agg(*side_sums()).withColumn("imbalance", imbalance(F.col("bid"), F.col("ask")))


def sliding_flow(trades: DataFrame, window: str = "6 hours", slide: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """The same feature over sliding windows; works on a stream (append after the watermark) and in batch."""
    return trades.withWatermark("ts", late).groupBy("market", F.window("ts", window, slide).alias("w")).agg(*side_sums()).select("market", F.col("w.start").alias("start"), "n", imbalance(F.col("bid"), F.col("ask")).alias("imbalance"))


def deduplicated(trades: DataFrame, late: str = "1 hour") -> DataFrame:
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["market", "event_id"])


def conflicts(trades: DataFrame) -> DataFrame:
    """Ids that came with different core fields."""
    core = F.struct("price", "volume", "side", "event_ns")
    return trades.groupBy("market", "event_id").agg(F.countDistinct(core).alias("kinds"), F.count("*").alias("n")).where("kinds > 1")


def lateness(trades: DataFrame, cutoff_ns: int, seconds: int) -> DataFrame:
    start = cutoff_ns - seconds * 1_000_000_000
    e, r = F.col("event_ns"), F.col("received_ns")
    return trades.groupBy("market").agg(F.count_if(e < start).alias("before"), F.count_if(e >= cutoff_ns).alias("event_after"), F.count_if((e < cutoff_ns) & (r >= cutoff_ns)).alias("received_after"), F.count_if((e >= start) & (e < cutoff_ns) & (r < cutoff_ns)).alias("inside"))


def last_books(books: DataFrame, cutoff_ns: int) -> DataFrame:
    """The last book of each market by arrival, before the cutoff, with spread, pressure and age; crossed books go."""
    known = books.where((F.col("event_ns") < cutoff_ns) & (F.col("received_ns") < cutoff_ns) & (F.col("bid") <= F.col("ask")))
    last = known.groupBy("market").agg(F.max_by(F.struct("bid", "ask", "bid_size", "ask_size", "event_ns"), "ingress_seq").alias("b"))
    nb, na = F.col("b.bid") * F.col("b.bid_size"), F.col("b.ask") * F.col("b.ask_size")
    return last.select("market", F.col("b.bid").alias("bid"), ((F.col("b.ask") - F.col("b.bid")) / F.col("b.bid")).alias("spread"), ((nb - na) / (nb + na)).alias("pressure"), ((F.lit(cutoff_ns) - F.col("b.event_ns")) / 1e9).alias("age_s"))


def books(trades: DataFrame) -> DataFrame:
    """Best quotes around each print: depth one, sizes from the id."""
    size = lambda k: ((F.col("event_id") * k) % 9 + 1).cast("double")
    return trades.select("market", "ts", "event_ns", "received_ns", (F.col("price") - 0.05).alias("bid"), (F.col("price") + 0.05).alias("ask"), size(1).alias("bid_size"), size(7).alias("ask_size"), F.col("event_id").alias("ingress_seq"), (F.col("event_id") % 3 + 1).alias("depth"))


def ready(books_: DataFrame, universe: DataFrame, deadline_ns: int) -> DataFrame:
    """Markets of the universe and whether their first book came before the deadline."""
    first = books_.groupBy("market").agg(F.min("received_ns").alias("first_ns"))
    return universe.join(first, "market", "left").withColumn("ready", F.coalesce(F.col("first_ns") < deadline_ns, F.lit(False)))


def watermark_table(rows: DataFrame, cutoff_ns: int) -> DataFrame:
    return rows.groupBy("market").agg(F.max("ingress_seq").alias("last_seq"), F.max("event_ns").alias("last_event_ns"), F.max_by("received_ns", "ingress_seq").alias("last_received_ns"), F.count_if(F.col("event_ns") > cutoff_ns).alias("after_cutoff"), F.count("*").alias("n"))


def sequence_breaks(rows: DataFrame) -> DataFrame:
    """Gaps in arrival numbers and receive times that go back, for each market."""
    w = Window.partitionBy("market").orderBy("ingress_seq")
    r = rows.withColumns({"step": F.col("ingress_seq") - F.lag("ingress_seq").over(w), "back": (F.col("received_ns") < F.lag("received_ns").over(w)).cast("int")})
    return r.groupBy("market").agg(F.sum((F.col("step") > 1).cast("int")).alias("gaps"), F.sum("back").alias("backward"), F.max("step").alias("longest_step"))


def sequence_monitor(stream: DataFrame) -> DataFrame:
    """The same checks on a stream: per market the last arrival number and receive time are the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_seq, last_ns, gaps, back = state.get if state.exists else (None, None, 0, 0)
        for part in frames:
            for seq, ns in part.sort_values("ingress_seq")[["ingress_seq", "received_ns"]].itertuples(index=False):
                gaps += last_seq is not None and seq - last_seq > 1
                back += last_ns is not None and ns < last_ns
                last_seq, last_ns = int(seq), int(ns)
        state.update((last_seq, last_ns, int(gaps), int(back)))
        yield pd.DataFrame({"market": [key[0]], "last_seq": [last_seq], "gaps": [int(gaps)], "backward": [int(back)]})

    return stream.groupBy("market").applyInPandasWithState(step, "market string, last_seq long, gaps long, backward long", "last_seq long, last_ns long, gaps long, backward long", "update", "NoTimeout")


def tumbling_bars(trades: DataFrame, width: str = "15 minutes", offset: str = "0 minutes", late: str = "1 hour") -> DataFrame:
    """Candles; on a stream a bar is out when the watermark has passed its end, so only closed bars appear."""
    at = F.struct("ts", "event_id")
    bars = trades.withWatermark("ts", late).groupBy("market", F.window("ts", width, width, offset).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("market", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
