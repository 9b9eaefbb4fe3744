"""Market tables from the star-schema tables: deterministic projections, computed by Spark over whole tables.

Prices are whole cents until the last division, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKETS = 20
ROW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_name(key: Column) -> Column:
    return F.concat(F.lit("M"), F.lpad((key % MARKETS).cast("string"), 2, "0"))


def ohlc(rows: DataFrame, by: list[str], order: Column, price: str, quantity: str) -> DataFrame:
    """Bars from (price in cents, whole quantity) rows: one partial aggregate and one shuffle by the keys."""
    return rows.groupBy(*by).agg(
        (F.min_by(price, order) / 100).alias("open"), (F.max(price) / 100).alias("high"), (F.min(price) / 100).alias("low"), (F.max_by(price, order) / 100).alias("close"),
        F.sum(quantity).cast("double").alias("volume"), (F.sum(F.col(price) * F.col(quantity)) / 100).alias("quote_volume"), F.count("*").alias("trades"),
    )


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, day, open, high, low, close, volume, quote_volume, trades): daily bars of 20 markets from lineitem."""
    rows = table(spark, sf_dir, "lineitem").select(
        market_name(F.col("l_suppkey")).alias("market"), F.to_date("l_shipdate").alias("day"), (F.lit(9000) + F.floor("l_extendedprice") % 2000).cast("long").alias("cents"),
        F.col("l_quantity").cast("long").alias("qty"), F.struct(*ROW_ORDER).alias("at"),
    )
    return ohlc(rows, ["market", "day"], F.col("at"), "cents", "qty")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, market, ts, cents, price, side, volume, event_ns, received_ns): trade prints from events, ten markets."""
    e = table(spark, sf_dir, "events")
    cents = (F.lit(10000) + F.round(F.col("value") * 2).cast("long")).alias("cents")
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("event_ns")
    side = F.when(F.col("event_type").isin("purchase", "signup"), "BID").otherwise("ASK").alias("side")
    rows = e.select("event_id", F.concat(F.lit("E"), (F.col("user_id") % 10).cast("string")).alias("market"), "ts", cents, side, F.lit(1).cast("long").alias("qty"), ns)
    return rows.withColumn("price", F.col("cents") / 100).withColumn("volume", F.col("qty").cast("double")).withColumn("received_ns", F.col("event_ns") + F.col("event_id") % 7 * 1000000)


def bars_intraday(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    """(market, ts, open, ..., trades): tumbling bars of the trade prints."""
    rows = trades(spark, sf_dir).withColumn("bar", F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * minutes)) * (60 * minutes)))
    return ohlc(rows, ["market", "bar"], F.struct("ts", "event_id"), "cents", "qty").withColumnRenamed("bar", "ts")


def index_intraday(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    """(ts, open, ..., trades): tumbling bars of all trade prints together, which have no gaps where single markets do."""
    rows = trades(spark, sf_dir).withColumn("bar", F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * minutes)) * (60 * minutes)))
    return ohlc(rows, ["bar"], F.struct("ts", "event_id"), "cents", "qty").withColumnRenamed("bar", "ts")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trade_id, day, coin, model_id, status, net_pct): a ledger of closed and open trades from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("trade_id"), F.to_date("o_orderdate").alias("day"), market_name(F.col("o_custkey")).alias("coin"), F.col("o_orderpriority").alias("model_id"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), (((F.floor("o_totalprice") % 2000).cast("long") - 1000) / 100).alias("net_pct"),
    )


def foreign_1d(bars: DataFrame) -> DataFrame:
    """(symbol, day, close, quote_volume): the same markets on another exchange, under its names and scale."""
    return bars.select(F.regexp_replace("market", "^M", "X").alias("symbol"), "day", (F.col("close") * 2).alias("close"), (F.col("quote_volume") * 3).alias("quote_volume"))
