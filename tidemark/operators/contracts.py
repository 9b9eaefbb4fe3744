"""Reading, checking and keeping market tables: contracts, upserts, write-once snapshots, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(bars: DataFrame, market: str, since: str, until: str) -> DataFrame:
    """One market in [since, until)."""
    return bars.where((F.col("market") == market) & (F.col("day") >= F.lit(since).cast("date")) & (F.col("day") < F.lit(until).cast("date")))


def market_ranges(bars: DataFrame) -> DataFrame:
    return bars.groupBy("market").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new row where keys meet: keys present in new leave old by an anti join."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def ohlc_reason(tolerance: float = 0.0) -> Column:
    """The first contract rule that a bar breaks, or null."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    all_finite = finite(prices[0]) & finite(prices[1]) & finite(prices[2]) & finite(prices[3])
    return (
        F.when(~all_finite, "not_finite").when((prices[0] <= 0) | (prices[1] <= 0) | (prices[2] <= 0) | (prices[3] <= 0), "not_positive")
        .when(F.col("high") < F.greatest("open", "close") - tolerance, "high_too_low").when(F.col("low") > F.least("open", "close") + tolerance, "low_too_high")
        .when(F.col("volume") < 0, "negative_volume")
    )


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def valid_market(name: Column) -> Column:
    return name.isNotNull() & (F.length(name) <= 32) & name.rlike("^[A-Z0-9][A-Z0-9-]*$")


def fingerprint(rows: DataFrame, by: str, *cols: str) -> DataFrame:
    """An order-free identity of the rows of each group: count, and the sum of leading digest digits of each row."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    return rows.groupBy(by).agg(F.count("*").alias("n"), (F.sum(part.cast("decimal(38,0)")) % 1000000007).cast("long").alias("digest"))


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Writes a snapshot that isn't there yet; else checks that it holds the same rows, and fails if not."""
    spark: SparkSession = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        df.write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)
    old = spark.read.schema(df.schema).parquet(path)
    if old.exceptAll(df).limit(1).count() or df.exceptAll(old).limit(1).count():
        raise ValueError(f"a different snapshot is kept at {path}")
    return old


def append_new(ledger: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the ledger lacks; raises where a key is there with other values."""
    common = rows.join(ledger.select(*keys).distinct(), keys, "left_semi")
    if common.exceptAll(ledger.select(*rows.columns)).limit(1).count():
        raise ValueError("a kept row would change")
    return rows.join(ledger.select(*keys).distinct(), keys, "left_anti")


def write_summary(df: DataFrame, folder: str) -> None:
    """One table as parquet, csv and json."""
    for kind in ("parquet", "csv", "json"):
        df.write.mode("overwrite").format(kind).option("header", True).save(f"{folder}/{kind}")


def bar_gaps(bars: DataFrame) -> DataFrame:
    """Rows, span and gaps of each market."""
    w = Window.partitionBy("market").orderBy("day")
    rows = bars.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    return rows.groupBy("market").agg(F.count("*").alias("n"), F.datediff(F.max("day"), F.min("day")).alias("span"), F.sum((F.col("gap") > 1).cast("int")).alias("gaps"), F.max("gap").alias("longest_gap"))
