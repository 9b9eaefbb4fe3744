"""Bounded, repeatable samples of labelled rows: the smallest hashes of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def told_apart(sample: DataFrame, texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of a bounded sample of labelled ids whose id stands there once, and once in texts: any other id says
    nothing sure about a text, and is left out. Reads only the ids of texts."""
    ids = sample.select(id_col)
    here = ids.groupBy(id_col).agg(F.count("*").alias("__tm_n")).where("__tm_n = 1")
    there = texts.select(id_col).join(F.broadcast(ids.distinct()), id_col).groupBy(id_col).agg(F.count("*").alias("__tm_n")).where("__tm_n = 1")
    return sample.join(F.broadcast(here.select(id_col).join(there.select(id_col), id_col)), id_col)


def smallest_hashes(rows: DataFrame, limit: int, by: str | None = None, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """Up to `limit` rows (of each value of `by`) with the smallest hash of the id; the same rows for the same
    data. Pass narrow rows (ids and labels). With `by`, rows whose hash can't be among the smallest (those over
    twice the share that the limit is of the value's count) leave before the window, so a value that most
    rows have is no large group.
    """
    hashed = rows.withColumn("__tm_h", F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)))
    order = [F.col("__tm_h"), F.col(id_col)]
    if by is None:
        return hashed.orderBy(*order).limit(limit).drop("__tm_h")
    counts = rows.groupBy(by).agg(F.count("*").alias("__tm_n"))
    share = F.col("__tm_h") / F.lit(2.0**64) + 0.5
    near = hashed.join(counts, by).where((F.col("__tm_n") <= 2 * limit) | (share <= (2.0 * limit + 50) / F.col("__tm_n")))
    ranked = near.withColumn("__tm_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("__tm_rn") <= limit).drop("__tm_rn", "__tm_h", "__tm_n")
