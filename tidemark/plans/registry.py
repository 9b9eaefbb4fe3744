"""Where queries are registered with their output columns and SQL oracles.

Columns are declared once, as "name:kind" words: s text, d double (rounded to six decimals), l long,
b boolean; adding zero makes minus zero plain zero. Both the Spark result and the oracle are cast to them, so that the engines return the same types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPARK = {"s": lambda c: c.cast("string"), "d": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0), "l": lambda c: c.cast("long"), "b": lambda c: c.cast("boolean")}
DUCK = {"s": "CAST({0} AS VARCHAR)", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0::DOUBLE", "l": "CAST({0} AS BIGINT)", "b": "CAST({0} AS BOOLEAN)"}


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    spec = [c.split(":") for c in columns.split()]

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, sf_dir).select(*[SPARK[k](F.col(c)).alias(c) for c, k in spec])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = "SELECT " + ", ".join(f"{DUCK[k].format(c)} AS {c}" for c, k in spec) + f" FROM ({sql}) q"
        return build

    return register
