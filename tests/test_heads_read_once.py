"""Model heads work out their rows once, however many fits and passes read them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import heads as h

FOLDS = [("1997-01-01", "1997-01-01", "1997-02-01"), ("1997-02-01", "1997-02-01", "1997-03-01")]


@pytest.fixture
def counted(spark):
    """(rows, how many have been worked out so far)"""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def x(k):
        seen.add(1)
        return float(k * 7 % 11)

    rows = spark.createDataFrame([(dt.date(1996, 11, 1) + dt.timedelta(days=k), "M00", k, float(k % 3 == 0)) for k in range(110)], "day date, market string, k int, y double")
    return rows.withColumn("a", x("k")), seen


def test_sweep_works_rows_out_once(counted):
    rows, seen = counted
    out = h.sweep(rows, FOLDS, {"a": ["a"], "k": ["a", "y"]}, {"logistic": {"kind": "logistic"}}, ["y"], "sweep")
    assert out.groupBy("set", "fold").count().count() == 4 and out.count() == 2 * (31 + 18)
    assert seen.value == 110


def test_walk_forward_works_rows_out_once(counted):
    rows, seen = counted
    out = h.walk_forward(rows, FOLDS, ["a"], "y", "p", "logistic")
    assert out.count() == 31 + 18 and seen.value == 110
