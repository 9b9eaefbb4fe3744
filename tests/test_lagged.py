"""Lagged features: nothing of the row's own day, full frames, gaps, zero prices, ties."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lagged as lg

D0 = dt.date(2024, 1, 1)


def day(k: int) -> dt.date:
    return D0 + dt.timedelta(days=k)


BARS = "market string, day date, open double, high double, low double, close double, quote_volume double"


def bars(spark, closes, market="A"):
    return spark.createDataFrame([(market, day(k), c, c + 1, c - 1, c, 10.0 * (k + 1)) for k, c in enumerate(closes)], BARS)


def test_the_own_day_changes_nothing(spark):
    closes = [100.0 + (k * 7) % 11 for k in range(30)]
    a, b = (sorted(map(tuple, x.where(F.col("day") == day(29)).collect()), key=str) for x in (lg.semivolatilities(bars(spark, closes)), lg.semivolatilities(bars(spark, [*closes[:-1], 1.0]))))
    assert a == b
    a, b = (x.where(F.col("day") == day(29)).drop("day").first() for x in (lg.day_context(bars(spark, closes)), lg.day_context(bars(spark, [*closes[:-1], 1.0]))))
    assert a == b and a.d1_close == closes[28] and a.ret_5d == pytest.approx(closes[28] / closes[23] - 1)


def test_semivolatility_needs_full_frames(spark):
    got = {(r.day - D0).days: r for r in lg.semivolatilities(bars(spark, [100.0, 90.0, 99.0] * 8)).collect()}
    assert got[7].downside_semivol_7 is None and got[8].downside_semivol_7 is not None and got[21].downside_semivol_21 is None and got[22].semivol_asym_21 is not None
    rets = [c / b - 1 for b, c in zip(([100.0, 90.0, 99.0] * 8), ([100.0, 90.0, 99.0] * 8)[1:])]
    assert got[8].downside_semivol_7 == pytest.approx(math.sqrt(sum(min(r, 0) ** 2 for r in rets[:7]) / 7))
    assert not got[0].known and got[0].source_day is None and got[1].known and got[1].source_day == D0
    zero = lg.semivolatilities(bars(spark, [0.0] * 10)).collect()
    assert {r.downside_semivol_7 for r in zero} == {None}


def test_context_ranks(spark):
    three = bars(spark, [100.0 + k for k in range(20)]).unionByName(bars(spark, [200.0 - k for k in range(20)], "B")).unionByName(bars(spark, [50.0] * 20, "C").withColumn("quote_volume", F.lit(None).cast("double")))
    got = {r.market: r for r in lg.day_context(three).where(F.col("day") == day(19)).collect()}
    assert (got["A"].liq_rank, got["B"].liq_rank, got["C"].liq_rank) == (1, 1, 2)
    assert (got["A"].roc7_rank, got["C"].roc7_rank, got["B"].roc7_rank) == (1.0, pytest.approx(2 / 3), pytest.approx(1 / 3))
    first = {r.market: r for r in lg.day_context(three).where(F.col("day") == D0).collect()}
    assert first["A"].roc7_rank is None and first["A"].d1_close is None


def test_trends(spark):
    days = spark.createDataFrame([(day(k), float(k), k, 0.5, 0.0, 1.0) for k in range(40)], "day date, breadth double, pumps int, adv_ratio double, med_ret double, turnover double")
    bench = spark.createDataFrame([(day(k), 0.01, 0.0, 0.0) for k in range(39)], "day date, bench_1 double, bench_3 double, bench_7 double")
    got = {(r.day - D0).days: r for r in lg.market_trends(days, bench).collect()}
    assert got[3].breadth_ma3 == 1.0 and got[2].breadth_ma3 is None and got[39].breadth_3_14 == pytest.approx(37.0 - 31.5) and got[30].turnover_7_30 == pytest.approx(1.0) and got[29].turnover_z30 is None
    assert got[39].decoupling == pytest.approx(0.45) and got[0].decoupling is None


def test_contractions(spark):
    rows = [("A", dt.datetime(2024, 1, 1, 9) + dt.timedelta(hours=4 * k), 100.0, 102.0 if k < 42 else 101.0, 98.0 if k < 42 else 99.0, 100.0) for k in range(90)]
    table = spark.createDataFrame(rows, "market string, ts timestamp, open double, high double, low double, close double")
    got = {r.session: r for r in lg.contractions(table).collect()}
    last = got[max(got)]
    assert last.rc4h_7d == pytest.approx(4 / 2, rel=1e-6) or last.rc4h_7d == pytest.approx(1.0, rel=1e-6)
    assert last.rc4h_14d is None and last.rc4h_atr_pct == pytest.approx(0.02)
    assert min(got) == dt.date(2024, 1, 7)  # bar 36 is the first with more than twice eighteen
    assert lg.contractions(table.where(F.col("ts") < "2024-01-10")).count() == 0
