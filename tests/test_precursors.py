"""Snapshots before the end of a session: exact bars, nothing later, missing bars, prices that can't be divided by."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import paths as p
from tidemark.operators import precursors as pc

START = datetime(2024, 1, 2, 9)
BAR = "market string, ts timestamp, open double, high double, low double, close double, volume double"


def series(spark, minutes, n, market="A", skip=(), first=START - timedelta(days=2), price=lambda k: 100.0 + k):
    rows = [(market, first + timedelta(minutes=minutes * k), price(k), price(k) + 2, price(k) - 1, price(k) + 1, float(1 + k % 3)) for k in range(n) if k not in skip]
    return spark.createDataFrame(rows, BAR)


def none(spark):
    return spark.createDataFrame([], "ts timestamp, bench double")


def test_hourly_values(spark):
    bars = series(spark, 60, 72)
    got = {r.session.day: r for r in pc.snapshot(bars, none(spark), pc.HOURLY).collect()}
    assert sorted(got) == [31, 1, 2] or sorted(got) == [1, 2, 31]
    r, k = got[1], 24 + 22  # the bar of 07:00 in the second session
    volumes = [1.0 + j % 3 for j in range(72)]
    mean = sum(volumes[k - 24 : k]) / 24
    assert r.pre1h_ret == pytest.approx(1 / (100 + k)) and r.pre1h_vol_ratio == pytest.approx(volumes[k] / mean)
    assert r.pre3h_ret == pytest.approx((101 + k) / (100 + k - 2) - 1) and r.pre3h_vol_ratio == pytest.approx(sum(volumes[k - 2 : k + 1]) / (3 * mean))
    assert r.breakout_24h_high == pytest.approx((101 + k) / (102 + k - 1) - 1) and r.close07_vs_day_open == pytest.approx((101 + k) / 124 - 1)
    assert r.cum_volume_to_08h == pytest.approx(sum(volumes[24 : k + 1]) / (23 * mean)) and r.range_5_to_8_expansion == pytest.approx((102 + k - (99 + k - 2)) / (100 + k))
    assert r.pre1h_btc_ret is None and r.pre1h_breadth == 1.0


@pytest.mark.parametrize("spec, minutes", [(pc.HOURLY, 60), (pc.QUARTERS, 15)])
def test_later_bars_change_nothing(spark, spec, minutes):
    n = 3 * 1440 // minutes
    whole = series(spark, minutes, n)
    cut = START + timedelta(minutes=spec.at)  # the third session's snapshot bar
    short, wild = whole.where(F.col("ts") <= F.lit(cut)), whole.withColumn("close", F.when(F.col("ts") > F.lit(cut), 9e9).otherwise(F.col("close"))).withColumn("volume", F.when(F.col("ts") > F.lit(cut), 9e9).otherwise(F.col("volume")))
    a, b, c = (sorted(map(tuple, pc.snapshot(x, none(spark), spec).collect()), key=str) for x in (whole, short, wild))
    assert a == b == c and len(a) == 3


def test_no_snapshot_without_its_bar(spark):
    bars = series(spark, 60, 72, skip=(24 + 22,))
    assert {r.session.day for r in pc.snapshot(bars, none(spark), pc.HOURLY).collect()} == {31, 2}
    assert pc.snapshot(series(spark, 60, 29), none(spark), pc.HOURLY).count() == 0
    assert pc.snapshot(series(spark, 60, 0), none(spark), pc.HOURLY).count() == 0


def test_breadth_benchmark_and_zero_prices(spark):
    bars = series(spark, 60, 72).unionByName(series(spark, 60, 72, "B", price=lambda k: 0.0)).unionByName(series(spark, 60, 72, "C", price=lambda k: 500.0 - k))
    bench = bars.where("market = 'A'").select("ts", "close")
    got = [r for r in pc.snapshot(bars, pc.benchmark_hourly(bench), pc.HOURLY).collect() if r.session.day == 1]
    assert {r.market: r.pre1h_breadth for r in got} == dict.fromkeys("ABC", pytest.approx(2 / 3))
    zero = next(r for r in got if r.market == "B")
    assert zero.pre1h_ret is None and zero.close07_vs_day_open is None and zero.pre1h_close_position == pytest.approx(2 / 3)
    assert all(r.pre1h_btc_ret == pytest.approx((101 + 46) / (101 + 45) - 1) for r in got)


def test_fifth_bar(spark):
    bars = series(spark, 240, 12).unionByName(series(spark, 240, 12, "B", skip=(7,)))
    got = {(r.market, r.session.day): r for r in pc.fifth_bar(bars).collect()}
    assert set(got) == {("A", 31), ("A", 1), ("B", 31), ("B", 1)}
    r = got["A", 31]
    assert r.pre_price_change == pytest.approx(105 / 104 - 1) and r.pre_vol_ratio == pytest.approx(2 / 1.75) and r.pre_day_to_bar5_max == pytest.approx(106 / 100 - 1)
    assert pc.fifth_bar(series(spark, 240, 12, skip=(2, 3))).where("session = date'2023-12-31'").count() == 0


def test_one_path_a_start(spark):
    rows = [("A", START + timedelta(minutes=15 * k), 100.0, 101.0 + k, 99.0, 100.0 + k, 1.0) for k in range(97)]
    bars = spark.createDataFrame(rows, BAR)
    entries = spark.createDataFrame([(i, "A", START if i < 50 else START + timedelta(minutes=15)) for i in range(60)] + [(99, "Z", START)], "entry_id long, market string, start timestamp")
    seen = []

    def fold(q):
        seen.append(q.select("entry_id").distinct().count())
        return p.outcomes(q)

    got = {r.entry_id: r.mfe for r in p.per_start(entries, bars, fold).collect()}
    want = {r.entry_id: r.mfe for r in p.outcomes(p.interval_join(entries, bars)).collect()}
    assert seen == [2] and got == want and len(got) == 60
