"""Risk-adjusted figures, extremes, contributions and sweeps: no losses, one trade, ties, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import returns as rt

D0 = dt.date(2024, 1, 1)


def day(k: int) -> dt.date:
    return D0 + dt.timedelta(days=k)


def figures(spark, nets):
    trades = spark.createDataFrame([("s", x) for x in nets], "series string, net double")
    rets = spark.createDataFrame([("s", day(k), (x or 0.0) / 100) for k, x in enumerate(nets)], "series string, day date, ret double")
    return rt.risk_adjusted(rets, trades).collect()


def test_figures_that_need_losses(spark):
    r = figures(spark, [1.0, 2.0])[0]
    assert (r.calmar, r.profit_factor, r.win_loss) == (None, None, None) and r.max_drawdown == 0.0 and r.annualized > 1 and r.common_sense is None
    r = figures(spark, [2.0, -1.0, 3.0])[0]
    assert (r.profit_factor, r.win_loss) == (5.0, 2.5) and r.calmar == pytest.approx(r.annualized / 0.01)
    assert r.common_sense == pytest.approx(5.0 * r.tail_ratio)
    r = figures(spark, [0.0, 0.0])[0]
    assert (r.cumulative, r.tail_ratio, r.profit_factor) == (0.0, None, None)
    r = figures(spark, [-1.0, None])[0]
    assert r.profit_factor == 0.0 and r.win_loss is None
    assert figures(spark, []) == []


def test_extreme_trades(spark):
    rows = [(i, D0, "A", "closed", x) for i, x in enumerate([1.0, 5.0, 5.0, -2.0, None])] + [(9, D0, "A", "open", 99.0), (7, D0, "B", "closed", 0.5)]
    got = {(r.model_id, r.side, r.place): r.trade_id for r in rt.extreme_trades(spark.createDataFrame(rows, "trade_id int, day date, model_id string, status string, net_pct double"), 2).collect()}
    assert got == {("A", "best", 1): 1, ("A", "best", 2): 2, ("A", "worst", 1): 3, ("A", "worst", 2): 0, ("B", "best", 1): 7, ("B", "worst", 1): 7}


def test_contributions_sum_to_the_mean(spark):
    picks = [(day(0), "a", 1, 0.1), (day(0), "b", 1, 0.3), (day(0), "a", -1, 0.1), (day(1), "b", 1, -0.2), (day(1), "c", -1, 0.2), (day(9), "z", 1, 9.0)]
    df = spark.createDataFrame(picks, "day date, coin string, arm int, value double")
    days = spark.createDataFrame([(day(0),), (day(1),)], "day date")
    got = {r.coin: r for r in rt.contributions(df, days).collect()}
    assert set(got) == set("abc")
    assert sum(r.contribution for r in got.values()) == pytest.approx(((0.2 - 0.1) + (-0.2 - 0.2)) / 2)
    assert got["c"].place == 1 and got["c"].contribution == pytest.approx(-0.1) and sum(r.share for r in got.values()) == pytest.approx(1.0)
    assert rt.contributions(df.limit(0), days).count() == 0


def test_sweep(spark):
    rows = spark.createDataFrame([(day(0), 0.05, -0.01), (day(0), 0.02, 0.01), (day(1), 0.05, 0.04)], "day date, best double, close double")
    got = {(r.target, r.cost): r for r in rt.target_cost_sweep(rows, [0.05, 0.1], [0.0, 0.02]).collect()}
    assert got[0.05, 0.0].mean_net == pytest.approx((0.05 + 0.01 + 0.05) / 3) and got[0.05, 0.02].win == pytest.approx(2 / 3)
    assert got[0.1, 0.0].cumulative == pytest.approx(1.0 * 1.04 - 1) and got[0.1, 0.0].n == 3
    assert rt.target_cost_sweep(rows.where(F.lit(False)), [0.05], [0.0]).count() == 0
