"""Policy competition, group summaries, day gates: zero-pick days, empty groups, rules that never fire."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import policies as po

D0 = dt.date(2024, 1, 1)


def day(k: int) -> dt.date:
    return D0 + dt.timedelta(days=k)


ROWS = "day date, market string, rk int, net_pct double, exit_reason string, pump int"


def test_days_without_a_pick_count_for_recall(spark):
    rows = [(day(0), "a", 1, 4.0, "TP", 1), (day(0), "b", 2, -6.0, "SL", 0), (day(1), "a", 5, 1.0, "EOD", 1), (day(1), "b", 6, None, None, 1), (day(2), "a", 1, -1.0, "EOD", None)]
    got = {r.policy: r for r in po.competition(spark.createDataFrame(rows, ROWS), {"one": F.col("rk") <= 1, "two": F.col("rk") <= 2, "none": F.col("rk") < 0, "null": F.lit(None).cast("boolean")}).collect()}
    one, two = got["one"], got["two"]
    assert (one.n, one.n_days, one.selected_days, one.actual, one.captured, one.recall, one.pump_days, one.capture_rate) == (2, 3, 2, 3, 1, pytest.approx(1 / 3), 2, 0.5)
    assert (one.precision, one.tp_rate, one.sl_rate, one.net_sum, one.deep_loss) == (1.0, 0.5, 0.0, 3.0, 0.0)
    assert (two.n, two.precision, two.deep_loss, two.sl_rate) == (3, 0.5, pytest.approx(1 / 3), pytest.approx(1 / 3))
    for name in ("none", "null"):
        assert (got[name].n, got[name].recall, got[name].net_mean, got[name].precision, got[name].actual) == (0, 0.0, None, None, 3)
    assert {r.recall for r in po.competition(spark.createDataFrame([], ROWS), {"one": F.col("rk") <= 1}).collect()} == {None}


def test_group_summary(spark):
    rows = [(day(k), "closed", 1.0 if k % 2 else -0.5, "A") for k in range(30)] + [(day(0), "open", 5.0, "A"), (day(3), "closed", -2.0, None), (day(0), "open", None, "C")]
    df = spark.createDataFrame(rows, "day date, status string, net_pct double, g string")
    got = {(r.dimension, r.value): r for r in po.group_summary(df, {"g": F.col("g"), "all": F.lit("x")}, 20).collect()}
    assert set(got) == {("g", "A"), ("g", "none"), ("g", "C"), ("all", "x")}
    a, none, c = got["g", "A"], got["g", "none"], got["g", "C"]
    assert (a.candidates, a.closed, a.win_rate, a.net_sum, a.tier) == (31, 30, 0.5, 7.5, "PROMOTE_CANDIDATE") and a.mean_low <= 0.0025 <= a.mean_high and a.calendar_days == 30
    assert (none.closed, none.sharpe, none.mean_low, none.tier) == (1, 0.0, None, "COLLECT") and none.max_drawdown == pytest.approx(-0.02)
    assert (c.closed, c.net_mean, c.sharpe, c.tier) == (0, None, None, "DIAGNOSTIC_ONLY")
    assert po.group_summary(df.limit(0), {"g": F.col("g")}, 5).count() == 0


def test_gates(spark):
    days = spark.createDataFrame([(2, 1.0), (0, 0.0), (3, None), (0, 1.0), (None, 1.0), (1, 0.0)], "n int, x double")
    got = {r.rule: r for r in po.gate_sweep(days, {"on": F.col("x") >= 1, "never": F.col("x") > 5, "always": F.col("x") >= 0}, "n", 2).collect()}
    on, never, always = got["on"], got["never"], got["always"]
    assert (on.n, on.base, on.on_rate, on.precision, on.recall, on.lift, on.dead_off) == (4, 0.25, 0.5, 0.5, 1.0, 2.0, 0.5)
    assert (never.n, never.on_rate, never.precision, never.recall, never.lift, never.dead_off) == (4, 0.0, None, None, None, None)
    assert always.on_rate == 1.0 and always.dead_off is None
