"""Exit rules walked by hand, early heads, joint labels."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import exit_rules as x

NONE = dict(stop=None, target=None, arm=None, trail=None, hours=None)


def walk(spark, bars, **rule):
    path = [(i, *map(float, b)) for i, b in enumerate(bars)]
    df = spark.createDataFrame([(path, tuple((NONE | rule).values()))], "path array<struct<idx:int,open:double,high:double,low:double,close:double>>, r struct<stop:double,target:double,arm:double,trail:double,hours:double>")
    r = df.select(x.walk_rule(F.col("path"), F.col("r")).alias("x")).first().x
    return (r.outcome, round(r.gross, 6), r.hold_hours, round(r.low_excursion, 6)) if r else None


def test_order_within_a_bar(spark):
    assert walk(spark, [(100, 106, 96, 100)], stop=0.03, target=0.05) == ("sl", -0.03, 0.25, -0.04)
    # The bar's own high arms the trail before its low is tested.
    assert walk(spark, [(100, 104, 101, 102)], stop=0.03, arm=0.03, trail=0.02) == ("trail", round(104 * 0.98 / 100 - 1, 6), 0.25, 0.0)
    assert walk(spark, [(100, 102, 99, 101), (101, 106, 105, 105)], stop=0.03, target=0.05, hours=0.5) == ("tp", 0.05, 0.5, -0.01)
    assert walk(spark, [(100, 102, 99, 101), (101, 102, 100, 101.5), (1, 1, 1, 1)], stop=0.03, target=0.05, hours=0.5) == ("timestop", 0.015, 0.5, -0.01)
    assert walk(spark, [(100, 102, 99, 101), (101, 102, 98, 99)], stop=0.03, target=0.05) == ("eod", -0.01, 0.5, -0.02)


def test_empty_and_zero_entries(spark):
    assert walk(spark, [], stop=0.03) is None and walk(spark, [(0, 1, 0, 1)], stop=0.03) is None
    assert walk(spark, [(100, 101, 99, 100)]) == ("eod", 0.0, 0.25, -0.01)


@pytest.mark.parametrize(
    "rule, regime, atr, want",
    [
        ("baseline", "bull", 0.1, (0.03, 0.05, None, None, None)), ("trail", "bull", 0.1, (0.03, None, 0.03, 0.02, None)), ("time", "bull", 0.1, (0.03, 0.05, None, None, 1.0)),
        ("vol", "", 0.001, (0.015, 0.03, None, None, None)), ("vol", "", 0.5, (0.05, 0.1, None, None, None)), ("vol", "", None, (0.05, 0.1, None, None, None)), ("vol_tight", "", float("nan"), (0.03, 0.1, None, None, None)),
        ("regime", "bear_volatile", None, (0.02, 0.05, None, None, 1.0)), ("regime", "bear_quiet", None, (0.03, 0.05, None, None, 2.0)), ("regime", None, None, (0.04, 0.08, None, None, None)),
    ],
)
def test_parameters(spark, rule, regime, atr, want):
    row = spark.createDataFrame([(rule, regime, atr)], "rule string, regime string, atr double").select(x.rule_parameters(F.col("rule"), F.col("regime"), F.col("atr")).alias("p")).first().p
    assert tuple(None if v is None else round(v, 9) for v in row) == want


PATH = "path array<struct<idx:int,open:double,high:double,low:double,close:double>>, atr double"


def test_early_heads_need_their_bars(spark):
    df = spark.createDataFrame([([(0, 100.0, 103.5, 99.0, 101.0), (1, 101.0, 105.0, 100.0, 104.0)], 0.01), ([], 0.01)], PATH)
    a, b = df.select(*[v.alias(n) for n, v in x.early_heads(F.col("path")).items()]).collect()
    assert (a.first15_3pct, a.first15_5pct, a.first30_3pct, a.first30_5pct, a.first1h_3pct) == (1, 0, 1, 1, None)
    assert set(b) == {None}


def test_joint_labels(spark):
    shared = [(0, 100.0, 111.0, 94.0, 100.0)]
    late = [(0, 100.0, 101.0, 99.0, 100.0), (1, 100.0, 111.0, 99.0, 110.0), (2, 110.0, 111.0, 90.0, 95.0)]
    df = spark.createDataFrame([(shared, 0.01), (late, 0.02), (late, None), (late, 0.0), (late, float("nan"))], PATH)
    got = df.select(*[v.alias(n) for n, v in x.joint_labels(F.col("path"), F.col("atr")).items()]).collect()
    assert (got[0].fp_fixed, got[0].fp_fixed_outcome, got[0].fp_atr_outcome, got[0].path_bracket_outcome) == (0, "down_first", "down_first", "SL")
    assert (got[1].fp_fixed, got[1].fp_atr, got[1].path_up10, got[1].path_dn5, got[1].path_bracket_outcome) == (1, 1, 1, 1, "TP")
    assert [g.fp_atr_outcome for g in got[2:]] == ["invalid_atr"] * 3 and {g.fp_atr for g in got[2:]} == {None}
    assert got[1].path_eod_net == pytest.approx(-0.05 - 0.0015)
