"""Reclaim entries: the gates, the stop first, the reclaim after the first close above the window, paths that are too short."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reclaim as rc

SETUP = rc.Setup(pump=0.1, top=1, window=6, search=3, hold=3, cool=-0.03, atr=0.5, target=0.08)
#: The window after a session that reached 120: cools, contracts, keeps a higher low; mean range 3, so the stop is 103.5.
WINDOW = [(110, 112, 106, 108), (108, 111, 107, 109), (109, 111, 106, 108), (108, 110, 108, 109), (109, 110, 108, 109), (109, 110, 107, 109)]


def run(spark, after, window=WINDOW):
    bars = [(100, 120, 100, 112)] + [(112, 113, 111, 112)] * 5 + window + after
    rows = [("A", dt.datetime(2024, 1, 1, 9) + dt.timedelta(hours=4 * k), *map(float, b), 1.0) for k, b in enumerate(bars)]
    got = rc.reclaims(spark.createDataFrame(rows, "market string, ts timestamp, open double, high double, low double, close double, quote_volume double"), SETUP).collect()
    return {r.session: r for r in got}.get(dt.date(2024, 1, 1))


CALM = [(109, 110, 108, 109)] * 8


def test_gates_and_both_entries(spark):
    mean = sum(h - lo for _, h, lo, _ in WINDOW) / 6
    r = run(spark, CALM)
    assert r.armed and r.stop == pytest.approx(106 - mean / 2) and (r.net_now, r.hit_now, r.broke, r.net_reclaim) == (pytest.approx(-0.0015), None, None, None)
    up = [(109, 110, 108, 109), (109, 114, 108, 113), (113, 123, 112, 121), (121, 122, 120, 121), *CALM]
    r = run(spark, up)
    assert (r.hit_now, r.broke, r.net_now) == (1, 7, pytest.approx(0.08 - 0.0015)) and r.net_reclaim == pytest.approx(0.08 - 0.0015)
    both = [(109, 130, 100, 109), *CALM]
    assert run(spark, both).hit_now == 0 and run(spark, both).net_now == pytest.approx(r.stop / 109 - 1 - 0.0015)


@pytest.mark.parametrize(
    "change, gate",
    [({0: (110, 121, 106, 108)}, "no_new_high"), ({5: (109, 119, 107, 118)}, "cooled"), ({3: (108, 118, 107, 109)}, "contracting"), ({4: (109, 110, 105, 109)}, "higher_low")],
)
def test_each_gate_disarms(spark, change, gate):
    r = run(spark, CALM, [change.get(k, b) for k, b in enumerate(WINDOW)])
    assert not r[gate] and not r.armed and r.net_now is None and r.broke is None


def test_short_paths(spark):
    assert run(spark, CALM[:4]) is None  # the window, the search and one more must be there
    r = run(spark, [(109, 110, 108, 109)] * 2 + [(109, 114, 108, 113)] + CALM[:2])
    assert r.armed and r.broke == 8 and r.net_reclaim is None
    zero = run(spark, [(0, 110, 108, 109), *CALM])
    assert zero.armed and zero.net_now is None
