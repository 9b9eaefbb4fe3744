"""Path completeness reason by reason, flat filling, and the closing of ledgers, run twice."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import closing as c
from tidemark.operators import quality as q

START = datetime(2024, 1, 2, 9)
BAR = "market string, ts timestamp, open double, high double, low double, close double"
NAN = float("nan")


def at(k: float) -> datetime:
    return START + timedelta(minutes=15 * k)


def bars(spark, market, places, price=100.0, spoil=None):
    rows = [(market, at(k), price, price + 1, price - 1, price) for k in places]
    return spark.createDataFrame(rows + [(market, *r) for r in spoil or []], BAR)


def grade(spark, target, bench, market="T"):
    entries = spark.createDataFrame([(1, market, START)], "entry_id int, market string, start timestamp")
    got = q.completeness(entries, target, bench.drop("market")).collect()
    assert len(got) == 1
    return got[0]


WHOLE = range(97)


@pytest.mark.parametrize(
    "target, bench, reason",
    [
        ([0, 1], [], "benchmark_missing"),
        ([0, 1], range(1, 98), "db_horizon_start_incomplete"),
        ([0, 1], range(96), "db_horizon_end_incomplete"),
        ([0, 1], [*WHOLE, 5.5], "benchmark_off_grid"),
        ([0, 1], [k for k in WHOLE if k != 50], "benchmark_gap"),
        ([0, 1], [*WHOLE, 50], "benchmark_gap"),
        ([], WHOLE, "target_no_observations"),
        ([-1, 96], WHOLE, "target_no_observations"),
        ([0, 3.25], WHOLE, "target_off_grid"),
        ([0, 3, 3], WHOLE, "target_off_grid"),
        ([1, 2], WHOLE, "market_start_horizon_incomplete"),
        ([-5, 1], WHOLE, "flat_filled"),
        ([0], WHOLE, "flat_filled"),
        (range(96), WHOLE, "complete"),
    ],
)
def test_reasons(spark, target, bench, reason):
    got = grade(spark, bars(spark, "T", target).unionByName(bars(spark, "other", [0])), bars(spark, "B", bench))
    assert got.quality == reason and got.path_complete == (reason in q.QUALITIES)
    inside = [k for k in target if 0 <= k < 96]
    assert got.raw_bars == len(inside)
    assert got.filled == (96 - len(set(inside)) if got.path_complete else None)


@pytest.mark.parametrize(
    "bad",
    [(0.0, 1.0, 1.0, 1.0), (100.0, 99.0, 98.0, 100.0), (100.0, 102.0, 101.0, 100.0), (NAN, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (float("inf"), float("inf"), 1.0, 1.0), (-1.0, 1.0, -2.0, 0.5)],
)
def test_unsound_prices(spark, bad):
    got = grade(spark, bars(spark, "T", [0, 1], spoil=[(at(2), *bad)]), bars(spark, "B", WHOLE))
    assert got.quality == "invalid_target_ohlc"


def test_the_first_fault_in_time_decides(spark):
    off = [(at(2.5), 100.0, 101.0, 99.0, 100.0)]
    bad = lambda k: [(at(k), 0.0, 0.0, 0.0, 0.0)]
    bench = bars(spark, "B", WHOLE)
    assert grade(spark, bars(spark, "T", [0], spoil=off + bad(2)), bench).quality == "invalid_target_ohlc"
    assert grade(spark, bars(spark, "T", [0], spoil=off + bad(3)), bench).quality == "target_off_grid"
    # A prior close that is no price doesn't serve a path without its first bar.
    assert grade(spark, bars(spark, "T", [1], spoil=bad(-1)), bench).quality == "market_start_horizon_incomplete"


def test_null_entries_and_empty_tables(spark):
    entries = spark.createDataFrame([(1, None, START), (2, "T", None), (3, "T", START)], "entry_id int, market string, start timestamp")
    none = spark.createDataFrame([], BAR)
    got = {r.entry_id: r.quality for r in q.completeness(entries, none, none.drop("market")).collect()}
    assert got == {1: None, 2: None, 3: "benchmark_missing"}
    assert q.completeness(entries.limit(0), none, none.drop("market")).count() == 0


def test_flat_filling(spark):
    target = bars(spark, "T", [-2], 90.0).unionByName(bars(spark, "T", [2, 4], 100.0))
    starts = spark.createDataFrame([("T", START)], "market string, start timestamp")
    got = q.flat_filled(starts, target, steps=6).orderBy("idx").collect()
    assert [(r.open, r.high, r.close, r.observed) for r in got] == [(90.0, 90.0, 90.0, False)] * 2 + [(100.0, 101.0, 100.0, True), (100.0, 100.0, 100.0, False), (100.0, 101.0, 100.0, True), (100.0, 100.0, 100.0, False)]


LEDGER = "trade_id long, day date, market string, status string, sl_pct double, tp_pct double, delivery_ok boolean, sent_at timestamp, decision_completed_at timestamp, note string"


def ledger(spark):
    day, late = START.date(), START.date() + timedelta(days=5)
    base = lambda i, **k: (i, k.get("day", day), k.get("market", "T"), k.get("status", "open"), k.get("sl", 0.05), k.get("tp", 0.02), k.get("ok"), k.get("sent"), k.get("decided"), f"n{i}")
    return spark.createDataFrame([
        base(1), base(2, tp=0.005), base(3, sl=0.005), base(4, ok=True), base(5, ok=True, sent=START, decided=START + timedelta(minutes=5)),
        base(6, ok=False, sent=START), base(7, market="nowhere"), base(8, sl=None), base(9, sl=0.0), base(10, status="closed"), base(11, day=late), base(12, status="no_data"),
        base(13, ok=True, sent=START + timedelta(minutes=16), decided=START - timedelta(minutes=90)), base(14, ok=True, sent=START, decided=START + timedelta(microseconds=900)), base(15, status=None),
    ], LEDGER)


def test_closing(spark):
    target, bench = bars(spark, "T", range(-10, 140)), bars(spark, "B", range(-10, 140)).drop("market")
    got = {r.trade_id: r for r in c.close_rows(ledger(spark), target, bench, "2024-01-05").collect()}
    status = {i: r.status for i, r in got.items()}
    assert status == {1: "closed", 2: "closed", 3: "closed", 4: "no_data", 5: "no_data", 6: "not_delivered", 7: "no_data", 8: "no_data", 9: "no_data", 10: "closed", 11: "open", 12: "closed", 13: "closed", 14: "closed", 15: None}
    assert (got[1].exit_reason, got[1].realized_pct, got[1].entry_price_source) == ("EOD", -0.15, "day_open")
    assert (got[2].exit_reason, got[2].exit_price, got[2].realized_pct) == ("TP", 100.5, 0.35)
    assert (got[3].exit_reason, got[3].exit_price, got[3].realized_pct) == ("SL", 99.5, -0.65)
    assert {i: got[i].path_quality for i in (4, 5, 6, 7, 8, 9)} == {4: "invalid_delivery_metadata", 5: "invalid_delivery_metadata", 6: "delivery_failed", 7: "target_no_observations", 8: "invalid_exit_contract", 9: "invalid_exit_contract"}
    assert got[13].path_start == at(2) and got[14].path_start == at(1)
    assert got[10].path_quality is None and got[10].exit_reason is None and got[11].path_quality is None
    assert (got[1].exit_tp10_nosl_pct, got[1].exit_tp10_nosl_reason, got[1].path_max_pct, got[1].path_min_pct) == (-0.15, "EOD", 1.0, -1.0)
    assert all(got[i].note == f"n{i}" for i in got)
    only = c.close_rows(ledger(spark), target, bench, "2024-01-09", decision_day="2024-01-07").where("path_quality is not null").collect()
    assert [r.trade_id for r in only] == [11]
    with pytest.raises(ValueError):
        c.close_rows(ledger(spark), target, bench, "2024-01-05", decision_day="2024-01-05")


def test_stop_wins_a_shared_bar(spark):
    rows = [("T", at(k), 100.0, 106.0 if k == 3 else 100.0, 94.0 if k == 3 else 100.0, 100.0) for k in range(96)]
    book = ledger(spark).where("trade_id = 1").withColumn("tp_pct", F.lit(0.05))
    got = c.close_rows(book, spark.createDataFrame(rows, BAR), bars(spark, "B", WHOLE).drop("market"), "2024-01-05").collect()[0]
    assert got.exit_reason == "SL" and got.exit_tp5_nosl_reason == "TP" and got.exit_eod_pct == -0.15


def test_a_second_run_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "ledger")
    target, bench = bars(spark, "T", range(-10, 140)), bars(spark, "B", range(-10, 140)).drop("market")
    assert c.versions(spark, root) == []
    assert c.write_version(ledger(spark), root) == 1
    assert c.close_batch(spark, root, target, bench, "2024-01-05") == 2
    assert c.close_batch(spark, root, target, bench, "2024-01-05") is None
    assert c.versions(spark, root) == [1, 2]
    assert c.read_version(spark, root, 1).where("status = 'closed'").count() == 1
    assert c.read_version(spark, root).where("status = 'closed'").count() == 7
    # A row without data is tried again when its bars have come.
    more = target.unionByName(bars(spark, "nowhere", [0]))
    assert c.close_batch(spark, root, more, bench, "2024-01-05") == 3
    assert c.read_version(spark, root).where("trade_id = 7").first().status == "closed"
    with pytest.raises(ValueError):
        c.write_version(ledger(spark).unionByName(ledger(spark)), root)
