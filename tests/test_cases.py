"""Hand-built cases: boundaries, ties, nulls, empty tables, and streams against batches."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import last_rank, pct_rank, qcut_bucket, roll
from tidemark.operators import contracts, evaluate, features, notices, paths, portfolio, ranks, selection, splits
from tidemark.sources.adapters import trades
from tidemark.streaming import flow

T0 = dt.datetime(2024, 1, 1, 9, 0)


def path_rows(spark, bars, entry_id=1):
    """bars: (open, high, low, close) by index."""
    return spark.createDataFrame([(entry_id, i, *map(float, b)) for i, b in enumerate(bars)], "entry_id long, idx long, open double, high double, low double, close double")


@pytest.mark.parametrize("seen,want", [("09:10:00", "09:15:00"), ("09:15:00", "09:30:00"), ("09:15:00.000001", "09:30:00")])
def test_next_boundary_is_strictly_after(spark, seen, want):
    df = spark.sql(f"SELECT timestamp_ntz '2024-01-01 {seen}' AS t").select(F.date_format(paths.next_boundary(F.col("t")), "HH:mm:ss"))
    assert df.first()[0] == want


@pytest.mark.parametrize(
    "bars,reason,gross",
    [
        ([(100, 106, 96, 100)], "sl", -0.03),  # both in one bar: the stop wins
        ([(100, 101, 96, 97), (97, 110, 97, 109)], "sl", -0.03),  # a late rise after a stop
        ([(100, 106, 99, 104)], "tp", 0.05),
        ([(100, 101, 99, 100.5), (100, 102, 99, 101)], "eod", 0.01),
    ],
)
def test_first_touch(spark, bars, reason, gross):
    r = paths.first_touch(path_rows(spark, bars), 0.03, 0.05).first()
    assert r.reason == reason and abs(r.gross - gross) < 1e-9


def test_one_armed_ladder_equals_first_touch(spark):
    for bars in ([(100, 106, 99, 104)], [(100, 101, 96, 97)], [(100, 102, 99, 101)]):
        one = paths.ladder(path_rows(spark, bars), 0.03, [(0.05, 1.0)]).first()
        assert abs(one.gross - paths.first_touch(path_rows(spark, bars), 0.03, 0.05).first().gross) < 1e-9
    two = paths.ladder(path_rows(spark, [(100, 103, 99, 102), (102, 102, 96, 97)]), 0.03, [(0.02, 0.5), (0.05, 0.5)]).first()
    assert abs(two.gross - (0.5 * 0.02 - 0.5 * 0.03)) < 1e-9 and two.n_sell == 2 and two.floored
    floor_first = paths.ladder(path_rows(spark, [(100, 106, 96, 100)]), 0.03, [(0.05, 1.0)]).first()
    assert abs(floor_first.gross + 0.03) < 1e-9


def test_trailing_raises_its_high_before_the_same_bar(spark):
    r = paths.trailing(path_rows(spark, [(100, 104, 100, 103), (103, 108, 105, 106)]), 0.05, 0.02, 0.05, 0.2, 90).first()
    assert r.reason == "trail" and abs(r.gross - (108 * 0.98 / 100 - 1)) < 1e-9


def test_exit_ignores_later_bars(spark):
    bars = [(100, 101, 99, 100), (100, 106, 99, 105), (105, 120, 50, 60)]
    a, b = (paths.first_touch(path_rows(spark, x), 0.03, 0.05).first() for x in (bars, bars[:2]))
    assert (a.reason, a.gross) == (b.reason, b.gross)


def test_ranks_with_ties_one_row_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), ("c", None)], "day string, v double")
    got = sorted((r.day, r.v, r.p) for r in df.withColumn("p", pct_rank("v", "day")).collect() if r.v is not None)
    assert got == [("a", 1.0, 0.5), ("a", 1.0, 0.5), ("a", 3.0, 1.0), ("b", 5.0, 1.0)]
    assert df.withColumn("p", pct_rank("v", "day")).where("day = 'c'").first().p is None


def test_quantile_buckets(spark):
    for n, q in ((10, 4), (3, 10), (1, 5)):
        df = spark.range(1, n + 1).withColumn("b", qcut_bucket(F.col("id"), F.lit(n), q))
        want = [max(0, -(-(i - 1) * q // (n - 1)) - 1) if n > 1 else 0 for i in range(1, n + 1)]
        assert [r.b for r in df.orderBy("id").collect()] == want


def test_global_buckets_equal_one_window(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("market"), F.lit("d").alias("day"), ((F.col("id") * 37) % 101 / 10).alias("score"))
    got = {r.market: r.bucket for r in ranks.global_buckets(df, "score", 7, "day", "market").collect()}
    order = sorted(got, key=lambda m: (int(m) * 37 % 101 / 10, m))
    assert all(got[m] == max(0, -(-i * 7 // 499) - 1) for i, m in enumerate(order))


def test_rolling_guards_and_rank(spark):
    df = spark.createDataFrame([("m", i, None if i == 2 else float(i)) for i in range(5)], "market string, day int, v double")
    got = [r.s for r in df.withColumn("s", roll(F.avg, "v", 3, 2)).orderBy("day").collect()]
    assert got == [None, 0.5, 0.5, 2.0, 3.5]
    assert spark.sql("SELECT array(1D, 3D, null, 3D) AS a").select(last_rank(F.col("a"))).first()[0] == pytest.approx(2.5 / 3)


def test_contract_reasons(spark):
    rows = [(1.0, 2.0, 0.5, 1.5, 1.0), (1.0, 1.2, 0.5, 1.5, 1.0), (1.0, 2.0, 1.1, 1.5, 1.0), (-1.0, 2.0, 0.5, 1.5, 1.0), (float("nan"), 2.0, 0.5, 1.5, 1.0), (1.0, 2.0, 0.5, 1.5, -1.0), (None, 2.0, 0.5, 1.5, 1.0)]
    df = spark.createDataFrame(rows, "open double, high double, low double, close double, volume double").withColumn("r", contracts.ohlc_reason())
    assert [r.r for r in df.collect()] == [None, "high_too_low", "low_too_high", "not_positive", "not_finite", "negative_volume", "not_finite"]


def test_write_once_and_append(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y")], "k int, v string")
    assert contracts.write_once(a, str(tmp_path / "s")).collect() == contracts.write_once(a, str(tmp_path / "s")).collect()
    with pytest.raises(ValueError):
        contracts.write_once(b, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        contracts.append_new(a, b, ["k"])
    assert contracts.append_new(a, spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string"), ["k"]).collect() == [(2, "z")]


def test_portfolio_idle_days_and_first_loss(spark):
    rows = [(1, dt.date(2024, 1, 1), "c", "m", "closed", -10.0), (2, dt.date(2024, 1, 4), "c", "m", "closed", 5.0), (3, dt.date(2024, 1, 6), "c", "m", "open", 50.0)]
    led = spark.createDataFrame(rows, "trade_id long, day date, coin string, model_id string, status string, net_pct double")
    e = portfolio.equity(portfolio.daily_returns(led)).orderBy("day").collect()
    assert [r.ret for r in e] == [-0.1, 0.0, 0.0, 0.05] and abs(e[0].drawdown + 0.1) < 1e-9
    assert portfolio.daily_returns(led, until="2024-01-02").count() == 1
    assert portfolio.daily_returns(led.limit(0)).count() == 0
    assert portfolio.ratios(portfolio.daily_returns(led.where("trade_id = 1"))).first().sharpe == 0.0


def test_normal_cdf(spark):
    got = spark.sql("SELECT 0D AS a, 1.96D AS b, -1.96D AS c").select(*[portfolio.normal_cdf(F.col(x)) for x in "abc"]).first()
    assert got[0] == pytest.approx(0.5, abs=1e-7) and got[1] == pytest.approx(0.9750021, abs=1e-6) and got[2] == pytest.approx(0.0249979, abs=1e-6)


def test_macd_equals_pandas(spark):
    closes = [100 + (i * 37 % 11) for i in range(60)]
    df = spark.createDataFrame([("m", dt.date(2024, 1, 1) + dt.timedelta(i), float(c)) for i, c in enumerate(closes)], "market string, day date, close double")
    last = features.with_macd(df).orderBy(F.desc("day")).first()
    ema = lambda xs, n: [x := xs[0]] + [x := x + (v - x) * 2 / (n + 1) for v in xs[1:]]
    m = [a - b for a, b in zip(ema(closes, 12), ema(closes, 26))]
    assert last.macd == pytest.approx(m[-1]) and last.macdhist == pytest.approx(m[-1] - ema(m, 9)[-1])


def test_walk_forward_has_no_overlap(spark):
    days = spark.range(400).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    f = splits.walk_forward(days, 4, 5, 50)
    edge = f.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("day"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("day"))).alias("b")).collect()
    assert len(edge) == 4 and all((r.b - r.a).days > 5 for r in edge)


def test_bootstrap_repeats_and_covers(spark):
    days = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") % 7).cast("double").alias("x"))
    a, b = (splits.interval(splits.bootstrap(days, "x", 100, 3, 5)).first() for _ in range(2))
    mean = days.agg(F.avg("x")).first()[0]
    assert a == b and a.low < mean < a.high


def test_budget_triple_and_pairs(spark):
    rows = [("d", m, v, c) for m, v, c in (("a", 9.0, 5.0), ("b", 8.0, 1.0), ("c", 7.0, 1.0), ("e", 6.0, 1.0))] + [("s", "a", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "day string, market string, value double, cost double")
    assert selection.best_triple(df, "value", [("cost", 4.0)]).collect() == [("d", "b", "c", "e", 21.0)]
    tied = spark.createDataFrame([("d", "x", 1.0), ("d", "y", 1.0), ("d", "z", 2.0), ("d", "w", 3.0), ("d", "v", 4.0)], "day string, market string, v double")
    assert sorted((r.low, r.high) for r in selection.outside_in(tied, ["day"], "v").collect()) == [(1.0, 3.0), (1.0, 4.0)]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "p double, y int")
    assert evaluate.auc(df, "p", "y").first().auc == pytest.approx(0.875)
    assert evaluate.auc(df.where("y = 1"), "p", "y").first().auc is None


NOTICES = [
    ("레이븐코인(RVN) 거래지원 종료 안내 (10/12 15:00)", dt.datetime(2024, 10, 1)), ("에이(AAA), 비(BBB) 거래지원 종료 안내 (10/19 15:30)", dt.datetime(2024, 10, 1)),
    ("레이븐코인(RVN) 거래지원 종료 안내 (10/12 15:00) (일정 연장 안내: 10/20 15:00)", dt.datetime(2024, 10, 5)), ("비(BBB) 거래지원 종료 결정 철회 안내", dt.datetime(2024, 10, 3)),
    ("썬더코어(TT) 거래지원 종료 안내 (거래지원 종료 일정 변경 안내)", dt.datetime(2024, 10, 1)), ("씨(CCC) BTC 마켓 거래지원 종료 안내 (10/12 15:00)", dt.datetime(2024, 10, 1)),
    ("디(DDD) KRW, BTC 마켓 거래지원 종료 안내 (1/5 15:00)", dt.datetime(2024, 12, 20)), ("이(EEE) 거래지원 종료 안내 (12/28 15:00)", dt.datetime(2025, 1, 3)),
    ("에프(FFF) 거래지원 종료 안내 (출금 지원 종료: 11/12 15:00)", dt.datetime(2024, 10, 1)), ("지(GGG) 거래지원 종료 안내 (09/01 09:00 ~) (거래지원 종료: 09/20 15:00)", dt.datetime(2024, 8, 25)),
    ("에이치(HHH) 거래지원 종료 안내 (13/45 15:00)", dt.datetime(2024, 10, 1)), ("아이(III) 신규 상장 (10/12 15:00)", dt.datetime(2024, 10, 1)), ("거래지원 종료 (JJJ)", dt.datetime(2024, 10, 1)), (None, dt.datetime(2024, 10, 1)),
]


def test_notices(spark):
    p = notices.parsed(spark.createDataFrame(NOTICES, "title string, listed_at timestamp"))
    d = dt.datetime
    got = {(r.symbol, r.listed_at): (r.ends_at, r.cancelled, r.undated_until) for r in p.collect()}
    assert got == {
        ("RVN", d(2024, 10, 1)): (d(2024, 10, 12, 15), False, None), ("AAA", d(2024, 10, 1)): (d(2024, 10, 19, 15, 30), False, None), ("BBB", d(2024, 10, 1)): (d(2024, 10, 19, 15, 30), False, None),
        ("RVN", d(2024, 10, 5)): (d(2024, 10, 20, 15), False, None), ("BBB", d(2024, 10, 3)): (None, True, None), ("TT", d(2024, 10, 1)): (None, False, d(2024, 11, 15)), ("DDD", d(2024, 12, 20)): (d(2025, 1, 5, 15), False, None),
        ("EEE", d(2025, 1, 3)): (d(2024, 12, 28, 15), False, None), ("FFF", d(2024, 10, 1)): (None, False, d(2024, 11, 15)), ("GGG", d(2024, 8, 25)): (d(2024, 9, 20, 15), False, None), ("HHH", d(2024, 10, 1)): (None, False, d(2024, 11, 15)),
    }
    asked = [("RVN", d(2024, 10, 15)), ("RVN", d(2024, 10, 21)), ("AAA", d(2024, 9, 30)), ("AAA", d(2024, 10, 1)), ("BBB", d(2024, 10, 2)), ("BBB", d(2024, 10, 4)), ("TT", d(2024, 11, 14)), ("TT", d(2024, 11, 16)), ("CCC", d(2024, 10, 2)), ("DDD", d(2025, 1, 2)), ("ZZZ", d(2024, 1, 1))]
    rows = notices.in_force(spark.createDataFrame([(*a, 5) for a in asked], "symbol string, decided_at timestamp, extra int"), p).collect()
    active = {(r.symbol, r.decided_at): r.active for r in rows}
    assert len(rows) == len(asked) and [active[a] for a in asked] == [True, False, False, True, True, False, True, False, False, True, False]


def trade_rows(spark, extra=()):
    s = lambda sec: 1704067200 * 10**9 + sec * 10**9
    rows = [(1, "A", s(0), s(0), "BID", 10.0, 1.0), (2, "A", s(299), s(300), "ASK", 10.0, 1.0), (3, "A", s(300), s(300), "BID", 10.0, 5.0), (4, "B", s(10), s(11), "ASK", 3.0, 2.0), *extra]
    df = spark.createDataFrame(rows, "event_id long, market string, event_ns long, received_ns long, side string, price double, volume double")
    return df.withColumn("ts", F.timestamp_micros((F.col("event_ns") / 1000).cast("long")).cast("timestamp_ntz"))


def test_flow_bounds_and_causality(spark):
    cut = spark.createDataFrame([("2024-01-01", (1704067200 + 300) * 10**9)], "day string, cutoff_ns long").withColumn("day", F.to_date("day"))
    got = {r.market: r.imbalance for r in flow.flow_at_cutoffs(trade_rows(spark), cut, 300).collect()}
    assert got == {"A": 1.0, "B": -1.0}  # the print received at the cutoff and the one after it are out
    late = [(9, "A", (1704067200 + 400) * 10**9, (1704067200 + 400) * 10**9, "ASK", 99.0, 9.0)]
    assert {r.market: r.imbalance for r in flow.flow_at_cutoffs(trade_rows(spark, late), cut, 300).collect()} == got


def test_conflicting_ids(spark):
    again = [(1, "A", 1704067200 * 10**9, 1704067200 * 10**9, "BID", 11.0, 1.0), (4, "B", (1704067200 + 10) * 10**9, (1704067200 + 12) * 10**9, "ASK", 3.0, 2.0)]
    assert [r.event_id for r in flow.conflicts(trade_rows(spark, again)).collect()] == [1]


def run_stream(spark, sf, build, mode, extra=None):
    """Writes the trades in files by time, streams them, and returns what came out."""
    src, out = tempfile.mkdtemp(prefix="spark-"), f"mem_{abs(hash((build, mode))) % 10**8}"
    t = trades(spark, sf).select("event_id", "market", F.col("ts").cast("timestamp").alias("ts"), "price", "side", "volume", "event_ns", "received_ns", F.col("event_id").alias("ingress_seq"))
    t = t if extra is None else t.unionByName(extra(t))
    for k in range(4):  # one file after the other, in order of time
        t.where(F.floor((F.dayofmonth("ts") - 1) / 8) == k).coalesce(1).sortWithinPartitions("event_ns").write.mode("append").parquet(src)
    q = build(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    q.processAllAvailable()
    q.stop()
    return t, spark.table(out)


def test_streamed_bars_equal_batch_bars(spark, sf):
    t, got = run_stream(spark, sf, lambda s: flow.tumbling_bars(s, late="0 seconds"), "append")
    want = {tuple(r) for r in flow.tumbling_bars(t).collect()}
    have = {tuple(r) for r in got.collect()}
    assert have and have <= want and len(want) - len(have) <= 20  # the last bars are still open


def test_streamed_dedup_equals_batch(spark, sf):
    t, got = run_stream(spark, sf, lambda s: flow.deduplicated(s, "40 days").groupBy("market").count(), "complete", extra=lambda t: t.where("event_id % 3 = 0"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in t.dropDuplicates(["market", "event_id"]).groupBy("market").count().collect()}


def test_streamed_sequence_state(spark, sf):
    t, got = run_stream(spark, sf, flow.sequence_monitor, "update")
    last = {r.market: (r.gaps, r.backward) for r in got.groupBy("market").agg(F.max("gaps").alias("gaps"), F.max("backward").alias("backward")).collect()}
    want = {r.market: (r.gaps, r.backward) for r in flow.sequence_breaks(t).collect()}
    assert last == want


def test_alpha_test_is_least_squares(spark):
    rows = [("a", d, 0.3 + 1.5 * x + e, x) for d, (x, e) in enumerate([(0.0, 0.1), (1.0, -0.2), (2.0, 0.05), (3.0, 0.2), (5.0, -0.15)])] + [("two", 0, 1.0, 0.0), ("two", 1, 2.0, 1.0)]
    returns = spark.createDataFrame([r[:3] for r in rows], "series string, day int, ret double")
    bench = spark.createDataFrame([(r[1], r[3]) for r in rows if r[0] == "a"], "day int, bench double")
    got = {r.series: r for r in portfolio.alpha_test(returns, bench).collect()}
    x, y = [r[3] for r in rows[:5]], [r[2] for r in rows[:5]]
    mx, my = sum(x) / 5, sum(y) / 5
    sxx = sum((a - mx) ** 2 for a in x)
    beta = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sxx
    alpha = my - beta * mx
    se = (sum((b - alpha - beta * a) ** 2 for a, b in zip(x, y)) / 3 * (1 / 5 + mx * mx / sxx)) ** 0.5
    assert got["a"].alpha == pytest.approx(alpha) and got["a"].alpha_se == pytest.approx(se) and got["a"].alpha_t == pytest.approx(alpha / se)
    assert got["two"].alpha_se is None and got["two"].alpha_t is None
