"""Resampling, champions, drift, multi-day exits, label grids and tree rules against brute force; divisions on inputs that can't be divided."""

import datetime as dt
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import champions as ch
from tidemark.operators import drift, evaluate, features, heads, label_grid, multiday, portfolio, ranks
from tidemark.operators import resampling as rs

D0 = dt.date(2024, 1, 1)


def day(k: int) -> dt.date:
    return D0 + dt.timedelta(days=k)


# resampling


def head_rows(spark, n_days=35, per_day=8, seed=1):
    r = random.Random(seed)
    rows = [(day(k), round(r.random(), 1), int(r.random() < 0.3)) for k in range(n_days) for _ in range(per_day)]
    return rows, spark.createDataFrame(rows, "day date, p double, y int")


def brute_auc(rows):
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc_of_each_replicate_equals_brute_force(spark):
    rows, df = head_rows(spark)
    many = rs.multiplicities(spark, 35, 12, 3)
    assert many.sum(axis=0).tolist() == [35] * 12
    placed = df.select((F.datediff("day", F.lit(D0))).alias("i"), "p", "y")
    got = {r.rep: r.auc for r in rs.replicate_auc(placed, "p", "y", many).collect()}
    for rep in range(12):
        drawn = [(p, y) for d, p, y in rows for _ in range(many[(d - D0).days, rep])]
        assert got[rep] == pytest.approx(brute_auc(drawn))


def test_a_replicate_of_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(0, 0.2, 1), (0, 0.4, 1), (1, 0.3, 0)], "i int, p double, y int")
    got = {r.rep: r.auc for r in rs.replicate_auc(df, "p", "y", np.array([[1, 2, 0], [1, 0, 2]], np.int32)).collect()}
    assert got == {0: 0.5, 1: None, 2: None}
    assert rs.replicate_auc(df.limit(0), "p", "y", np.ones((2, 3), np.int32)).count() == 0


def test_head_report_guards(spark):
    _, df = head_rows(spark)
    ok = rs.head_report(df, "p", "y", replicates=30).first()
    assert ok.status == "ok" and ok.auc_low <= ok.auc <= ok.auc_high and ok.brier_low <= ok.brier <= ok.brier_high and ok.auc_valid == 30
    few = rs.head_report(df.where(F.col("day") < day(20)), "p", "y", min_class=100).first()
    assert few.status == "insufficient" and few.reason == "n_days<30;positives<100" and few.auc is None and few.brier is None
    none = rs.head_report(df.limit(0), "p", "y").first()
    assert none.status == "insufficient" and none.n_rows == 0 and none.positive_rate is None
    odd = spark.createDataFrame([(D0, 1.5, 1), (D0, None, 0), (None, 0.5, 1), (D0, 0.5, 2), (D0, float("nan"), 1), (D0, 0.5, 1)], "day date, p double, y int")
    assert rs.usable(odd, "p", "y").count() == 1


def test_blocks_that_do_not_wrap(spark):
    n = spark.range(1).select(F.lit(7).alias("n"))
    rows = rs.draws(n, 20, 4, block=3, wrap=False).collect()
    per = {}
    for r in rows:
        per.setdefault(r.rep, []).append(r.i)
    assert all(len(v) == 7 and max(v) <= 6 for v in per.values()) and len(per) == 20
    wrapped = {r.i for r in rs.draws(n, 50, 4, block=3).collect()}
    assert wrapped == set(range(7))
    assert rs.draws(spark.range(1).select(F.lit(0).alias("n")), 5, 4).count() == 0


def test_few_dates_have_no_interval(spark):
    days = spark.createDataFrame([(day(k), float(k)) for k in range(5)], "day date, x double")
    r = rs.vector_summary(days, ["x"], 10, 1).first()
    assert (r.dates, r["mean"], r.iid_low, r.block_high) == (5, 2.0, None, None)
    assert rs.vector_summary(days, ["x"], 10, 1, min_dates=5).first().iid_low is not None


def test_constant_days(spark):
    days = spark.createDataFrame([(day(k), 0.0) for k in range(5)], "day date, x double")
    r = rs.replicated(days, {"s": rs.sharpe(F.col("x")), "c": rs.compounded(F.col("x"))}, 3, 1).collect()
    assert [(x.s, x.c) for x in r] == [(0.0, 0.0)] * 3


# champions


def metrics(spark, rows):
    """rows: (model, day, deep_freq, net_mean, gate, last_date)."""
    return spark.createDataFrame([(m, day(k), d, n, 0.5, g, day(x)) for m, k, d, n, g, x in rows], "model_id string, day date, deep_freq double, net_mean double, hit double, gate boolean, last_date date")


def story(spark, rows, rules=ch.Rules(fallback="F")):
    return [(r.champion_id, r.reason, r.streak) for r in ch.champions(metrics(spark, rows), rules).orderBy("day").collect()]


def test_five_days_of_lead_replace_the_champion(spark):
    a = [("A", k, 0.2, 1.0, True, k) for k in range(8)]
    b = [("B", k, 0.1 if k else 0.3, 1.0, True, k) for k in range(8)]
    got = story(spark, a + b)
    assert got[0] == ("A", "chosen_at_once", 0) and got[1:5] == [("A", "kept_streak", k) for k in (1, 2, 3, 4)]
    assert got[5] == ("B", "replaced", 5) and got[6:] == [("B", "kept_best", 0)] * 2


def test_the_fourth_day_breaks_the_streak(spark):
    a = [("A", k, 0.2, 1.0, True, k) for k in range(11)]
    b = [("B", k, 0.3 if k in (0, 4) else 0.1, 1.0, True, k) for k in range(11)]
    got = story(spark, a + b)
    assert [x[2] for x in got] == [0, 1, 2, 3, 0, 1, 2, 3, 4, 5, 0] and got[9][1] == "replaced"


def test_days_without_new_trades_of_the_challenger_do_not_count(spark):
    a = [("A", k, 0.2, 1.0, True, k) for k in range(7)]
    b = [("B", k, 0.1 if k else 0.3, 1.0, True, min(k, 3)) for k in range(7)]
    assert [x[2] for x in story(spark, a + b)] == [0, 1, 2, 3, 3, 3, 3]


def test_margin_gate_and_fallback(spark):
    near = [("A", 0, 0.2, 1.0, True, 0), ("B", 0, 0.3, 1.0, True, 0), ("A", 1, 0.2, 1.0, True, 1), ("B", 1, 0.16, 1.29, True, 1)]
    assert story(spark, near)[1] == ("A", "kept_margin", 0)
    assert story(spark, near[:3] + [("B", 1, 0.16, 1.3, True, 1)])[1] == ("A", "kept_streak", 1)
    lost = near[:2] + [("A", 1, 0.2, 1.0, False, 1), ("B", 1, 0.9, 1.0, True, 1), ("A", 2, 0.2, 1.0, False, 2)]
    assert [x[:2] for x in story(spark, lost)] == [("A", "chosen_at_once"), ("B", "chosen_at_once"), ("F", "fallback")]
    assert ch.champions(metrics(spark, near).limit(0)).count() == 0


def test_metrics_as_of(spark):
    rows = [("A", day(k), "closed", -6.0 if k == 0 else 1.0, k != 1) for k in range(4)] + [("B", day(2), "closed", 2.0, None), ("A", day(3), "open", 9.0, True), ("A", day(3), "closed", None, True), ("A", day(3), "closed", float("nan"), True)]
    ledger = spark.createDataFrame(rows, "model_id string, day date, status string, net_pct double, path_complete boolean")
    rules = ch.Rules(last_days=3, min_days=3)
    got = {(r.model_id, (r.day - D0).days): r for r in ch.metrics_as_of(ch.day_sums(ledger, rules), rules).collect()}
    assert sorted(got) == [("A", 0), ("A", 1), ("A", 2), ("A", 3), ("B", 2), ("B", 3)]
    assert got["A", 2].deep_freq == 0.5 and got["A", 2].n_days == 3 and not got["A", 2].gate
    assert got["A", 3].deep_freq == 0.0 and got["A", 3].path_days == 2 and got["A", 3].complete_share == pytest.approx(2 / 3)
    assert got["B", 3].deep_freq is None and got["B", 3].last_date == day(2)


# multi-day exits


def bars(spark, rows, market="M"):
    return spark.createDataFrame([(market, day(k), *map(float, r)) for k, r in enumerate(rows)], "market string, day date, open double, high double, low double, close double")


def arms(spark, rows, *given, days=3):
    got = multiday.exits(bars(spark, [(1, 1, 1, 1), *rows]), days, list(given)).where(F.col("day") == D0).collect()
    return {r.arm: (r.reason, round(r.gross, 6), r.held) for r in got}


TRAIL, LEVEL = multiday.Arm("t", "trail", trail=0.05), multiday.Arm("l", "trail", trail=0.05, gaps=False)


def test_a_bar_does_not_stop_itself_by_its_own_high(spark):
    # The second bar rises to 120 and falls to 108: under the stop of its own high (114), over that of the bar before (97.85).
    rows = [(100, 103, 99, 102), (102, 120, 108, 110), (110, 111, 109, 110)]
    assert arms(spark, rows, TRAIL)["t"] == ("trail_gap", 0.1, 3)
    assert arms(spark, rows, LEVEL)["l"] == ("trail", 0.14, 3)
    calm = [*rows[:2], (118, 119, 115, 117)]
    assert arms(spark, calm, TRAIL)["t"] == ("trail_eod", 0.17, 3)


def test_bracket_fills_and_order(spark):
    b, lv, hold = multiday.Arm("b", "bracket", target=0.05, stop=0.05), multiday.Arm("v", "bracket", target=0.05, stop=0.05, gaps=False), multiday.Arm("h", "hold")
    both = [(100, 106, 94, 100), (100, 100, 100, 100), (100, 101, 99, 101)]
    assert arms(spark, both, b, hold) == {"b": ("sl", -0.05, 1), "h": ("hold", 0.01, 3)}
    gap = [(100, 101, 99, 100), (90, 91, 89, 90), (90, 90, 90, 90)]
    assert arms(spark, gap, b, lv) == {"b": ("sl_gap", -0.1, 2), "v": ("sl", -0.05, 2)}
    up = [(100, 101, 99, 100), (120, 121, 119, 120), (90, 90, 90, 90)]
    assert arms(spark, up, b)["b"] == ("tp", 0.05, 2)
    assert arms(spark, [(100, 101, 99, 100)], b) == {} and arms(spark, [(0, 1, 0, 1)] * 3, b) == {}
    short = multiday.exits(bars(spark, [(1, 1, 1, 1), (100, 101, 99, 100)]), 3, [hold], whole=False).collect()
    assert [(r.reason, r.held) for r in short] == [("hold", 1)]


# drift


def test_kolmogorov_series(spark):
    x = spark.createDataFrame([(0.0, 5, 5), (0.2, 50, 50), (0.5, 20, 30), (1.0, 40, 40), (None, 5, 5), (None, 0, 0)], "d double, n int, m int")
    got = [r[0] for r in x.select(drift.kolmogorov_p(F.col("d"), F.col("n"), F.col("m"))).collect()]
    # scipy.special.kolmogorov of 1.0 and 1.7320508
    assert got[0] == 1.0 and got[1] == pytest.approx(0.26999967, abs=1e-7) and got[2] == pytest.approx(0.00495752, abs=1e-6) and got[3] < 1e-8
    assert got[4] is None and got[5] is None


def test_triggers(spark):
    rows = []
    for k in range(40):
        flip = k == 39
        for j in range(12):
            y = int(j >= 8)
            p = 0.5 + j / 100 if not flip else 0.05 - j / 1000
            rows.append((day(k), f"m{j}", p, 0 if k >= 33 and j >= 8 and k < 39 and k % 2 else y))
    got = {(r.day - D0).days: r for r in drift.triggers(spark.createDataFrame(rows, "day date, market string, p double, y int"), "p", "y").collect()}
    assert len(got) == 40 and got[39].sign_flip and got[39].half_drop and got[39].dist_shift and got[39].state == "FREEZE"
    assert got[39].ks == 1.0 and got[39].n_new == 12 and got[39].n_old == 84
    assert not got[20].dist_shift and got[20].ks == 0.0 and got[20].ks_p == 1.0 and got[20].state == "OK" and got[5].ic_7 is None and got[20].hit_30 is None
    one_class = spark.createDataFrame([(D0, "a", 0.1, 0), (D0, "b", 0.2, 0)], "day date, market string, p double, y int")
    assert drift.triggers(one_class, "p", "y").first().state == "OK"


# label grid


def test_label_grid_equals_brute_force(spark):
    r = random.Random(5)
    grid = label_grid.Grid(targets=(1, 3), closes=(0, 1), drawdowns=(1, 2), horizons=(4, 12), bars=3)
    rows, paths = [], []
    for k, market in itertools.product(range(15), "AB"):
        price, path = 100.0, []
        for i in range(1, 5):
            o = price
            price = o * (1 + r.uniform(-0.02, 0.03))
            path.append((o, max(o, price) * (1 + r.uniform(0, 0.01)), min(o, price) * (1 - r.uniform(0, 0.01)), price))
            rows.append((market, day(k), i, *path[-1]))
        paths.append((market, "up" if k % 2 else None, path))
    table = spark.createDataFrame(rows, "market string, session date, i int, open double, high double, low double, close double")
    tagged = label_grid.session_paths(table, grid).withColumns({"regime": F.when(F.dayofmonth("session") % 2 == 0, "up"), "tier": F.col("market")})
    got = {(x.regime, x.tier, x.target, x.close, x.drawdown, x.horizon): x for x in label_grid.label_grid(tagged, grid).collect()}
    assert len(got) == 3 * 3 * 2 * 2 * 2 * 2
    for (regime, tier, t, c, dd, h), x in got.items():
        chosen = [p for m, g, p in paths if tier in (m, "all") and regime in (g or "unknown", "all")]
        hits = wins = 0
        ends, fails, hours = [], [], []
        for p in chosen:
            first = next((i for i, b in enumerate(p[: h // 4]) if b[1] >= p[0][0] * (1 + t / 100)), None) if h // 4 <= 3 else None
            end = p[-1][3] / p[0][0] - 1
            if first is None:
                ends.append(end)
                continue
            hits += 1
            ok = min(b[2] for b in p[: first + 1]) / p[0][0] - 1 >= -dd / 100 and end >= c / 100
            wins += ok
            hours += [(first + 1) * 4] if ok else []
            fails += [] if ok else [end]
        assert (x.n, x.hits, x.successes) == (len(chosen), hits, wins)
        for value, want in ((x.no_hit_end, ends), (x.failed_end, fails), (x.hit_hours, hours)):
            assert value == (pytest.approx(statistics.mean(want)) if want else None)


# tree rules


def test_compiled_rules_are_the_model(spark):
    r = random.Random(3)
    rows = [(i, r.random() if r.random() > 0.1 else None, r.random()) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, float((a or 0.5) > 0.6 and b < 0.7)) for i, a, b in rows], "id int, a double, b double, y double")
    model = heads.fit_tree(heads.class_weights(df, "y"), ["a", "b"], "y", min_rows=20)
    rules, medians = heads.compile_rules(model, ["a", "b"])
    assert len(rules) >= 3 and all(x.text() for x in rules)
    number = F.coalesce(*[F.when(x.holds(medians), F.lit(x.leaf)) for x in rules])
    both = model.transform(df).select("leaf", number.alias("mine")).distinct().collect()
    assert len(both) == len(rules) and len({b.mine for b in both}) == len(rules)
    by = heads.rules_by_fold(df.withColumn("fold", F.col("id") % 2), rules, medians, "y", "fold").collect()
    assert sum(x.n for x in by) == 400 and all(" AND " in x.rule or "<=" in x.rule or ">" in x.rule for x in by)
    none = heads.rules_by_fold(df.withColumns({"fold": F.lit(0), "y": F.lit(0.0)}), rules, medians, "y", "fold").collect()
    assert all(x.lift is None for x in none)


def test_greedy_matches(spark):
    rows = [(D0, "a", 1, True, 5.0), (D0, "b", 2, True, 5.0), (D0, "c", 3, False, 5.1), (D0, "d", 4, False, 4.9), (D0, "e", 5, False, 9.0), (D0, "f", 6, False, None)]
    rows += [(day(1), "a", 1, True, 5.0), (day(1), "b", 2, True, 5.0), (day(1), "c", 3, False, 5.0), (day(2), "a", 1, True, None), (day(2), "c", 2, False, 1.0)]
    got = {((r.day - D0).days, r.market): (r.control, r.reason) for r in heads.greedy_matches(spark.createDataFrame(rows, "day date, market string, rk int, picked boolean, uq double"), "picked", "uq").collect()}
    assert got == {(0, "a"): ("c", None), (0, "b"): ("d", None), (1, "a"): (None, "insufficient_controls"), (1, "b"): (None, "insufficient_controls"), (2, "a"): (None, "selected_value_missing")}


# divisions

SERIES = "series string, day date, ret double"


@pytest.mark.parametrize("rets", [[], [0.1], [0.1, -0.1], [0.1, 0.2, 0.3], [0.0] * 10, [0.01] * 10])
def test_portfolio_on_short_and_constant_series(spark, rets):
    df = spark.createDataFrame([("s", day(k), float(r)) for k, r in enumerate(rets)], SERIES)
    m = portfolio.moments(df).collect()
    assert len(m) == bool(rets)
    if rets:
        assert (m[0].skew is None) == (len(rets) < 3 or len(set(rets)) == 1) and (m[0].kurt is None) == (len(rets) < 4 or len(set(rets)) == 1)
        assert (m[0].tail_ratio is None) == (m[0].var95 == 0.0) and (m[0].recovery is None) == (m[0].max_drawdown >= 0)
    for frame in (portfolio.deflated_sharpe(df, F.lit(10)), portfolio.probabilistic_sharpe(df), portfolio.ratios(df)):
        assert len(frame.collect()) == bool(rets)
    bench = df.select("day", F.col("ret").alias("bench"))
    for frame in (portfolio.against_benchmark(df, bench), portfolio.alpha_test(df, bench)):
        found = frame.collect()
        assert len(found) == bool(rets)
    if rets:
        assert portfolio.against_benchmark(df, bench).first().information_ratio is None


def test_normal_quantile_and_expected_maximum(spark):
    ps = [1e-9, 0.001, 0.02, 0.1, 0.5, 0.9, 0.975, 0.999, 1 - 1e-9, 0.0, 1.0]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(portfolio.normal_inverse(F.col("p"))).collect()]
    nd = statistics.NormalDist()
    assert all(g == pytest.approx(nd.inv_cdf(p), rel=2e-9, abs=1e-9) for g, p in zip(got[:-2], ps)) and got[-2:] == [None, None]
    e = [r[0] for r in spark.createDataFrame([(1,), (10,), (100,)], "k int").select(portfolio.expected_maximum(F.col("k"))).collect()]
    g = portfolio.EULER
    want = [0.0] + [(1 - g) * nd.inv_cdf(1 - 1 / k) + g * nd.inv_cdf(1 - 1 / (k * math.e)) for k in (10, 100)]
    assert e == pytest.approx(want, rel=1e-8)


def test_deflated_sharpe_on_a_known_series(spark):
    rets = [0.01, -0.005, 0.02, 0.0, 0.015, -0.01, 0.03, 0.005] * 20
    r = portfolio.deflated_sharpe(spark.createDataFrame([("s", day(k), x) for k, x in enumerate(rets)], SERIES), F.lit(20)).first()
    n, sr = len(rets), statistics.mean(rets) / statistics.stdev(rets)
    assert r.sr == pytest.approx(sr) and r.dsr < r.psr and r.min_track > 1 and r.sr_threshold == pytest.approx(1.8928 / math.sqrt(n), rel=0.05)
    one = portfolio.deflated_sharpe(spark.createDataFrame([("s", day(k), x) for k, x in enumerate(rets)], SERIES), F.lit(1)).first()
    assert one.dsr == pytest.approx(one.psr) and one.sr_threshold == 0.0


def test_other_divisions(spark):
    one = spark.createDataFrame([(D0, 1.0)], "day date, x double")
    assert evaluate.leave_one_out(one, "day", "x").first().without is None
    rows = spark.createDataFrame([(day(k), "m", float(k), 0) for k in range(6)], "day date, market string, score double, hit int")
    assert {r.lift for r in ranks.bucket_screen(rows, "score", "hit", 3).collect()} == {None}
    zero = spark.createDataFrame([("m", day(k), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for k in range(3)], "market string, day date, open double, high double, low double, close double, volume double, quote_volume double")
    assert [r.r for r in zero.withColumn("r", features.ret()).collect()] == [None] * 3
    assert features.with_volume_spike(zero).count() == 3


# order statistics and runs over ranges


def test_quantiles_equal_numpy(spark):
    r = random.Random(8)
    rows = [(g, r.choice([r.random(), 0.5])) for g in "abc" for _ in range({"a": 1, "b": 2, "c": 101}[g])] + [("a", None), ("d", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    named = {"low": 0.0, "q1": 0.1, "mid": 0.5, "top": 0.999, "high": 1.0}
    value = lambda g: [x for k, x in rows if (g is None or k == g) and x is not None and x == x]
    got = {x.g: x for x in ranks.quantiles(df, "x", named, "g").collect()}
    assert set(got) == set("abc")
    for g, row in [*got.items(), (None, ranks.quantiles(df, "x", named).first())]:
        assert [row[n] for n in named] == pytest.approx([np.quantile(value(g), q) for q in named.values()])
    assert ranks.quantiles(df.limit(0), "x", named).count() == 0


def test_streaks_and_folds_over_ranges(spark):
    r = random.Random(9)
    rows = [(i, day(i // 7), m, "closed" if i % 11 else "open", r.choice([1.0, -1.0, 0.0]) if i % 13 else None) for m in "AB" for i in range(120)] + [(0, D0, "C", "closed", 2.0)]
    df = spark.createDataFrame(rows, "trade_id int, day date, model_id string, status string, net_pct double").repartition(5)
    got = {x.model_id: (x.win_streak, x.loss_streak) for x in portfolio.streaks(df).collect()}
    for m in "ABC":
        wins = [x[4] > 0 for x in rows if x[2] == m and x[3] == "closed" and x[4] is not None]
        longest = {k: max((len(list(g)) for v, g in itertools.groupby(wins) if v == k), default=None) for k in (True, False)}
        assert got[m] == (longest[True], longest[False])
    folds = {(x.model_id, x.fold): x.trades for x in portfolio.positional_folds(df.where("net_pct is not null"), 4).collect()}
    n = sum(1 for x in rows if x[2] == "A" and x[3] == "closed" and x[4] is not None)
    assert [folds["A", k] for k in range(4)] == [n // 4 + (k < n % 4) for k in range(4)] and folds["C", 0] == 1


def test_band_weights(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), ("x", 0), ("x", 0), (None, 1), (None, 1)], "band string, y int")
    got = sorted((str(x.band), x.y, x.weight) for x in heads.band_weights(df, "band", "y").collect())
    assert got == [("None", 1, 0.5), ("None", 1, 0.5), ("x", 0, pytest.approx(2 / 3)), ("x", 0, pytest.approx(2 / 3)), ("x", 0, pytest.approx(2 / 3)), ("x", 1, 2.0)]
