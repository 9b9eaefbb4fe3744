"""Queries: portfolio and risk analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import portfolio as m
from tidemark.plans.duck import LEDGER
from tidemark.plans.duck import lag as lg
from tidemark.plans.q_features import W
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, ledger

L = f"WITH {LEDGER}"
RET = f"""{L}, dr AS (SELECT model_id AS series, day, avg(net_pct) / 100 AS r FROM ledger WHERE status = 'closed' GROUP BY ALL),
 cal AS (SELECT series, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM dr GROUP BY series),
 ret AS (SELECT cal.series, cal.day, coalesce(r, 0) AS ret FROM cal LEFT JOIN dr ON dr.series = cal.series AND dr.day = cal.day),
 eq0 AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY day)) AS equity FROM ret),
 eq AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY series ORDER BY day), 1) - 1 AS drawdown FROM eq0)"""
BENCH = RET + f", bars0 AS ({W} SELECT * FROM bars), be AS (SELECT day, close / lag(close) OVER (ORDER BY day) - 1 AS bench FROM bars0 WHERE market = 'M00')"
S = "series:s "


def ret(s, d):
    return m.daily_returns(ledger(s, d))


def bench(s, d):
    return bars_1d(s, d).where("market = 'M00'").select("day", (F.col("close") / F.lag("close").over(Window.orderBy("day")) - 1).alias("bench"))


query("m_01_daily_returns", S + "day:s ret:d", f"{RET} SELECT * FROM ret")(ret)
query("m_02_equity_drawdown", S + "day:s equity:d drawdown:d", f"{RET} SELECT series, day, equity, round(drawdown, 4) AS drawdown FROM eq")(lambda s, d: m.equity(ret(s, d)).withColumn("drawdown", F.round("drawdown", 4)))
query("m_03_sharpe_sortino", S + "n:l sharpe:d sortino:d", f"{RET} SELECT series, count(*) AS n, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 0) AS sharpe, coalesce(avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) * sqrt(365), 0) AS sortino FROM ret GROUP BY series")(lambda s, d: m.ratios(ret(s, d)))
query("m_04_weighted_pnl", "day:s pnl:d drawdown:d", f"{L}, p AS (SELECT day, sum(net_pct / 100 * 0.01) AS pnl FROM ledger WHERE status = 'closed' GROUP BY day), e AS (SELECT *, exp(sum(ln(1 + pnl)) OVER (ORDER BY day)) AS equity FROM p) SELECT day, pnl, equity / greatest(max(equity) OVER (ORDER BY day), 1) - 1 AS drawdown FROM e")(
    lambda s, d: m.equity(ledger(s, d).where("status = 'closed'").groupBy("day").agg(F.sum(F.col("net_pct") / 100 * 0.01).alias("ret")).withColumn("series", F.lit("all"))).withColumn("pnl", F.col("ret"))
)
query("m_05_ledger_summary", "model_id:s trades:l hit_rate:d cumulative:d worst:d", f"{L} SELECT model_id, count(*) AS trades, avg((net_pct > 0)::INT) AS hit_rate, sum(net_pct) AS cumulative, min(net_pct) AS worst FROM ledger WHERE status = 'closed' GROUP BY model_id")(
    lambda s, d: ledger(s, d).where("status = 'closed'").groupBy("model_id").agg(F.count("*").alias("trades"), F.avg((F.col("net_pct") > 0).cast("int")).alias("hit_rate"), F.sum("net_pct").alias("cumulative"), F.min("net_pct").alias("worst"))
)
query("m_06_headline", "model_id:s trades:l win_rate:d profit_factor:d expectancy:d mean_win:d mean_loss:d best:d worst:d", f"{L} SELECT model_id, count(*) AS trades, avg((net_pct > 0)::INT) AS win_rate, sum(greatest(net_pct, 0)) / nullif(sum(greatest(-net_pct, 0)), 0) AS profit_factor, avg(net_pct) AS expectancy, avg(CASE WHEN net_pct > 0 THEN net_pct END) AS mean_win, avg(CASE WHEN net_pct < 0 THEN net_pct END) AS mean_loss, max(net_pct) AS best, min(net_pct) AS worst FROM ledger WHERE status = 'closed' GROUP BY model_id")(
    lambda s, d: m.headline(ledger(s, d))
)
MOM = f"{RET}, v AS (SELECT series, quantile_cont(ret, 0.05) AS var95, quantile_cont(ret, 0.95) AS q95, skewness(ret) AS skew, kurtosis(ret) AS kurt, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr FROM ret GROUP BY series), t AS (SELECT ret.series, avg(ret) AS cvar95 FROM ret JOIN v ON v.series = ret.series WHERE ret <= var95 GROUP BY ret.series), u AS (SELECT series, sqrt(avg(drawdown * drawdown)) AS ulcer, min(drawdown) AS max_drawdown, arg_max(equity, day) - 1 AS end_return FROM eq GROUP BY series)"
query("m_07_moments", S + "skew:d kurt:d var95:d cvar95:d tail_ratio:d ulcer:d max_drawdown:d recovery:d", f"{MOM} SELECT v.series, skew, kurt, var95, cvar95, abs(q95 / nullif(var95, 0)) AS tail_ratio, ulcer, max_drawdown, CASE WHEN max_drawdown < 0 THEN end_return / abs(max_drawdown) END AS recovery FROM v JOIN t ON t.series = v.series JOIN u ON u.series = v.series")(lambda s, d: m.moments(ret(s, d)))
query("m_07_streaks", "model_id:s win_streak:l loss_streak:l", f"{L}, r AS (SELECT *, net_pct > 0 AS win, row_number() OVER w - row_number() OVER (PARTITION BY model_id, net_pct > 0 ORDER BY day, trade_id) AS island FROM ledger WHERE status = 'closed' WINDOW w AS (PARTITION BY model_id ORDER BY day, trade_id)), k AS (SELECT model_id, win, island, count(*) AS n FROM r GROUP BY ALL) SELECT model_id, max(CASE WHEN win THEN n END) AS win_streak, max(CASE WHEN NOT win THEN n END) AS loss_streak FROM k GROUP BY model_id")(
    lambda s, d: m.streaks(ledger(s, d))
)
Z = "sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt + 2) / 4 * sr * sr)"


def cdf(z: str) -> str:
    """SQL of the normal distribution, by the same approximation."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    up = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * (0.319381530 * {t} - 0.356563782 * pow({t}, 2) + 1.781477937 * pow({t}, 3) - 1.821255978 * pow({t}, 4) + 1.330274429 * pow({t}, 5)))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {up} WHEN {z} < 0 THEN {up} END"


def quantile(p: str) -> str:
    """SQL of the normal quantile, by the same approximation."""

    def poly(x: str, cs: tuple[float, ...]) -> str:
        return " + ".join(f"{c!r}::DOUBLE * pow({x}, {len(cs) - 1 - i})" for i, c in enumerate(cs))

    q, r = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"pow({p} - 0.5, 2)"
    tail = f"(({poly(q, m.QUANTILE_C)}) / (({poly(q, m.QUANTILE_D)}) * {q} + 1))"
    middle = f"(({poly(r, m.QUANTILE_A)}) * ({p} - 0.5) / (({poly(r, m.QUANTILE_B)}) * {r} + 1))"
    return f"CASE WHEN {p} < {m.QUANTILE_LOW} THEN {tail} WHEN {p} > 1 - {m.QUANTILE_LOW} THEN -{tail} ELSE {middle} END"


TRIALS = 45
query(
    "m_08_probabilistic_sharpe", S + "z:d psr:d trials:l sr_threshold:d dsr:d min_track:d",
    f"""{MOM}, z0 AS (SELECT series, n, sr, {Z} AS z, sqrt(1 - skew * sr + (kurt + 2) / 4 * sr * sr) AS sd, skew, kurt FROM v),
 k AS (SELECT {TRIALS} AS trials, (1 - {m.EULER}) * ({quantile(f"(1 - 1 / {TRIALS}::DOUBLE)")}) + {m.EULER} * ({quantile(f"(1 - 1 / ({TRIALS} * exp(1.0::DOUBLE)))")}) AS em, {quantile("0.95::DOUBLE")} AS need),
 z1 AS (SELECT *, em / sqrt(n) AS sr_threshold, (sr - em / sqrt(n)) * sqrt(n - 1) / sd AS zd FROM z0, k)
 SELECT series, z, {cdf("z")} AS psr, trials, sr_threshold, {cdf("zd")} AS dsr,
 CASE WHEN sr > sr_threshold THEN 1 + (1 - skew * sr_threshold + (kurt + 2) / 4 * sr_threshold * sr_threshold) * pow(need / (sr - sr_threshold), 2) END AS min_track FROM z1""",
)(lambda s, d: m.deflated_sharpe(ret(s, d), F.lit(TRIALS)))
query("m_09_m_13_benchmark", S + "n:l beta:d alpha:d corr:d r2:d tracking_error:d information_ratio:d", f"{BENCH} SELECT series, count(*) AS n, regr_slope(ret, bench) AS beta, regr_intercept(ret, bench) AS alpha, corr(ret, bench) AS corr, regr_r2(ret, bench) AS r2, stddev_samp(ret - bench) AS tracking_error, avg(ret - bench) / stddev_samp(ret - bench) * sqrt(365) AS information_ratio FROM ret JOIN be ON be.day = ret.day WHERE bench IS NOT NULL GROUP BY series")(
    lambda s, d: m.against_benchmark(ret(s, d), bench(s, d).where("bench is not null"))
)
query("m_13_alpha_test", S + "n:l alpha:d r2:d alpha_se:d alpha_t:d", f"{BENCH}, x AS (SELECT series, regr_count(ret, bench)::BIGINT AS n, regr_intercept(ret, bench) AS alpha, regr_r2(ret, bench) AS r2, regr_sxx(ret, bench) AS sxx, regr_syy(ret, bench) AS syy, regr_sxy(ret, bench) AS sxy, regr_avgx(ret, bench) AS ax FROM ret JOIN be ON be.day = ret.day WHERE bench IS NOT NULL GROUP BY series), e AS (SELECT *, CASE WHEN n > 2 AND sxx > 0 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) * (1.0::DOUBLE / n + ax * ax / sxx)) END AS alpha_se FROM x) SELECT series, n, alpha, r2, alpha_se, CASE WHEN alpha_se > 0 THEN alpha / alpha_se END AS alpha_t FROM e")(
    lambda s, d: m.alpha_test(ret(s, d), bench(s, d).where("bench is not null"))
)
query("m_10_drawdown_episodes", S + "first_day:s last_day:s depth:d length:l recovered:b", f"{RET}, i AS (SELECT *, sum((drawdown >= -1e-12)::INT) OVER (PARTITION BY series ORDER BY day) AS island FROM eq), e AS (SELECT series, island, min(day) AS first_day, max(day) AS last_day, min(drawdown) AS depth, count(*) AS length FROM i WHERE drawdown < -1e-12 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(depth, 12), first_day) AS j FROM e) SELECT k.*, last_day < (SELECT max(day) FROM eq WHERE eq.series = k.series) AS recovered FROM k WHERE j <= 3")(
    lambda s, d: m.drawdown_episodes(ret(s, d))
)
WR = "(PARTITION BY series ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
query("m_11_rolling_sharpe", S + "day:s rolling_sharpe:d", f"{RET}, z AS (SELECT *, count(*) OVER {WR} AS n, avg(ret) OVER {WR} AS a, stddev_samp(ret) OVER {WR} AS sd, max(abs(ret)) OVER {WR} AS mx FROM ret) SELECT series, day, CASE WHEN n >= 30 AND mx > 0 AND sd > 0 THEN a / sd * sqrt(365) END AS rolling_sharpe FROM z")(lambda s, d: m.rolling_sharpe(ret(s, d)))
query("m_11_monthly", S + "month:s month_ret:d days:l", f"{RET} SELECT series, date_trunc('month', day)::DATE AS month, exp(sum(ln(1 + ret))) - 1 AS month_ret, count(*) AS days FROM ret GROUP BY ALL")(lambda s, d: m.monthly(ret(s, d)))
query("m_11_histogram", "bin:l n:l", f"{L} SELECT floor(net_pct) AS bin, count(*) AS n FROM ledger WHERE status = 'closed' GROUP BY 1")(lambda s, d: ledger(s, d).where("status = 'closed'").groupBy(F.floor("net_pct").alias("bin")).agg(F.count("*").alias("n")))
query("m_12_fold_consistency", "model_id:s fold:l trades:l mean_net:d", f"{L}, z AS (SELECT *, ntile(5) OVER (PARTITION BY model_id ORDER BY day, trade_id) - 1 AS fold FROM ledger WHERE status = 'closed') SELECT model_id, fold, count(*) AS trades, avg(net_pct) AS mean_net FROM z GROUP BY ALL")(
    lambda s, d: m.positional_folds(ledger(s, d), 5)
)
query("m_14_coin_matrix", "coin:s urgent:d high:d medium:d", f"{L} SELECT coin, avg(CASE WHEN model_id = '1-URGENT' THEN net_pct END) AS urgent, avg(CASE WHEN model_id = '2-HIGH' THEN net_pct END) AS high, avg(CASE WHEN model_id = '3-MEDIUM' THEN net_pct END) AS medium FROM ledger WHERE status = 'closed' GROUP BY coin")(
    lambda s, d: ledger(s, d).where("status = 'closed'").groupBy("coin").pivot("model_id", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.avg("net_pct")).withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"})
)
query("m_15_rolling_hit_rate", "day:s hit_30d:d", f"{L}, h AS (SELECT day, sum((net_pct > 0)::INT) AS w, count(*) AS n FROM ledger WHERE status = 'closed' GROUP BY day) SELECT day, sum(w) OVER r / sum(n) OVER r::DOUBLE AS hit_30d FROM h WINDOW r AS (ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)")(
    lambda s, d: ledger(s, d).where("status = 'closed'").groupBy("day").agg(F.sum((F.col("net_pct") > 0).cast("int")).alias("w"), F.count("*").alias("n")).withColumn("t", F.datediff("day", F.lit("1970-01-01").cast("date"))).withColumn("hit_30d", F.sum("w").over(x := Window.orderBy("t").rangeBetween(-29, 0)) / F.sum("n").over(x))
)
query("m_16_sizing", "trade_id:l w_equal:d w_prob:d kelly:d w_capped:d", f"{L}, p AS (SELECT *, ((trade_id % 40) + 10) / 60.0 AS p FROM ledger), q AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY day) AS w_equal, p / sum(p) OVER (PARTITION BY day) AS w_prob, greatest((p * 2 - (1 - p)) / 2, 0) / 4 AS kelly FROM p), r AS (SELECT *, sum(greatest(w_prob - 0.3, 0)) OVER (PARTITION BY day) AS ov, sum(greatest(0.3 - w_prob, 0)) OVER (PARTITION BY day) AS rm FROM q) SELECT trade_id, w_equal, w_prob, kelly, least(w_prob, 0.3) + CASE WHEN rm > 0 THEN greatest(0.3 - w_prob, 0) / rm * least(ov, rm) ELSE 0 END AS w_capped FROM r")(
    lambda s, d: m.sized(ledger(s, d))
)
query("m_17_halts", S + "day:s silenced:l", f"{RET}, b AS (SELECT *, (ret <= -0.05 OR drawdown <= -0.2)::INT AS br FROM eq) SELECT series, day, coalesce(max(br) OVER (PARTITION BY series ORDER BY day RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS silenced FROM b")(
    lambda s, d: m.halted(ret(s, d), 0.05, 0.2, 5)
)
query("m_18_fraction_grid", S + "fraction:d final:d max_dd:d", f"{RET}, g AS (SELECT series, fraction, day, exp(sum(ln(1 + fraction * ret)) OVER (PARTITION BY series, fraction ORDER BY day)) AS e FROM ret, (VALUES (0.25), (0.5), (1.0)) v(fraction)), h AS (SELECT *, e / max(e) OVER (PARTITION BY series, fraction ORDER BY day) - 1 AS dd FROM g) SELECT series, fraction, arg_max(e, day) AS final, min(dd) AS max_dd FROM h GROUP BY series, fraction")(
    lambda s, d: ret(s, d).withColumn("fraction", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0)))).withColumn("e", F.exp(F.sum(F.log1p(F.col("ret") * F.col("fraction"))).over(w := Window.partitionBy("series", "fraction").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))).withColumn("dd", F.col("e") / F.max("e").over(w) - 1).groupBy("series", "fraction").agg(F.max_by("e", "day").alias("final"), F.min("dd").alias("max_dd"))
)
query("m_19_basket_forward", "day:s basket:d forward:d", f"{W}, z AS (SELECT *, close / {lg('close')} - 1 AS r, rank() OVER (PARTITION BY day ORDER BY quote_volume DESC) AS liq FROM bars), b AS (SELECT day, avg(r) AS basket FROM z WHERE liq <= 10 AND r IS NOT NULL GROUP BY day) SELECT day, basket, CASE WHEN count(*) OVER f >= 5 THEN exp(sum(ln(1 + basket)) OVER f) - 1 END AS forward FROM b WINDOW f AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)")(
    lambda s, d: m.basket_forward(bars_1d(s, d), 10, 5)
)
query("m_20_basket_chain", "series:s baskets:l status:s", f"{RET}, z AS (SELECT *, lag(day) OVER (PARTITION BY series ORDER BY day) AS b FROM ret) SELECT series, count(*) AS baskets, CASE WHEN max(day - b) > 1 THEN 'gap' WHEN min(day - b) < 1 THEN 'overlap' ELSE 'contiguous' END AS status FROM z GROUP BY series")(
    lambda s, d: ret(s, d).withColumn("g", F.datediff("day", F.lag("day").over(m.series_window()))).groupBy("series").agg(F.count("*").alias("baskets"), F.when(F.max("g") > 1, "gap").when(F.min("g") < 1, "overlap").otherwise("contiguous").alias("status"))
)
query("m_21_two_ledgers", "day:s a:d b:d diff:d", f"{L}, a AS (SELECT day, avg(net_pct) AS a FROM ledger WHERE status = 'closed' AND model_id = '1-URGENT' GROUP BY day), b AS (SELECT day, avg(net_pct) AS b FROM ledger WHERE status = 'closed' AND model_id = '2-HIGH' GROUP BY day) SELECT a.day, a, b, a - b AS diff FROM a JOIN b ON b.day = a.day")(
    lambda s, d: (q := ledger(s, d).where("status = 'closed'").groupBy("model_id", "day").agg(F.avg("net_pct").alias("x"))).where("model_id = '1-URGENT'").select("day", F.col("x").alias("a")).join(q.where("model_id = '2-HIGH'").select("day", F.col("x").alias("b")), "day").withColumn("diff", F.col("a") - F.col("b"))
)
query("m_22_buy_and_hold", "day:s cumulative:d", f"{W} SELECT day, close / first(close) OVER (ORDER BY day) - 1 AS cumulative FROM bars WHERE market = 'M00'")(
    lambda s, d: bars_1d(s, d).where("market = 'M00'").withColumn("cumulative", F.col("close") / F.first("close").over(Window.orderBy("day")) - 1)
)
