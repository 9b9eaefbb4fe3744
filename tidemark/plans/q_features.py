"""Queries: time-series features and cross-sectional ranks of daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import EPS, lag, pct_rank, roll
from tidemark.operators import features as f
from tidemark.operators import ranks as r
from tidemark.plans.duck import BARS, FOREIGN
from tidemark.plans.duck import frame as fr
from tidemark.plans.duck import lag as lg
from tidemark.plans.duck import pct_rank as pr
from tidemark.plans.duck import roll as ro
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_1d, foreign_1d

K = "day:s market:s "
W = "WITH " + BARS
LR = f"lr AS (SELECT *, ln(close / {lg('close')} + 1e-12) AS lr, {lg('close')} AS pc FROM bars)"
QV = f"qv AS (SELECT *, quote_volume AS qv, {ro('avg', 'quote_volume', 7)} AS m7, {ro('avg', 'quote_volume', 30)} AS m30 FROM bars)"
BB = f"bb AS (SELECT *, {ro('avg', 'close', 20)} AS mid, {ro('stddev_samp', 'close', 20)} AS sd FROM bars), bw AS (SELECT *, (4 * sd) / (mid + 1e-12) AS bb_width, (close - (mid - 2 * sd)) / ((mid + 2 * sd) - (mid - 2 * sd) + 1e-12) AS bb_position FROM bb)"
TR = f"tr AS (SELECT *, greatest(high - low, coalesce(abs(high - {lg('close')}), high - low), coalesce(abs(low - {lg('close')}), high - low)) AS tr FROM bars)"

query("f_01_log_return", K + "log_return_1d:d", f"{W}, {LR} SELECT day, market, lr AS log_return_1d FROM lr")(
    lambda s, d: bars_1d(s, d).withColumn("log_return_1d", f.log_return())
)
query("f_02_returns", K + "return_3d:d return_5d:d return_7d:d return_14d:d return_21d:d", W + " SELECT day, market, " + ", ".join(f"close / {lg('close', n)} - 1 AS return_{n}d" for n in (3, 5, 7, 14, 21)) + " FROM bars")(
    lambda s, d: bars_1d(s, d).withColumns({f"return_{n}d": f.ret(n) for n in (3, 5, 7, 14, 21)})
)
query("f_03_rolling_std", K + "vol_3d:d vol_7d:d vol_14d:d vol_21d:d", f"{W}, {LR} SELECT day, market, " + ", ".join(f"{ro('stddev_samp', 'lr', n, max(2, n // 2))} AS vol_{n}d" for n in (3, 7, 14, 21)) + " FROM lr")(
    lambda s, d: f.with_volatility(bars_1d(s, d))
)
RC = ", ".join(
    f"(({ro('max', 'high', n, last=n)}) - ({ro('min', 'low', n, last=n)})) / ({lg('close', n)} + 1e-12) / ((({ro('max', 'high', n)}) - ({ro('min', 'low', n)})) / (close + 1e-12) + 1e-12) AS range_contraction_{n}d" for n in (3, 7, 14)
)
query("f_04_range_contraction", K + "range_contraction_3d:d range_contraction_7d:d range_contraction_14d:d", f"{W} SELECT day, market, {RC} FROM bars")(
    lambda s, d: bars_1d(s, d).withColumns({f"range_contraction_{n}d": f.range_contraction(n) for n in (3, 7, 14)})
)
query(
    "f_05_volume_ratio_spike", K + "volume_ratio_3d:d volume_ratio_7d:d volume_spike_score:d",
    f"{W}, v AS (SELECT *, volume / {lg('volume')} - 1 AS vp FROM bars) SELECT day, market, volume / (({ro('avg', 'volume', 3)}) + 1e-12) AS volume_ratio_3d, volume / (({ro('avg', 'volume', 7)}) + 1e-12) AS volume_ratio_7d, vp / (({ro('stddev_samp', 'vp', 20)}) + 1e-12) AS volume_spike_score FROM v",
)(lambda s, d: f.with_volume_spike(bars_1d(s, d)).withColumns({f"volume_ratio_{n}d": f.volume_ratio(n) for n in (3, 7)}))
query(
    "f_06_rsi", K + "rsi_14:d",
    f"{W}, g AS (SELECT *, greatest(coalesce(close - {lg('close')}, 0), 0) AS g, greatest(coalesce({lg('close')} - close, 0), 0) AS l FROM bars) SELECT day, market, 100 - 100 / (1 + ({ro('avg', 'g', 14, 7)}) / (({ro('avg', 'l', 14, 7)}) + 1e-12)) AS rsi_14 FROM g",
)(lambda s, d: f.with_rsi(bars_1d(s, d)))


def _ema(x: str, n: int, src: str, out: str) -> str:
    a = 2.0 / (n + 1)
    return f"{out} AS (SELECT y.market, y.i, sum(x.{x} * CASE WHEN x.i = 1 THEN pow({1 - a!r}, y.i - 1) ELSE {a!r} * pow({1 - a!r}, y.i - x.i) END) AS e FROM {src} y JOIN {src} x ON x.market = y.market AND x.i <= y.i AND x.i > y.i - 700 + (CASE WHEN y.i <= 700 THEN -700 ELSE 0 END) GROUP BY y.market, y.i)"


query(
    "f_07_macd", K + "macd:d macdhist:d",
    f"{W}, n AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY day) AS i FROM bars), {_ema('close', 12, 'n', 'e12')}, {_ema('close', 26, 'n', 'e26')}, m AS (SELECT n.market, n.day, n.i, e12.e - e26.e AS macd FROM n JOIN e12 USING (market, i) JOIN e26 USING (market, i)), {_ema('macd', 9, 'm', 'e9')} SELECT day, market, macd, macd - e AS macdhist FROM m JOIN e9 USING (market, i)",
)(lambda s, d: f.with_macd(bars_1d(s, d)))
query(
    "f_08_bollinger", K + "bb_position:d bb_width:d squeeze_on:l",
    f"{W}, {BB} SELECT day, market, bb_position, bb_width, coalesce((({ro('min', 'bb_width', 24, 10)}) = bb_width)::INT, 0) AS squeeze_on FROM bw",
)(lambda s, d: f.with_bollinger(bars_1d(s, d)))
query("f_09_roc", K + "roc_3d:d roc_7d:d", f"{W} SELECT day, market, (close / {lg('close', 3)} - 1) * 100 AS roc_3d, (close / {lg('close', 7)} - 1) * 100 AS roc_7d FROM bars")(
    lambda s, d: bars_1d(s, d).withColumns({"roc_3d": f.ret(3) * 100, "roc_7d": f.ret(7) * 100})
)
query("f_10_atr", K + "tr:d atr_14:d atr_pct_14:d atr_pct_14_mp7:d", f"{W}, {TR} SELECT day, market, tr, {ro('avg', 'tr', 14)} AS atr_14, ({ro('avg', 'tr', 14)}) / (close + 1e-12) AS atr_pct_14, ({ro('avg', 'tr', 14, 7)}) / (close + 1e-12) AS atr_pct_14_mp7 FROM tr")(
    lambda s, d: f.with_atr(bars_1d(s, d)).withColumn("atr_pct_14_mp7", roll(F.avg, "tr", 14, 7) / (F.col("close") + EPS))
)
REGIME = f"""b0 AS (SELECT *, ln(close / {lg('close')} + 1e-12) AS lr, {ro('avg', 'close', 200)} AS ma FROM bars WHERE market = 'M00'),
 b1 AS (SELECT *, (close - ma) / (ma + 1e-12) AS dist, {ro('stddev_samp', 'lr', 30)} AS rv FROM b0),
 b2 AS (SELECT *, list(rv) OVER {fr(252)} AS vs FROM b1),
 b3 AS (SELECT *, CASE WHEN len(list_filter(vs, lambda x: x IS NOT NULL)) >= 252 THEN (len(list_filter(vs, lambda x: x < rv)) + (len(list_filter(vs, lambda x: x = rv)) + 1) / 2.0) / 252.0 END AS inten FROM b2),
 regime AS (SELECT day, dist AS btc_ma_distance, rv AS btc_rv, inten AS btc_intensity, CASE WHEN coalesce(dist > 0, false) THEN 'bull' ELSE 'bear' END || CASE WHEN coalesce(inten > 0.5, false) THEN '_volatile' ELSE '_quiet' END AS btc_regime FROM b3)"""
query(
    "f_11_regime", "day:s btc_ma_distance:d btc_rv:d btc_intensity:d btc_regime:s btc_regime_id:l",
    f"{W}, {REGIME} SELECT *, CASE btc_regime WHEN 'bull_quiet' THEN 0 WHEN 'bull_volatile' THEN 1 WHEN 'bear_quiet' THEN 2 ELSE 3 END AS btc_regime_id FROM regime",
)(lambda s, d: f.regime(bars_1d(s, d).where("market = 'M00'")))
query(
    "f_12_width_percentile", K + "bb_width_pctile_60:d",
    f"{W}, {BB}, v AS (SELECT *, list_filter(list(wr) OVER {fr(60)}, lambda x: x IS NOT NULL) AS vs FROM (SELECT *, round(bb_width, 12) AS wr FROM bw)) SELECT day, market, CASE WHEN len(vs) >= 30 AND wr IS NOT NULL THEN (len(list_filter(vs, lambda x: x < wr)) + (len(list_filter(vs, lambda x: x = wr)) + 1) / 2.0) / len(vs) END AS bb_width_pctile_60 FROM v",
)(lambda s, d: f.with_width_rank(bars_1d(s, d)))
query(
    "f_13_turnover", K + "log_qv:d qv_surge_7d:d qv_surge_30d:d qv_ma7_vs_ma30:d qv_spiked_yday:d",
    f"{W}, {QV}, s AS (SELECT *, qv / (m7 + 1e-12) AS s7 FROM qv) SELECT day, market, ln(qv + 1) AS log_qv, s7 AS qv_surge_7d, qv / (m30 + 1e-12) AS qv_surge_30d, m7 / (m30 + 1e-12) AS qv_ma7_vs_ma30, coalesce(({lg('s7')} >= 3)::DOUBLE, 0) AS qv_spiked_yday FROM s",
)(lambda s, d: f.with_turnover(bars_1d(s, d)))
query(
    "f_14_position", K + "pos_in_20d_range:d dist_from_20d_high:d dist_from_60d_high:d near_20d_high:d drawdown_7d:d bounce_off_7d_low:d",
    f"{W}, p AS (SELECT *, {ro('max', 'high', 20)} AS h20, {ro('min', 'low', 20)} AS l20, {ro('max', 'high', 60)} AS h60, {ro('max', 'high', 7)} AS h7, {ro('min', 'low', 7)} AS l7 FROM bars) SELECT day, market, (close - l20) / (h20 - l20 + 1e-12) AS pos_in_20d_range, close / (h20 + 1e-12) - 1 AS dist_from_20d_high, close / (h60 + 1e-12) - 1 AS dist_from_60d_high, coalesce((close / (h20 + 1e-12) - 1 >= -0.03)::DOUBLE, 0) AS near_20d_high, close / (h7 + 1e-12) - 1 AS drawdown_7d, close / (l7 + 1e-12) - 1 AS bounce_off_7d_low FROM p",
)(lambda s, d: f.with_position(bars_1d(s, d)))
query(
    "f_15_up_streak", K + "up_streak:l",
    f"{W}, u AS (SELECT *, coalesce(close > {lg('close')}, false) AS up, row_number() OVER (PARTITION BY market ORDER BY day) AS i FROM bars), z AS (SELECT *, max(CASE WHEN NOT up THEN i END) OVER (PARTITION BY market ORDER BY day) AS last0 FROM u) SELECT day, market, i - last0 AS up_streak FROM z",
)(lambda s, d: f.with_streak(bars_1d(s, d)))
query(
    "f_16_lagged_panel", K + "f_ret_1d:d f_ret_7d:d f_rv_7d:d f_atr_pct_14:d f_log_qv:d f_qv_surge_7d:d f_pos_in_20d_range:d f_universe_qv:d lab_up5:d high_ret:d history:l",
    f"{W}, {LR}, a AS (SELECT *, close / {lg('close')} - 1 AS r1, close / {lg('close', 7)} - 1 AS r7, {ro('stddev_samp', 'lr', 7, 4)} AS rv7, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr, quote_volume / (({ro('avg', 'quote_volume', 7)}) + 1e-12) AS s7, (close - ({ro('min', 'low', 20)})) / (({ro('max', 'high', 20)}) - ({ro('min', 'low', 20)}) + 1e-12) AS pos FROM lr), b AS (SELECT *, ({ro('avg', 'tr', 14, 7)}) / (close + 1e-12) AS atr FROM a) SELECT day, market, {lg('r1')} AS f_ret_1d, {lg('r7')} AS f_ret_7d, {lg('rv7')} AS f_rv_7d, {lg('atr')} AS f_atr_pct_14, {lg('ln(quote_volume + 1)')} AS f_log_qv, {lg('s7')} AS f_qv_surge_7d, {lg('pos')} AS f_pos_in_20d_range, {lg('quote_volume')} AS f_universe_qv, (high / (open + 1e-12) - 1 >= 0.05)::DOUBLE AS lab_up5, high / (open + 1e-12) - 1 AS high_ret, row_number() OVER (PARTITION BY market ORDER BY day) - 1 AS history FROM b",
)(lambda s, d: f.panel(bars_1d(s, d)))
MED = ", ".join(f"quote_volume / (({ro('quantile_cont({0}, 0.5)', 'quote_volume', n, max(3, n // 2))}) + 1e-12) AS qv_med_{n}" for n in (5, 14, 30))
query(
    "f_17_median_ratios", K + "qv_med_5:d qv_med_14:d qv_med_30:d qv_max_3:d qv_z_30:d",
    f"{W} SELECT day, market, {MED}, {ro('max', 'quote_volume', 3)} AS qv_max_3, (quote_volume - ({ro('avg', 'quote_volume', 30)})) / (({ro('stddev_samp', 'quote_volume', 30)}) + 1e-12) AS qv_z_30 FROM bars",
)(
    lambda s, d: bars_1d(s, d).withColumns(
        {f"qv_med_{n}": F.col("quote_volume") / (roll(lambda x: F.percentile(x, 0.5), "quote_volume", n, max(3, n // 2)) + EPS) for n in (5, 14, 30)}
        | {"qv_max_3": roll(F.max, "quote_volume", 3), "qv_z_30": (F.col("quote_volume") - roll(F.avg, "quote_volume", 30)) / (roll(F.stddev_samp, "quote_volume", 30) + EPS)}
    )
)
query("f_18_rank_jump", K + "rank_jump_3:d", f"{W}, k AS (SELECT *, {pr('quote_volume')} AS p FROM bars) SELECT day, market, p - {lg('p', 3)} AS rank_jump_3 FROM k")(
    lambda s, d: bars_1d(s, d).withColumn("p", pct_rank("quote_volume", "day")).withColumn("rank_jump_3", F.col("p") - lag("p", 3))
)
BREADTH = f"br AS (SELECT day, count(*) AS active, sum((high / open - 1 >= 0.1)::INT) AS pumps, avg((high / open - 1 >= 0.1)::INT) AS breadth, sum((r > 0)::INT) AS advancers, quantile_cont(r, 0.5) AS med_ret, sum(quote_volume) AS turnover FROM (SELECT *, close / {lg('close')} - 1 AS r FROM bars) GROUP BY day)"
query("f_19_breadth", "day:s active:l pumps:l breadth:d advancers:l med_ret:d turnover:d", f"{W}, {BREADTH} SELECT * FROM br")(lambda s, d: r.breadth(bars_1d(s, d)))
WB = "ORDER BY day ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
query(
    "f_21_day_gate", "day:s pumps_yday:l med_ret_yday:d advancers_avg3:d regime_yday:s",
    f"{W}, {BREADTH}, {REGIME} SELECT br.day, lag(pumps) OVER (ORDER BY br.day) AS pumps_yday, lag(med_ret) OVER (ORDER BY br.day) AS med_ret_yday, avg(advancers) OVER (ORDER BY br.day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS advancers_avg3, g AS regime_yday FROM br LEFT JOIN (SELECT day, lag(btc_regime) OVER (ORDER BY day) AS g FROM regime) q ON q.day = br.day",
)(lambda s, d: r.day_gate(r.breadth(bars_1d(s, d)), f.regime(bars_1d(s, d).where("market = 'M00'"))))
query(
    "f_22_context_attach", K + "ret_1d:d day_breadth:d day_turnover:d liquidity_rank:l",
    f"{W}, {BREADTH} SELECT b.day, b.market, b.ret_1d, breadth AS day_breadth, turnover AS day_turnover, rank() OVER (PARTITION BY b.day ORDER BY quote_volume DESC) AS liquidity_rank FROM (SELECT *, close / {lg('close')} - 1 AS ret_1d FROM bars) b LEFT JOIN br USING (day)",
)(lambda s, d: r.with_context(bars_1d(s, d).withColumn("ret_1d", f.ret())))
FX = f"{W}, {FOREIGN}, fz AS (SELECT *, quote_volume / nullif(avg(quote_volume) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS s, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS lr, date_diff('day', lag(day, 5) OVER (PARTITION BY symbol ORDER BY day), day) AS span, count(*) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n FROM fx)"
query(
    "f_30_foreign_surge", "day:s symbol:s surge:d log_ret:d status:s",
    f"{FX} SELECT day, symbol, CASE WHEN n = 20 AND span = 5 THEN s END AS surge, CASE WHEN n = 20 AND span = 5 THEN lr END AS log_ret, CASE WHEN n < 20 THEN 'short_history' WHEN span <> 5 THEN 'gap' ELSE 'ok' END AS status FROM fz",
)(lambda s, d: r.foreign_surge(foreign_1d(bars_1d(s, d))))
query(
    "f_31_lead_lag", K + "ret_home:d ret_foreign:d ret_gap:d surge_d1:d",
    f"{FX}, h AS (SELECT *, close / {lg('close')} - 1 AS r, 'X' || substr(market, 2) AS symbol FROM bars), g AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r FROM fz) SELECT h.day, h.market, h.r AS ret_home, g.r AS ret_foreign, h.r - g.r AS ret_gap, g.s AS surge_d1 FROM h LEFT JOIN g ON g.symbol = h.symbol AND g.day = h.day - 1",
)(lambda s, d: r.lead_lag(bars_1d(s, d), foreign_1d(bars_1d(s, d))))
query("r_01_pct_rank", K + "rank_ret:d rank_qv:d", f"{W}, x AS (SELECT *, close / {lg('close')} - 1 AS r FROM bars) SELECT day, market, {pr('r')} AS rank_ret, {pr('quote_volume')} AS rank_qv FROM x")(
    lambda s, d: bars_1d(s, d).withColumn("r", f.ret()).withColumns({"rank_ret": pct_rank("r", "day"), "rank_qv": pct_rank("quote_volume", "day")})
)
query(
    "r_02_liquidity_ranks", K + "rank_min:l rank_dense:l rank_first:l",
    f"{W} SELECT day, market, rank() OVER (PARTITION BY day ORDER BY volume DESC NULLS LAST) AS rank_min, dense_rank() OVER (PARTITION BY day ORDER BY volume DESC NULLS LAST) AS rank_dense, row_number() OVER (PARTITION BY day ORDER BY volume DESC NULLS LAST, market) AS rank_first FROM bars",
)(lambda s, d: r.liquidity_ranks(bars_1d(s, d), "volume"))
query(
    "r_03_rolling_z", "day:s med_ret_z60:d turnover_z60:d",
    f"{W}, {BREADTH} SELECT day, CASE WHEN count(med_ret) OVER ({WB.format(59)}) >= 60 THEN (med_ret - avg(med_ret) OVER ({WB.format(59)})) / (stddev_samp(med_ret) OVER ({WB.format(59)}) + 1e-12) END AS med_ret_z60, CASE WHEN count(turnover) OVER ({WB.format(59)}) >= 60 THEN (turnover - avg(turnover) OVER ({WB.format(59)})) / (stddev_samp(turnover) OVER ({WB.format(59)}) + 1e-12) END AS turnover_z60 FROM br",
)(lambda s, d: r.rolling_z(r.breadth(bars_1d(s, d)), ["med_ret", "turnover"], 60))
SCORE = f"""pan AS (SELECT *, close / {lg('close')} - 1 AS r1, close / {lg('close', 3)} - 1 AS r3, close / {lg('close', 7)} - 1 AS r7, quote_volume / (({ro('avg', 'quote_volume', 7)}) + 1e-12) AS s7, ln(quote_volume + 1) AS lq FROM bars),
 lagd AS (SELECT day, market, open, high, low, close, {lg('r1')} AS r1, {lg('r3')} AS r3, {lg('r7')} AS r7, {lg('s7')} AS s7, {lg('lq')} AS lq, {lg('quote_volume')} AS uq, row_number() OVER (PARTITION BY market ORDER BY day) - 1 AS history FROM pan),
 sc AS (SELECT *, (coalesce({pr('r1')}, 0.5) + coalesce({pr('r3')}, 0.5) + coalesce({pr('r7')}, 0.5) + coalesce({pr('s7')}, 0.5) + coalesce({pr('lq')}, 0.5)) / 5.0 AS score, CASE WHEN uq IS NOT NULL THEN rank() OVER (PARTITION BY day ORDER BY uq DESC NULLS LAST) END AS liq FROM lagd)"""
query("r_04_rank_mean_score", K + "score:d", f"{W}, {SCORE} SELECT day, market, score FROM sc")(lambda s, d: r.scored(bars_1d(s, d)))
query("r_05_static_universe", K + "liq:l", f"{W}, {SCORE} SELECT day, market, liq FROM sc WHERE liq <= 10")(lambda s, d: r.scored(bars_1d(s, d)).where("liq <= 10"))
query("r_06_dynamic_universe", K + "liq:l surge:d", f"{W}, {SCORE} SELECT day, market, liq, s7 AS surge FROM sc WHERE liq <= 8 OR s7 >= 1.5")(lambda s, d: r.scored(bars_1d(s, d)).where("liq <= 8 or s7 >= 1.5").withColumn("surge", F.col("s7")))
query(
    "r_11_top_k", K + "rk:l score:d", f"{W}, {SCORE}, k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, market) AS rk FROM sc WHERE liq <= 10) SELECT day, market, rk, score FROM k WHERE rk <= 3",
)(lambda s, d: r.top_k(r.scored(bars_1d(s, d)).where("liq <= 10"), "score", 3))
FLAG = f"""{W}, {SCORE}, k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, market) AS rk FROM sc WHERE liq <= 10 AND history >= 70),
 o AS (SELECT *, (high / open - 1 >= 0.05)::INT AS hit FROM k)"""
query("flagship_precision_at_3", "day:s picks:l hits:l positives:l precision_at_3:d recall_at_3:d", f"{FLAG} SELECT day, sum((rk <= 3)::INT) AS picks, sum(CASE WHEN rk <= 3 THEN hit ELSE 0 END) AS hits, sum(hit) AS positives, sum(CASE WHEN rk <= 3 THEN hit ELSE 0 END) / sum((rk <= 3)::INT)::DOUBLE AS precision_at_3, sum(CASE WHEN rk <= 3 THEN hit ELSE 0 END) / nullif(sum(hit), 0)::DOUBLE AS recall_at_3 FROM o GROUP BY day")(
    lambda s, d: r.precision_at(r.scored(bars_1d(s, d)).where("liq <= 10 and history >= 70").withColumn("hit", (F.col("high") / F.col("open") - 1 >= 0.05).cast("int")), 3)
)
query(
    "a_02_decile_screen", "bucket:l n:l hits:l rate:d lift:d",
    f"{FLAG}, q AS (SELECT *, row_number() OVER (ORDER BY round(score, 9), day, market) AS i, count(*) OVER () AS n FROM o), d AS (SELECT *, greatest(((i - 1) * 10 + n - 2) // (n - 1) - 1, 0) AS bucket FROM q) SELECT bucket, count(*) AS n, sum(hit) AS hits, avg(hit) AS rate, avg(hit) / (SELECT avg(hit) FROM o) AS lift FROM d GROUP BY bucket",
)(lambda s, d: r.bucket_screen(r.scored(bars_1d(s, d)).where("liq <= 10 and history >= 70").withColumn("hit", (F.col("high") / F.col("open") - 1 >= 0.05).cast("int")), "score", "hit", 10))
