"""Queries: reclaim entries after a pump."""

from __future__ import annotations

from tidemark.operators import reclaim as rc
from tidemark.plans.duck import TRADES, intraday
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_intraday

#: A quarter of the original rises and targets; one of ten markets is in reach of the top.
SETUP = rc.Setup(pump=0.015, top=6, cool=-0.002, target=0.01)
N = SETUP.window + SETUP.search + SETUP.hold + 1
W = SETUP.window


def walk(at: str, name: str) -> str:
    """SQL: the first stop and target from bar `at` on, within the hold."""
    inside = f"p.idx >= {at} AND p.idx < {at} + {SETUP.hold}"
    return f"""{name} AS (SELECT a.market, a.session, any_value(CASE WHEN p.idx = {at} THEN p.open END) AS e, min(CASE WHEN {inside} AND p.low <= a.stop THEN p.idx END) AS i,
 min(CASE WHEN {inside} AND p.high >= x.open * (1 + {SETUP.target}::DOUBLE) THEN p.idx END) AS j, any_value(CASE WHEN p.idx = {at} + {SETUP.hold - 1} THEN p.close END) AS c, any_value(a.stop) AS stop
 FROM a JOIN p ON p.market = a.market AND p.session = a.session JOIN p x ON x.market = a.market AND x.session = a.session AND x.idx = {at} GROUP BY ALL)"""


def gross(t: str) -> str:
    return f"CASE WHEN {t}.i IS NOT NULL AND ({t}.j IS NULL OR {t}.i <= {t}.j) THEN {t}.stop / {t}.e - 1 WHEN {t}.j IS NOT NULL THEN {SETUP.target}::DOUBLE ELSE {t}.c / {t}.e - 1 END"


query(
    "x_14_reclaim_entry", "market:s session:s no_new_high:b cooled:b contracting:b higher_low:b armed:b stop:d net_now:d hit_now:l broke:l net_reclaim:d",
    f"""WITH {TRADES}, {intraday(240)}, b AS (SELECT *, (ts - INTERVAL 9 HOUR)::DATE AS session, row_number() OVER (PARTITION BY market ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY market) AS bars FROM ibars),
 s AS (SELECT market, session, arg_min(open, k) AS open, max(high) AS ph, sum(quote_volume) AS qv, max(k) + 1 AS first, any_value(bars) AS bars FROM b GROUP BY ALL),
 s2 AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY qv DESC NULLS LAST, market) AS place FROM s),
 e AS (SELECT * FROM s2 WHERE ph / open - 1 >= {SETUP.pump}::DOUBLE AND place <= {SETUP.top} AND first + {W + SETUP.search + 1} < bars),
 p AS (SELECT e.market, e.session, e.ph, e.first, e.bars, b.k - e.first AS idx, b.open, b.high, b.low, b.close FROM e JOIN b ON b.market = e.market AND b.k BETWEEN e.first AND e.first + {N}),
 g AS (SELECT market, session, any_value(ph) AS ph, any_value(first) AS first, any_value(bars) AS bars, max(high) FILTER (idx < {W}) AS top, min(low) FILTER (idx < {W}) AS low, any_value(CASE WHEN idx = {W - 1} THEN close END) AS c,
  avg(high - low) FILTER (idx < {W}) AS rw, avg(high - low) FILTER (idx < {W // 2}) AS r1, avg(high - low) FILTER (idx >= {W // 2} AND idx < {W}) AS r2, min(low) FILTER (idx < {W // 2}) AS l1, min(low) FILTER (idx >= {W // 2} AND idx < {W}) AS l2 FROM p GROUP BY ALL),
 h AS (SELECT *, top <= ph AS no_new_high, c / ph - 1 <= {SETUP.cool}::DOUBLE AS cooled, r1 > r2 AS contracting, l2 >= l1 AS higher_low, low - {SETUP.atr} * rw AS stop FROM g),
 h2 AS (SELECT *, no_new_high AND cooled AND contracting AND higher_low AND first + {W + SETUP.hold} < bars AS armed FROM h),
 br AS (SELECT h2.market, h2.session, min(idx) AS broke FROM h2 JOIN p ON p.market = h2.market AND p.session = h2.session AND idx >= {W} AND idx < {W + SETUP.search} AND close > top WHERE armed GROUP BY ALL),
 a AS (SELECT h2.*, broke FROM h2 LEFT JOIN br USING (market, session) WHERE armed), {walk(str(W), "n1")}, {walk("(a.broke + 1)", "n2")}
 SELECT h2.market, h2.session, no_new_high, cooled, contracting, higher_low, armed, h2.stop, {gross("n1")} - 0.0015 AS net_now, CASE WHEN n1.i IS NOT NULL AND (n1.j IS NULL OR n1.i <= n1.j) THEN 0 WHEN n1.j IS NOT NULL THEN 1 END AS hit_now, broke,
 CASE WHEN h2.first + broke + {1 + SETUP.hold} < h2.bars THEN {gross("n2")} - 0.0015 END AS net_reclaim
 FROM h2 LEFT JOIN br USING (market, session) LEFT JOIN n1 ON n1.market = h2.market AND n1.session = h2.session LEFT JOIN n2 ON n2.market = h2.market AND n2.session = h2.session""",
)(lambda s, d: rc.reclaims(bars_intraday(s, d, 240), SETUP))
