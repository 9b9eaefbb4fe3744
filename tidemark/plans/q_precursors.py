"""Queries: snapshots before the end of a session."""

from __future__ import annotations

from tidemark.operators import precursors as pc
from tidemark.plans.duck import TRADES, intraday
from tidemark.plans.registry import query
from tidemark.sources.adapters import bars_intraday, index_intraday

SESSION = "(ts - INTERVAL 9 HOUR)::DATE"


def over(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} - 1 END"


def share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


def index_bars(minutes: int) -> str:
    at = f"to_timestamp((epoch_us(ts) // 1000000) // {60 * minutes} * {60 * minutes})::TIMESTAMP"
    return f"xb AS (SELECT {at} AS t, first(cents ORDER BY ts, event_id) / 100.0 AS open, last(cents ORDER BY ts, event_id) / 100.0 AS close FROM trades GROUP BY 1)"


def snapshot_sql(spec: pc.Snapshot, bench: str, columns: dict[str, str]) -> str:
    """The snapshot bar q of each session and, of the bars b of the session up to it, the aggregates of each look-back."""
    looks = {**spec.looks, "day": 24 * 60}
    inside = lambda m: f"b.ts >= q.ts - INTERVAL {m} MINUTE"
    aggs = ", ".join(
        f"arg_min(b.open, b.ts) FILTER ({inside(m)}) AS first_{n}, sum(b.volume) FILTER ({inside(m)}) AS vol_{n}, max(b.high) FILTER ({inside(m)}) AS high_{n}, min(b.low) FILTER ({inside(m)}) AS low_{n}" for n, m in looks.items()
    )
    frame = f"(PARTITION BY market ORDER BY ts ROWS BETWEEN {spec.before} PRECEDING AND 1 PRECEDING)"
    half = f"count(*) OVER {frame} >= {spec.before // 2}"
    return f"""WITH {TRADES}, {intraday(spec.step)}, {index_bars(spec.step)}, be AS (SELECT t, {bench} AS bench FROM xb),
 r AS (SELECT *, {SESSION} AS session, CASE WHEN {half} THEN avg(volume) OVER {frame} END AS mean, CASE WHEN {half} THEN max(high) OVER {frame} END AS top, count(*) OVER (PARTITION BY market) AS bars FROM ibars),
 q AS (SELECT * FROM r WHERE bars >= {spec.least} AND ts = session + INTERVAL 9 HOUR + INTERVAL {spec.at} MINUTE),
 s AS (SELECT q.market, q.session, any_value(q.ts) AS at_, any_value(q.open) AS o, any_value(q.high) AS h, any_value(q.low) AS l, any_value(q.close) AS c, any_value(q.volume) AS v, any_value(q.mean) AS mean, any_value(q.top) AS top, {aggs}
  FROM q JOIN r b ON b.market = q.market AND b.session = q.session AND b.ts <= q.ts GROUP BY ALL)
 SELECT s.session, market, {", ".join(f"{v} AS {n}" for n, v in columns.items())}, avg((coalesce({over("c", "o")}, 0) > 0)::INT) OVER (PARTITION BY s.session) AS pre{spec.unit}_breadth FROM s LEFT JOIN be ON be.t = at_"""


def columns_of(spec: pc.Snapshot) -> dict[str, str]:
    u, clock, close = spec.unit, spec.clock, "close07" if spec is pc.HOURLY else "close0830"
    out = {f"pre{u}_ret": over("c", "o"), f"pre{u}_vol_ratio": share("v", "mean"), f"pre{u}_range_pct": share("h - l", "o"), f"pre{u}_close_position": "(c - l) / greatest(h - l, 1e-9)"}
    for name, minutes in spec.looks.items():
        out |= {f"pre{name}_ret": over("c", f"first_{name}"), f"pre{name}_vol_ratio": share(f"vol_{name}", f"mean * {minutes // spec.step + 1}")}
    out |= {"range_5_to_8_expansion": share("high_3h - low_3h", "o")} if spec is pc.HOURLY else {"pre3h_range_pct": share("high_3h - low_3h", "first_3h")}
    return out | {
        "breakout_24h_high": over("c", "top"), f"pre{u}_btc_ret": "bench", f"cum_max_ret_to_{clock}": over("high_day", "first_day"), f"cum_dd_to_{clock}": over("low_day", "first_day"),
        f"{close}_vs_cum_high": over("c", "high_day"), f"{close}_vs_day_open": over("c", "first_day"), f"cum_volume_to_{clock}": share("vol_day", f"mean * {spec.at // spec.step + 1}"),
    }


query(
    "f_23_precursor_4h", "session:s market:s pre_vol_ratio:d pre_price_change:d pre_range_pct:d pre_close_position:d pre_day_to_bar5_max:d pre_day_to_bar5_dd:d pre_bar5_close_vs_day_high:d",
    f"""WITH {TRADES}, {intraday(240)}, b AS (SELECT *, {SESSION} AS session, row_number() OVER (PARTITION BY market, {SESSION} ORDER BY ts) AS i FROM ibars),
 d AS (SELECT market, session, arg_min(open, i) AS o, max(high) AS t, min(low) AS m, avg(volume) FILTER (i < 5) AS mean, count(*) AS n FROM b WHERE i <= 5 GROUP BY ALL)
 SELECT b.session, b.market, volume / greatest(mean, 1e-9) AS pre_vol_ratio, close / greatest(open, 1e-9) - 1 AS pre_price_change, (high - low) / greatest(open, 1e-9) AS pre_range_pct, (close - low) / greatest(high - low, 1e-9) AS pre_close_position,
 t / greatest(o, 1e-9) - 1 AS pre_day_to_bar5_max, m / greatest(o, 1e-9) - 1 AS pre_day_to_bar5_dd, close / greatest(t, 1e-9) - 1 AS pre_bar5_close_vs_day_high FROM b JOIN d ON d.market = b.market AND d.session = b.session AND d.n = 5 WHERE i = 5""",
)(lambda s, d: pc.fifth_bar(bars_intraday(s, d, 240)))
for name, spec, bench, returns in (
    ("f_24_precursor_1h", pc.HOURLY, over("close", "lag(close) OVER (ORDER BY t)"), pc.benchmark_hourly),
    ("f_25_precursor_15m", pc.QUARTERS, over("close", "lag(open, 3) OVER (ORDER BY t)"), pc.benchmark_quarters),
):
    named = columns_of(spec)
    query(name, "session:s market:s " + " ".join(f"{n}:d" for n in named) + f" pre{spec.unit}_breadth:d", snapshot_sql(spec, bench, named))(
        lambda s, d, spec=spec, returns=returns: pc.snapshot(bars_intraday(s, d, spec.step), returns(index_intraday(s, d, spec.step)), spec)
    )
