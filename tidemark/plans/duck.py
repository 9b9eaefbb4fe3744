"""Pieces of DuckDB SQL for oracles: the market tables, and rolling frames."""

BARS = """bars AS (SELECT market, day, first(cents ORDER BY k) / 100.0 AS open, max(cents) / 100.0 AS high, min(cents) / 100.0 AS low,
 last(cents ORDER BY k) / 100.0 AS close, sum(qty)::DOUBLE AS volume, sum(cents * qty)::DOUBLE / 100.0 AS quote_volume, count(*) AS trades FROM (
 SELECT 'M' || lpad((l_suppkey % 20)::VARCHAR, 2, '0') AS market, l_shipdate::DATE AS day, 9000 + (floor(l_extendedprice)::BIGINT % 2000) AS cents, l_quantity::BIGINT AS qty,
 row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS k FROM lineitem) GROUP BY market, day)"""
TRADES = """trades AS (SELECT event_id, 'E' || (user_id % 10)::VARCHAR AS market, ts, 10000 + round(value * 2)::BIGINT AS cents, (10000 + round(value * 2)::BIGINT) / 100.0 AS price,
 CASE WHEN event_type IN ('purchase', 'signup') THEN 'BID' ELSE 'ASK' END AS side, 1.0 AS volume, epoch_us(ts) * 1000 AS event_ns,
 epoch_us(ts) * 1000 + event_id % 7 * 1000000 AS received_ns FROM events)"""
LEDGER = """ledger AS (SELECT o_orderkey AS trade_id, o_orderdate::DATE AS day, 'M' || lpad((o_custkey % 20)::VARCHAR, 2, '0') AS coin, o_orderpriority AS model_id,
 CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, ((floor(o_totalprice)::BIGINT % 2000) - 1000) / 100.0 AS net_pct FROM orders)"""
FOREIGN = "fx AS (SELECT 'X' || substr(market, 2) AS symbol, day, close * 2 AS close, quote_volume * 3 AS quote_volume FROM bars)"
EPS = "1e-12"


def intraday(minutes: int, name: str = "ibars") -> str:
    return f"""{name} AS (SELECT market, to_timestamp((epoch_us(ts) // 1000000) // {60 * minutes} * {60 * minutes})::TIMESTAMP AS ts, first(cents ORDER BY ts, event_id) / 100.0 AS open, max(cents) / 100.0 AS high,
 min(cents) / 100.0 AS low, last(cents ORDER BY ts, event_id) / 100.0 AS close, sum(volume) AS volume, sum(cents * volume) / 100.0 AS quote_volume, count(*) AS trades
 FROM trades GROUP BY market, to_timestamp((epoch_us(ts) // 1000000) // {60 * minutes} * {60 * minutes}))"""


def frame(n: int, last: int = 0, by: str = "market", order: str = "day") -> str:
    """The n rows that end `last` rows before this one."""
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1 + last} PRECEDING AND {end})"


def roll(agg: str, x: str, n: int, mp: int | None = None, last: int = 0, **kw: str) -> str:
    """A rolling aggregate that is NULL under mp (n if not given) non-null values."""
    w = frame(n, last, **kw)
    body = agg.format(x) if "{" in agg else f"{agg}({x})"
    return f"CASE WHEN count({x}) OVER {w} >= {n if mp is None else mp} THEN {body} OVER {w} END"


def lag(x: str, n: int = 1, by: str = "market", order: str = "day") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order})"


def pct_rank(x: str, by: str = "day") -> str:
    """Average-tie percentile rank; NULL for NULL."""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"
