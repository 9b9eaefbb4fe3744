"""Queries against their SQL on small made tables: what the given tables show only at other sizes."""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.plans import catalogue


def lineitem(path, prices):
    """A lineitem table whose bars have these closes (in cents above 90.00), one row a (market, day): {market: [cents]}."""
    rows = [(k, 0, 0, m, 1, 10.0, float(c), 0.0, 0.0, dt.datetime(1996, 1, 1) + dt.timedelta(days=k)) for m, cents in prices.items() for k, c in enumerate(cents)]
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax_", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows))))).drop_columns("l_tax_"), f"{path}/lineitem.parquet")


def both(spark, path, name):
    """Sorted rows of the query and of its SQL."""
    df = catalogue.queries()[name](spark, str(path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/lineitem.parquet')")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(want, key=str)


@pytest.mark.parametrize("name, days, empty", [("p_09_setup_families", 75, 5), ("p_10_policies", 5, 6)])
def test_families_without_rows_are_counted(spark, tmp_path, name, days, empty):
    lineitem(tmp_path, {m: [500] * days for m in range(3)})
    got, want = both(spark, tmp_path, name)
    assert len(got) == 6 and got == want
    assert sum(r[1:] == (0, None) for r in got) == empty


@pytest.mark.parametrize("seed", [6, 23, 35])
def test_equal_bands_are_told_as_in_sql(spark, tmp_path, seed):
    """The last close is the one that leaves the window: two widths of the same twenty closes, which the last bits tell apart."""
    cents = [(draw := random.Random(seed)).randrange(2000), *[draw.randrange(2000) for _ in range(28)]]
    lineitem(tmp_path, {1: cents + [cents[9]]})
    got, want = both(spark, tmp_path, "f_08_bollinger")
    assert len(got) == 30 and got == want
