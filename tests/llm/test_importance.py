"""Importance resampling: CRCs against zlib, whole results against SQL, edges."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import importance as I
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def brute(text: str) -> list[int]:
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    grams = [" ".join(w[i : i + k]) for i in range(len(w)) for k in (1, 2) if i + k <= len(w)]
    return [zlib.crc32(g.encode()) % 10_000 for g in grams]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ é×0 .\n", max_size=40), max_size=8))
def test_features_equal_zlib(texts):
    values, first, _ = I.features_of([t.encode() for t in texts])
    assert [values[first[i] : first[i + 1]].tolist() for i in range(len(texts))] == [brute(t) for t in texts]


def test_long_words_and_three_words():
    texts = ["q" * 70_000 + " x " + "é" * 3000, "a b c d"]
    values, first, n = I.features_of([t.encode() for t in texts], 1 << 30, 3)
    want = [zlib.crc32(g.encode()) % (1 << 30) for g in ("a", "a b", "a b c", "b", "b c", "b c d", "c", "c d", "d")]
    assert values[first[1] :].tolist() == want and n.tolist() == [3, 4]
    assert values[0] == zlib.crc32(b"q" * 70_000) % (1 << 30)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({queries.oracle_sql()['op11_importance']})").fetchall()
    got = [tuple(r) for r in queries.op11_importance(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_edges(spark):
    words = " ".join(f"w{i}" for i in range(20))
    rows = [(1, None, "x"), (2, "", "x"), (3, "!!! ...", "x"), (4, words, "x"), (5, words, "x"), (5, words, "x"), (None, words, "x"), (6, words + " a" * 100_000, "x"), (7, "w0 w1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    target = spark.createDataFrame([("w0 w1 w2",), (None,)], "text string")
    got = I.resample(docs, target, share=60, keep=("score",)).collect()
    assert len(got) == len(rows) and sorted(r.rank for r in got if r["rank"]) == [1, 2, 3]
    zero = {r.doc_id: (r.n_features, r.weight, r["rank"]) for r in got}
    assert zero[1] == zero[2] == zero[3] == (0, 0, None) and zero[7][2] is None
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r.score for r in drawn] == sorted((r.score for r in drawn), reverse=True)
    rest = [r.score for r in got if r.n_words >= 20 and not r["rank"]]
    assert min(r.score for r in drawn) >= max(rest)
    assert I.resample(docs.limit(0), target).count() == 0
    assert {r.weight for r in I.resample(docs, target.limit(0)).collect()} != {0}


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_registers(n):
    data = np.frombuffer(bytes(i * 7 % 251 for i in range(n)), np.uint8)
    r = I.running(data)
    got = I.span_crcs(r, np.zeros(n + 1, np.int64), np.arange(n + 1))
    assert got.tolist() == [zlib.crc32(data[:i].tobytes()) for i in range(n + 1)]
