"""Spelling variants: the index and its searches against brute force, whole results against SQL, edges."""

import duckdb
import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import queries
from tidemark.llm import spelling as S

SF = "/root/testdata/sf0.001"


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def searched(words: list[str]) -> set[tuple[str, str]]:
    rows = pd.DataFrame([(w, first, True, True) for w in words for first in (True, False)], columns=["word", "first", "held", "asks"])
    return {p for a, b in S.shard_pairs(rows) for p in zip(a, b)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=2, max_size=9), min_size=1, max_size=40))
def test_searches_equal_brute_force(words):
    words = sorted(words)
    assert searched(words) == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_suffix_order_and_ranks():
    text = np.array([2, 3, 2, 2, 3, 2, 1, 0])
    order = S.suffix_order(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    w = S.WaveletMatrix(text, 2)
    for c in range(4):
        for lo in range(9):
            for hi in range(lo, 9):
                got = [int(x[0]) for x in w.ranks(np.array([c]), np.array([lo]), np.array([hi]))]
                assert got == [int((text[:lo] == c).sum()), int((text[:hi] == c).sum()), int((text[lo:hi] < c).sum())]


def test_small_shards_and_pieces_find_the_same(spark):
    words = sorted({"prefix" + a + b + "suffix" for a in "abcdefg" for b in "abcdefgé"} | {"prefixsuffix", "prefixasuffi", "unrelated"})
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(a, b) for a in words for b in words if one_apart(a, b)}
    for shard, piece in ((1 << 20, 1 << 20), (50, 3)):
        rows = [tuple(r) for r in S.near_words(vocabulary, shard=shard, piece=piece).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({queries.oracle_sql()['op12_spelling']})").fetchall()
    got = [tuple(r) for r in queries.op12_spelling(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chains_ties_and_edges(spark):
    counts = [("spelling", 1000), ("speling", 100), ("spelingg", 10), ("spellinga", 1000), ("spelinga", 2), ("alone-", 5), ("x" * 5000 + "ab", 3), ("x" * 5000 + "b", 30)]
    vocabulary = spark.createDataFrame(counts, "word string, n long")
    got = {r.word: r for r in S.variants(vocabulary, min_length=6).collect()}
    assert (got["spelingg"].form, got["spelingg"].root, got["spelingg"].form_n) == ("speling", "spelling", 100)
    assert got["spelinga"].form == "spellinga" and got["spelinga"].n_near == 3
    assert got["spelling"].form is None and got["spelling"].root == "spelling" and got["alone-"].n_near == 0
    assert got["x" * 5000 + "ab"].form == "x" * 5000 + "b"
    assert S.variants(vocabulary.limit(0)).count() == 0


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, "Straße STRASSE strasse, naïvely NAÏVELY x" , 1), (None, None, 1), (2, "", 1), (2, "strasse " * 3, 1)], "doc_id long, text string, n int")
    got = {r.word: r.n for r in S.vocabulary_of(docs).collect()}
    assert got == {"strasse": 5}  # Ï stays apart from ï; six letters are too few
