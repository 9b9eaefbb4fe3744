"""The registered corpus queries on the small tables: columns, rows, folds; and the SQL of the one that has it."""

import zlib

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_mixing": {"doc_id": "bigint", "n_words": "bigint", "prob": "double"},
    "op6_extract": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7_linededup": {"doc_id": "bigint", "text": "string"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_decontam": {"doc_id": "bigint", "item_id": "bigint", "similarity": "double"},
    "op10_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11_importance": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op12_spelling": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}
FOLD = {"op2_language": 0, "op4_lm": 1, "op8_toxicity": 0}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    table, key = ("pages", "page_id") if name in ("op3_warc", "op6_extract") else ("documents", "doc_id")
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    out = queries.queries()[name](spark, SF)
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    if name == "op12_spelling":
        return
    rows = out.collect()
    got = sorted(r[key] for r in rows)
    if name in ("op5_mixing", "op9_decontam"):
        assert 0 < len(got) and set(got) <= set(ids)
    else:
        assert got == ids
    if name in FOLD:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == FOLD[name]) for r in rows)
    if name in ("op2_language", "op8_toxicity"):
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op3_warc":
        responses = {r.page_id for r in rows if r.record_type == "response"}
        assert all((r.refers_to in responses) == (r.record_type == "revisit") for r in rows)


def test_mixing_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(queries.oracle_sql()["op5_mixing"]).fetchall())
    got = sorted((r.doc_id, r.n_words, r.prob) for r in queries.op5_mixing(spark, SF).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))
