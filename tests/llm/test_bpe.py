"""BPE through the table of words against the tokenizers library, text by text."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOURCE = bpe.read_tokenizer(PATH)
LIBRARY = Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"
TEXTS = [
    "", None, "a  b\n\n c", "<|endoftext|>x<|endoftext|>", " 's'S don't I'LLx we've", "日本語 テキスト。かな", "emoji 👩‍👩‍👧    x", "՘႐⃀ ﻿", "  ", "tab\t\tx \x1c y\x85z \xa0",
    "x" * 3000, "é" * 10 + " naïve", "a \n" * 5, "\x00 null", ("word " * 100 + " ") * 20,
]


def hashed(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'stéЖ日1٣ \n\t\xa0\u2003\u3000\x85\x1c\u200b!<|>", max_size=60))
def test_words_equal_the_library(text):
    split = bpe.word_splitter(SOURCE)
    words = [w for part in bpe.run_splitter(SOURCE)(text) for run in part for w in split(run)]
    assert "".join(words) == text
    many = bpe.Words(SOURCE)
    coded = [many.coded(part) for part in bpe.run_splitter(SOURCE)(text)]
    codes, _ = many.words_of(np.concatenate(coded) if coded else np.zeros(0, np.int64))
    named = list(many.numbers)
    assert [named[c] for c in codes] == words
    assert words == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


def test_white_space_is_the_library_s():
    split = LIBRARY.pre_tokenizer.pre_tokenize_str
    points = [c for c in range(bpe.LATIN, 0x110000) if not 0xD800 <= c < 0xE000]
    # Of two and a letter, white space makes three words, and nothing else does.
    found = {c for c in points if len(split(chr(c) * 2 + "y")) == 3}
    mine = bpe.re.compile(f"[{bpe.WIDE_SPACES}]")
    assert found == {c for c in points if mine.match(chr(c))}


def test_slices_lose_nothing():
    text = ("ab  c\n d" * 50 + "x" * 100) * 3
    parts = list(bpe.slices(text, 10))
    assert "".join(parts) == text and len(parts) > 20
    whole = [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
    assert [w for p in parts for w in bpe.latin_words(SOURCE).findall(p)] == whole


@pytest.mark.parametrize("chunk", [bpe.CHUNK, 5])
def test_texts_equal_the_library(spark, chunk):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(0, "twice", "k")], "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, SOURCE, chunk=chunk)
    assert encoded.columns == ["doc_id", "ids"]
    rows = [r for r in encoded.collect() if r.ids != LIBRARY.encode("twice").ids]
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    assert all(r.ids == LIBRARY.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids for r in rows)
    both = [r for r in bpe.encode_decode(docs, SOURCE, chunk=chunk).collect() if r.text != "twice"]
    decoded = [r for r in bpe.decode(encoded, SOURCE).collect() if r.text != "twice"]
    key = lambda r: (r.doc_id, r.text)
    assert sorted(map(key, both)) == sorted(map(key, decoded)) and sorted((r.doc_id, r.ids) for r in both) == sorted((r.doc_id, r.ids) for r in rows)
    assert all(r.text == LIBRARY.decode(LIBRARY.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in decoded)
    assert sorted(r.doc_id for r in decoded) == list(range(len(TEXTS)))
    assert bpe.decode(bpe.encode(docs.limit(0), SOURCE), SOURCE).count() == 0


def test_chunks_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    plan = bpe.encode_decode(docs, SOURCE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2  # words to their like, ids to their chunk


def test_decode_of_any_ids(spark):
    ids = [(1, [50256, 0, 220], "a"), (2, [], "b"), (3, None, "c"), (4, [162, 245], "d"), (5, [50256] * 30_000, "e"), (None, [5], "f"), (4, [162, 245], "d"), (6, [999_999, 5], "g")]
    rows = spark.createDataFrame(ids, "doc_id long, ids array<int>, text string").repartition(2)
    got = bpe.decode(rows.withColumnRenamed("text", "note"), SOURCE)
    want = sorted((str(k), n, LIBRARY.decode([i for i in v or [] if i < 60_000], skip_special_tokens=False)) for k, v, n in ids)
    assert sorted((str(r.doc_id), r.note, r.text) for r in got.collect()) == want


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashed(",".join(map(str, ids))), hashed(LIBRARY.decode(ids, skip_special_tokens=False)))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
