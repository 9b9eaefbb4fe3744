import math
import mmap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm
from tidemark.llm.common import fold


def split(ef, x):
    return x >> np.uint64(ef.low.width), x & ef.low.mask


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_elias_fano_finds_what_is_there(tmp_path, n):
    rnd = np.random.default_rng(1)
    x = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
    (tmp_path / "ef").write_bytes(lm.EliasFano.of(x))
    with open(tmp_path / "ef", "rb") as f:
        ef = lm.EliasFano(memoryview(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ)))
    probe = np.concatenate([x, x + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    got, known = ef.find(*split(ef, probe)), {y: i for i, y in enumerate(x.tolist())}
    assert got.tolist() == [known.get(y, -1) for y in probe.tolist()]


def test_children_of_uneven_parents():
    rnd = np.random.default_rng(2)
    high = np.sort(np.concatenate([rnd.integers(0, 900, 400), np.full(3000, 500), np.arange(900) * 3]))
    low = np.concatenate([np.sort(rnd.choice(1 << 21, k, replace=False)) for k in np.bincount(high) if k]).astype(np.uint64)
    ef = lm.EliasFano(memoryview(lm.EliasFano.encode(high, low, 21)))
    assert (ef.find(high.astype(np.uint64), low) == np.arange(len(high))).all()
    entries = set(zip(high.tolist(), low.tolist()))
    h, v = rnd.integers(0, 3200, 20_000), rnd.integers(0, 1 << 21, 20_000)
    assert ((ef.find(h.astype(np.uint64), v.astype(np.uint64)) >= 0) == [p in entries for p in zip(h.tolist(), v.tolist())]).all()


def test_open_levels_stay_packed():
    """What an open trie owns beside its mapping does not grow with it."""
    n = 200_000
    word = np.unique(np.random.default_rng(3).integers(0, 1 << 63, n, dtype=np.uint64))
    owner, ones = np.arange(len(word)), np.ones(len(word))
    buffer = lm.Trie.build(word, ones, owner, np.full(len(word), 5, np.uint64), ones, owner, np.full(len(word), 9, np.uint64), ones, len(word), len(word), 20)
    trie = lm.opened(buffer)
    for level in (trie.words, trie.pairs, trie.triples):
        for array in (level.low.buffer, level.high, level.zeros_before):
            assert not array.flags.owndata and array.base is not None
    assert len(buffer) < len(word) * (8 + 8 + 2 * 3.2 + 5 * 2 + 1)
    assert (trie.find_words(word) == owner).all()


def brute(rows):
    """Exact scores, without tries or quantising."""
    toks = lambda t: [x for x in (t or "").encode().lower().split()] + [None]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    uni, bi, tri, before, pair_before = Counter(), Counter(), Counter(), Counter(), Counter()
    for d, t in rows:
        if not held[d]:
            w = toks(t)
            v, u = ["<s>", *w[:-1]], ["<t>", "<s>", *w[:-2]][: len(w)]
            uni.update(w), bi.update(zip(v, w)), tri.update(zip(u, v, w)), before.update(v), pair_before.update(zip(u, v))
    n, types = sum(uni.values()), len(uni)
    z = n + 0.5 * (types + 1)
    out = {}
    for d, t in rows:
        w = toks(t)
        base, s = sum(math.log10((uni[x] + 0.5) / z) for x in w), 0.0
        for u, v, x in zip(["<t>", "<s>", *w[:-2]][: len(w)], ["<s>", *w[:-1]], w):
            num = tri[u, v, x] + lm.PAIR * bi[v, x] + lm.BASE * (uni[x] + 0.5) / z
            s += math.log10(num / (pair_before[u, v] + lm.PAIR * before[v] + lm.BASE))
        out[d] = (held[d], len(w), sum(uni[x] > 0 for x in w), n, base, s)
    return out


def test_scores_equal_brute_force(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5001, None), (5002, ""), (5003, "the " * 30_000), (5004, "Zzyzx unseen"), (5006, " \t\n"), (5007, "the of " * 3_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    want = brute(rows)
    for shard_bytes in (1 << 24, 20_000):  # one that is hot, and many shards
        got = lm.score(df, fold() == 1, shard_bytes=shard_bytes, chunk_tokens=5_000).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert math.isclose(r.base_score, w[4], rel_tol=1e-9)
            assert math.isclose(r.score, w[5], rel_tol=1e-3, abs_tol=0.02), (r, w)


def test_probabilities_sum_to_one():
    texts = [["a", "b", "a", "c"], ["b", "a", "b", "a", "c"], ["c"], ["a", "b", "c"]]
    vocabulary = sorted({x for t in texts for x in t} | {"END"})
    number = {w: i for i, w in enumerate(["<t>", "<s>", *vocabulary])}
    uni, bi, tri = Counter(), Counter(), Counter()
    for t in texts:
        w = ["<t>", "<s>", *t, "END"]
        uni.update(w[2:]), bi.update(zip(w[2:], w[1:])), tri.update(zip(w[2:], w[1:], w))
    at = {w: i for i, w in enumerate(vocabulary)}
    pairs = sorted(bi, key=lambda p: (at[p[0]], number[p[1]]))
    triples = sorted(tri, key=lambda p: (at[p[0]], number[p[1]], number[p[2]]))
    place = {p: i for i, p in enumerate(pairs)}
    n = sum(uni.values())
    trie = lm.Trie(
        lm.Trie.build(
            np.arange(10, 10 + len(at), dtype=np.uint64), np.array([uni[w] for w in vocabulary]), np.array([at[p[0]] for p in pairs]), np.array([number[p[1]] for p in pairs], np.uint64), np.array([bi[p] for p in pairs]),
            np.array([place[p[:2]] for p in triples]), np.array([number[p[2]] for p in triples], np.uint64), np.array([tri[p] for p in triples]), n, len(at), 4,
        )
    )
    z = n + 0.5 * (len(at) + 1)
    for u, v in (("<t>", "<s>"), ("<s>", "a"), ("a", "b"), ("b", "a"), ("c", "a"), ("a", "c")):
        num, _ = trie.scores(np.arange(len(at)), np.full(len(at), number[v], np.uint64), np.full(len(at), number[u], np.uint64))
        _, den = trie.scores(np.array([at[v]]), np.array([number[u]], np.uint64), np.array([0], np.uint64)) if v in at else (0, [math.log10(len(texts) * (1 + lm.PAIR) + lm.BASE)])
        assert math.isclose(sum(10**num) + lm.BASE * 0.5 / z, 10 ** den[0], rel_tol=2e-3), (u, v)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, fold() == 1).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert lm.score(one, F.lit(True)).first().n_known == 0
    got = lm.score(spark.createDataFrame([(3, "a b"), (3, "a b"), (3, "c")], "doc_id long, text string"), F.lit(False)).collect()
    assert sorted((r.n_tokens, r.train_tokens) for r in got) == [(2, 8), (3, 8), (3, 8)]
