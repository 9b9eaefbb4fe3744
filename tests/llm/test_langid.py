import math
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm.common import fold
from tidemark.llm.langid import built, count_contexts, predict, train


def brute_bits(texts, text):
    """Code length by walking the tree for each byte."""
    tree = [defaultdict(lambda: defaultdict(int)) for _ in range(6)]
    for t in texts:
        b = bytes(5) + t.lower()
        for i in range(5, len(b)):
            for k in range(6):
                tree[k][b[i - k : i]][b[i]] += 1
    bits, b = 0.0, bytes(5) + text.lower()
    for i in range(5, len(b)):
        for k in range(5, -1, -1):
            node = tree[k].get(b[i - k : i])
            if not node or k > 2 and sum(node.values()) < 4:
                continue
            total = sum(node.values()) + len(node)
            if b[i] in node:
                bits -= math.log2(node[b[i]] / total)
                break
            bits -= math.log2(len(node) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark):
    texts = {"a": ["the cat and the hat and the cat and the hat", "that", "the cat the cat"], "b": ["der Hund und die M\u00e4use und der Hund und das Pferd und der Hund"]}
    model = built(count_contexts(spark.createDataFrame([(lang, t) for lang, ts in texts.items() for t in ts], "lang string, text string")))
    probes = [b"the hat", "M\u00e4use und der Hunt zzz \x07".encode(), b"", b"q" * 100_000, b"THE cat and " * 120_000, b"x"]
    got = model.code_lengths(probes)
    for p, bits in zip(probes, got):
        for i, lang in enumerate(model.languages):
            assert math.isclose(bits[i], brute_bits([t.encode() for t in texts[lang]], p), rel_tol=1e-4, abs_tol=1e-3)


def test_a_hundred_languages_are_small(spark):
    sample = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'de'").select("lang", "text").limit(1500)
    model = built(count_contexts(sample))
    assert 100 * sum(x.nbytes for part in (model.grams, model.costs, model.contexts, model.escapes) for x in part) < 500e6


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = docs.where(fold() != 0)
    model = train(known.select("doc_id", "lang"), known, per_language=40)
    out = predict(docs.where(fold() == 0).where(F.length("text") > 40), model)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_edges(spark):
    known = spark.createDataFrame([(1, "aa bb", "x"), (2, "cc dd", "y"), (3, "zz", None)], "doc_id long, text string, lang string")
    model = train(known.select("doc_id", "lang"), known)
    rows = [(1, None, "s"), (2, "", "s"), (3, "123 !!", None), (4, "aa", None), (None, "cc" * 50_000, None), (4, "aa", None)]
    got = predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "x", "y", "x"]
    assert all(0 <= r.score <= 1 for r in got)
    mixed = spark.createDataFrame([(1, "aa bb", "x"), (1, "cc dd", "y"), (2, "ee ff", "z"), (2, "ee ff", "z"), (3, "gg", "w")], "doc_id long, text string, lang string")
    assert train(mixed.select("doc_id", "lang"), mixed).languages == ["w"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = train(empty.select("doc_id", "lang"), empty)
    assert none is None and predict(empty, none).count() == 0
    assert predict(known, none).first().lang_pred == "und"


def test_samples_are_the_smallest_hashes(spark):
    from tidemark.llm.sampling import smallest_hashes

    rows = [(i, "hot" if i % 10 else "rare") for i in range(6000)] + [(9001, "one")]
    df = spark.createDataFrame(rows, "doc_id long, lang string")
    h = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))).collect()}
    got = {}
    for r in smallest_hashes(df, 100, by="lang").collect():
        got.setdefault(r.lang, set()).add(r.doc_id)
    for lang in ("hot", "rare", "one"):
        assert got[lang] == set(sorted((d for d, k in rows if k == lang), key=h.get)[:100])
