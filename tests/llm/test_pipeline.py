import random

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.neardup import drop_near_duplicates, near_duplicates


def jaccard(a, b):
    s = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    return len(s(a) & s(b)) / max(1, len(s(a) | s(b)))


def test_near_copies_are_grouped_and_others_left(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 900 and lang = 'de'").select("text").distinct().orderBy("text").limit(60).collect()]
    rows, groups = [], {}
    for k, t in enumerate(texts):
        w = t.split()
        rows.append((k, t))
        for c in range(120 if k == 0 else 2):
            v = list(w)
            for at in range(7 + c % 20, len(v), 60):
                v[at] = f"edit{k}x{c}"
            rows.append((1000 * (k + 1) + c, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group for r in near_duplicates(df).collect()}
    missed = [(d, k) for d, t in rows if d >= 1000 for k in [d // 1000 - 1] if jaccard(t, texts[k]) >= 0.8 and got[d] != got[k]]
    assert len(got) == len(rows) and not missed
    by = {}
    for d, t in rows:
        by.setdefault(got[d], []).append((d, t))
    for members in by.values():
        origins = {d if d < 1000 else d // 1000 - 1 for d, _ in members}
        assert len(origins) == 1 or any(jaccard(texts[a], texts[b]) >= 0.6 for a in origins for b in origins if a < b)
    del groups


def test_near_duplicate_edges(spark):
    rows = [(5, "a b c d e f"), (3, "A b  c d e f"), (9, None), (8, ""), (None, "lone text with some words"), (7, "x"), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.group)) for r in near_duplicates(df).collect())
    assert got == sorted([("5", "3"), ("3", "3"), ("9", "8"), ("8", "8"), ("None", "None"), ("7", "7"), ("7", "7")])
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(df).collect()) == ["3", "7", "8", "None"]
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_raked_marginals_meet_their_targets(spark):
    cells = spark.createDataFrame([(a, b, float(1 + i * i)) for i, (a, b) in enumerate((a, b) for a in "abc" for b in "xy")], "_a string, _b string, tokens double")
    targets = {"_a": {"a": 0.2, "b": 0.5, "c": 0.3}, "_b": {"x": 0.6, "y": 0.4}}
    frames = {d: spark.createDataFrame(list(t.items()), f"{d} string, share double") for d, t in targets.items()}
    got = mixing.rake(cells, frames, sweeps=12)
    for d, t in targets.items():
        for r in got.groupBy(d).agg(F.sum("weight").alias("w")).collect():
            assert abs(r.w - t[r[0]]) < 1e-6


def test_sweeps_are_enough_and_extra_columns_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("topic", mixing.topic(F.col("text")))
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum(F.greatest(mixing.n_words(F.col("text")), F.lit(1))).alias("tokens"))
    targets = {d: mixing.tempered(cells, d) for d in mixing.DIMENSIONS}
    assert mixing.deviation(mixing.rake(cells, targets), targets) < 1e-3
    df = spark.createDataFrame([(1, "a b", "en", "s", "KEEPME", "x"), (1, "a b", "en", "s", "KEEPME", "x")], "doc_id long, text string, lang string, source string, _source string, n_words string")
    got = mixing.mix(df, keep=1.0).collect()
    assert [r._source for r in got] == ["KEEPME"] * 2 and all(r.n_words == 2 for r in got)


def test_mixing_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, "a b", "en", "s"), (4, "c | d", "de", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, prob double")
    got = mixing.mix(df, keep=1.0).collect()
    assert all(0 < r.prob <= 1 for r in got) and mixing.mix(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        assert set(docs.columns) <= set(out.columns) and (k == 4 or out.columns == docs.columns)
    assert 0 < cp.run(spark, sf).count() < docs.count()


def brute_groups(rows):
    bags = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def groups_of(spark, rows):
    return {r.doc_id: r.group for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_short_near_copies_equal_brute_force(spark):
    rnd = random.Random(7)
    texts = []
    for k in range(250):
        w = [f"w{k}x{i}" for i in range(rnd.randint(6, 60))]
        at = rnd.randrange(len(w))
        texts += [w, [*w, "appended"], ["prepended", *w], [*w[:at], "changed", *w[at + 1 :]]]
    rows = list(enumerate(" ".join(w) for w in texts))
    assert groups_of(spark, rows) == brute_groups(rows)


def test_hot_buckets_equal_brute_force(spark):
    rnd = random.Random(8)
    notice = [f"notice{i}" for i in range(40)]
    chain = [f"c{i}" for i in range(60)]
    texts = []
    for k in range(120):  # revisions: neighbours alike, ends not; every text holds the notice
        chain = [*chain[:]]
        chain[(7 * k) % 60] = f"r{k}"
        texts.append([*notice, *chain])
    origin = [f"o{i}" for i in range(90)]
    for k in range(150):  # altered copies whose original is missing
        w = list(origin)
        for at in rnd.sample(range(90), 2):
            w[at] = f"a{k}x{at}"
        texts.append([*notice, *w])
    for k in range(100):  # pairs that are mostly notice
        w = [f"s{k}x{i}" for i in range(rnd.randint(15, 25))]
        texts += [[*notice, *w], [*notice, *w[:-1], "last", f"p{k}"]]
    rows = list(enumerate(" ".join(w) for w in texts))
    rnd.shuffle(rows)
    rows = sorted((i, t) for i, (_, t) in enumerate(rows))
    assert groups_of(spark, rows) == brute_groups(rows)


def test_a_family_of_altered_copies_equals_brute_force(spark):
    """Copies of one text that keep between all and none of it: most pairs share keys, few are alike."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(260):
        w = list(base)
        for at in rnd.sample(range(150), rnd.randint(0, 30)):
            w[at] = f"e{k}x{at}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    assert groups_of(spark, rows) == brute_groups(rows)
