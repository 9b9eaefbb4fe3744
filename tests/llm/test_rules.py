import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.rules import FEATURES, features, learn, quality_counts, verdict

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = W.findall(t)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {i + j for v in where.values() if len(v) > 1 for i in v for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def test_counts_equal_brute_force(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, "a b"), (-4, "a a a a"), (-5, "x\n\nx\n \n y z é \x0b\x0c|"), (-6, "a b c " * 30_000), (None, "é\né")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_counts(df).collect()}
    assert got == {d: brute(t) for d, t in rows}
    assert quality_counts(df.limit(0)).count() == 0


def test_learned_list_separates_and_runs_in_spark(spark):
    rnd = np.random.default_rng(2)
    x = {f: rnd.random(900) for f in FEATURES}
    junk = ((x["symbol_share"] > 0.8) | ((x["mean_word"] < 0.3) & (x["digit_share"] > 0.6))).astype(int)
    rules = learn(x, junk)
    assert len(rules) >= 2 and all(r.conditions for r in rules)
    df = spark.createDataFrame([(*(float(x[f][i]) for f in FEATURES), int(junk[i])) for i in range(900)], ", ".join(f"{f} double" for f in FEATURES) + ", junk int")
    right = df.select((verdict(rules) == F.col("junk")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.97
    assert learn({f: np.empty(0) for f in FEATURES}, np.empty(0)) == [] and learn(x, np.zeros(900)) == []


def test_quotients_by_zero_are_zero(spark):
    df = quality_counts(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    assert all(v == 0 for v in df.select(*features()).first())
