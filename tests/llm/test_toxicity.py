import random

from pyspark.sql import functions as F

from tidemark.llm.common import fold
from tidemark.llm.toxicity import Lexicon, score, train


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(4)
    terms = {"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))): 1.0 for _ in range(25)}
    lex = Lexicon(terms)
    for _ in range(3000):
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 8)))
        near = [(distance(t, w), w) for w in terms]
        near = [(d, w) for d, w in near if d == 0 or d == 1 and len(w) >= 5]
        assert lex.match(t) == (min(near) if near else None)
    assert Lexicon({"abcd*": 1.0}).match("abcdefg") == (0, "abcd*") and Lexicon({"abcd*": 1.0}).match("abxdefg") is None


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = train(labels.where(fold() != 0).select("doc_id", "toxic"), docs.where(fold() != 0))
    got = score(docs.where(fold() == 0), model).join(labels, "doc_id").select("toxic", "toxicity").collect()
    pos, neg = [r.toxicity for r in got if r.toxic], [r.toxicity for r in got if not r.toxic]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.8 and sum(n >= 0.5 for n in neg) <= 1


def test_misspelled_and_quoted(spark):
    rows = [(i, f"you are an idiot and a moron{i % 3} really {i}", 1) for i in range(40)] + [(100 + i, f"nice calm words about gardens and birds {i}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = train(docs.select("doc_id", "toxic"), docs.select("doc_id", "text"))
    probe = spark.createDataFrame([(1, "an idiott here", 0.0), (2, "calm birds", 0.0), (3, None, 0.0), (4, "", 0.0), (5, "idiot " * 50_000, 0.0), (None, "idiot", 0.0)], "doc_id long, text string, toxicity double")
    s = [r.toxicity for r in score(probe, model).orderBy(F.col("doc_id").asc_nulls_last()).collect()]
    assert s[0] > s[1] == s[2] == s[3] and s[4] > 0.5 and all(0 <= x <= 1 for x in s)
    none = train(docs.limit(0).select("doc_id", "toxic"), docs)
    assert score(probe, none).where("toxicity > 0.01").count() == 0 and score(probe.limit(0), none).count() == 0


def test_quoted_and_reported_terms_weigh_less(spark):
    rnd = random.Random(1)
    calm = lambda k: " ".join(rnd.choice("garden river bread morning window letter music table".split()) for _ in range(k))
    rows = [(f"{calm(6)} you are an idiot {calm(6)}", 1) for _ in range(150)] + [(f"{calm(14)}", 0) for _ in range(1200)]
    rows += [(f'{calm(3)} he called it "such an idiot move" {calm(3)}', 0) for _ in range(30)] + [(f"{calm(3)} the witness testified idiot was shouted {calm(3)}", 0) for _ in range(30)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int")
    model = train(docs.select("doc_id", "toxic"), docs.select("doc_id", "text"))
    assert "testified" in model.reporting and "garden" not in model.reporting
    probe = ["you are an idiot today", 'they printed "an idiot move" again', "another witness testified idiot was heard", '"' + "then calm " * 20 + "idiot " + "then calm " * 20 + '" and one mark "', "calm bread", "then calm " * 20 + "idiot " + "then calm " * 20 + " and one mark "]
    s = {r.doc_id: r.toxicity for r in score(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), model).collect()}
    assert s[0] > 0.5 > s[1] and s[2] < 0.5 and s[3] == s[5] and s[4] < 0.5


def test_repeated_ids_teach_nothing(spark):
    rows = [(i, "you idiot person", 1) for i in range(40)] + [(100 + i, "calm words about birds", 0) for i in range(60)]
    docs = spark.createDataFrame(rows + [(500, "pleasant text", 1), (500, "idiot text", 0)] * 30, "doc_id long, text string, toxic int")
    model = train(docs.select("doc_id", "toxic"), docs.select("doc_id", "text"))
    same = train(docs.where("doc_id < 500").select("doc_id", "toxic"), docs.where("doc_id < 500").select("doc_id", "text"))
    assert model.lexicon.weights == same.lexicon.weights and (model.weights == same.weights).all()
