import random
import re
from collections import Counter

from tidemark.llm.decontam import with_hits


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []


def brute(docs, items, least=0.8):
    out = set()
    for i, t in items:
        s = shingles(t)
        if not s:
            continue
        for d, text in docs:
            g = shingles(text)
            n = min(len(s), len(g))
            for k in range(len(g) - n + 1 if n else 0):
                a, b = Counter(g[k : k + n]), Counter(s)
                both = sum(len(y) * min(c, b[y]) for y, c in a.items())
                total = sum(len(y) * c for y, c in (a | b).items())
                if both / total >= least:
                    out.add((d, i))
                    break
    return out


def test_equals_brute_force(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(25).collect()]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (_, t) in enumerate(items[:8]):
        w = t.split()
        docs.append((9000 + k, "lead in words " + t.upper().replace(" ", "  ") + " and so on"))
        w[len(w) // 3] = "changed"
        docs.append((9100 + k, "x y z " + " ".join(w) + " q"))
        docs.append((9200 + k, " ".join(w[: len(w) // 2])))
    items += [(777, "too short item"), (778, None), (779, items[0][1]), (780, "Two plus two")]
    docs += [(9900, "two plus two"), (9901, "so two plus two"), (9902, "Too short -- item!"), (9903, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hits int")
    got = with_hits(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, h.item_id) for r in got.collect() for h in r.hits} == brute(docs, items)


def test_edges(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "one two"), (None, "ONE, two; three-four five: six seven!"), (5, "z " * 200_000 + "one two three four five six seven")]
    got = {r.doc_id: r.hits for r in with_hits(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert not got[1] and not got[2] and not got[3] and len(got[None]) == 1 and got[5][0].start == 200_000
    assert with_hits(items.limit(0), items).count() == 0 and not with_hits(items, items.limit(0)).first().hits


def test_repeated_rows_ids_and_items(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "red green blue")], "item_id long, text string")
    rows = [(1, "one two three four five six seven", "k"), (1, "one two three four five six seven", "k"), (2, "Red, green; BLUE", None)]
    got = with_hits(spark.createDataFrame(rows, "doc_id long, text string, item_id string"), items).collect()
    assert sorted((r.doc_id, r.item_id, [h.item_id for h in r.hits]) for r in got if r.doc_id == 1) == [(1, "k", [1, 1])] * 2
    assert [h.item_id for r in got if r.doc_id == 2 for h in r.hits] == [None]


def test_finds_all_altered_items(spark):
    rnd = random.Random(3)
    items = [(k, " ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(20, 90)))) for k in range(20)]
    docs = []
    for k, t in items:
        for c in range(4):
            w = t.split()
            for at in rnd.sample(range(len(w)), max(1, len(w) // 45)):
                w[at] = f"new{c}x{at}"
            docs.append((100 * k + c, " ".join([f"f{rnd.randrange(10**6)}" for _ in range(30)] + w + [f"g{rnd.randrange(10**6)}" for _ in range(30)])))
    got = with_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, h.item_id) for r in got.collect() for h in r.hits} == brute(docs, items)
