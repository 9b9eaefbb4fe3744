import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.simhash import covering_links, covering_masks, hex16, signed, simhash_components


def brute_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        out.append((d, f"{fps[i]:016x}", min(ids)))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in simhash_components(df).select("doc_id", hex16(F.col("fp")), "component_id").collect())


def test_masks_cover_every_pair():
    for radius in (2, 4):
        masks = covering_masks(radius)
        for _ in range(300):
            diff = sum(1 << i for i in random.sample(range(64), radius))
            assert any(m & diff == 0 for m in masks)


def test_matches_brute_force_on_documents(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, "one two"), (10_003, "ONE  two\t"), (10_004, " x"), (10_005, "a " * 40_000)]
    assert run(spark, rows) == brute_components(rows)


@pytest.mark.parametrize("small", [2, 64])
def test_links_equal_all_pairs(spark, small):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(12)]
    pts = set(base)
    for b in base:
        for _ in range(25):
            pts.add(b ^ sum(1 << i for i in rnd.sample(range(64), rnd.choice([1, 2, 3, 4]))))
    pts = sorted(pts)
    df = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(pts)], "node long, fp long")
    links = {(r.a, r.b) for r in covering_links(df, 2, small).collect()}
    true = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if (pts[i] ^ pts[j]).bit_count() <= 2}

    def groups(pairs):
        label = list(range(len(pts)))
        for _ in range(len(pts)):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert {tuple(sorted(p)) for p in links} <= true
    assert groups(links) == groups(true)


def test_null_ids_repeats_and_empty_table(spark):
    got = run(spark, [(3, "x y z"), (3, "x y z")])
    assert [g[2] for g in got] == [3, 3]
    df = spark.createDataFrame([(None, "x y z"), (4, "x y z"), (None, "lone text here now")], "doc_id long, text string")
    assert sorted(str(r[2]) for r in simhash_components(df).collect()) == ["4", "4", "None"]
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string, component_id long, fp int")).count() == 0
