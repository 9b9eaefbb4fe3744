import random

import pyarrow as pa
import pytest

from tidemark.llm import components
from tidemark.llm.components import connected_components


def brute(links):
    root = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
        p, q = root[a], root[b]
        if p != q:
            root = {x: min(p, q) if r in (p, q) else r for x, r in root.items()}
    return sorted(root.items())


def some_links(seed):
    rnd = random.Random(seed)
    chain = list(range(1000, 1060))
    rnd.shuffle(chain)
    return [*zip(chain, chain[1:]), *((rnd.randrange(300), rnd.randrange(300)) for _ in range(180)), *((2000, 2000 + i) for i in range(1, 90)), (2050, 2051), (2050, 2051)]


@pytest.mark.parametrize("parts", [1, 7])
def test_components_of_links_over_tasks(spark, parts):
    links = [(a, b) for a, b in some_links(parts) if a != b]
    df = spark.createDataFrame([*links, (5, 5), (None, 7)], "a long, b long").repartition(parts)
    assert sorted(tuple(r) for r in connected_components(df).collect()) == brute(links)
    assert connected_components(df.where("a < 0")).count() == 0


def test_forests_of_some_links_at_once(monkeypatch):
    monkeypatch.setattr(components, "AT_ONCE", 16)
    links = [(max(x), min(x)) for x in some_links(3) if x[0] != x[1]]
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])
    found = pa.Table.from_batches(list(components._forests([batch.slice(0, 100), batch.slice(100)])))
    assert found.num_rows <= len(links)
    assert brute(list(zip(found["u"].to_pylist(), found["v"].to_pylist()))) == brute(links)


def test_components_take_few_jobs(spark):
    links = spark.createDataFrame([(2000, 2000 + i) for i in range(1, 90)], "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    found = connected_components(links)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setJobGroup("other", "")
    assert found.count() == 90
    assert jobs <= 12, jobs


@pytest.mark.parametrize("few", [0, 40, 1 << 14])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    links = [(a, b) for a, b in some_links(11) if a != b]
    df = spark.createDataFrame([*links, (5, 5), (None, 7)], "a long, b long").repartition(5)
    assert sorted(tuple(r) for r in connected_components(df).collect()) == brute(links)


def test_few_links_take_no_rounds(spark):
    chain = list(range(1, 400))
    random.Random(2).shuffle(chain)
    links = spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long").repartition(6)
    spark.sparkContext.setJobGroup("few", "")
    found = connected_components(links)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("other", "")
    assert [tuple(r) for r in found.select("component").distinct().collect()] == [(1,)] and found.count() == 399
    assert jobs <= 4, jobs
