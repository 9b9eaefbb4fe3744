"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stored, stored

AT_ONCE, FEW = 1 << 17, 1 << 14


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a task, some at once, as (u, v) that join the same nodes: each but the smallest with the smallest that these links reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def flat(kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([find(x) for x in root], kind)], names=["u", "v"])

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
                if len(root) >= AT_ONCE:
                    yield flat(kind)
                    root.clear()
    if root:
        yield flat(kind)


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges stored, and what tells them from others: their count and a sum of hashes, taken as they are written."""
    seen = Observation()
    kept = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
    return kept, (seen.get["n"], seen.get["h"])


def rooted(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component), stored: component is the smallest node reachable. Nodes without links don't appear, nor does the smallest of a component.

    links: two columns of one type; loops, repeats, either direction and nulls are fine. Each task first joins what its own links join. At most
    FEW links that are left are joined as one task's own too: a bound, however large the input. Of more links, each
    round is a few shuffles of the link table, written to the shared folder; rounds grow with the logarithm of the
    longest chain. A node with very many links is split by adaptive skew handling: its links never meet
    in one group, only minima are taken per node.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    edges, before = _kept(edges.mapInArrow(_forests, edges.schema))
    for _ in range(max_rounds):
        if not before[0]:
            break
        if before[0] <= FEW:
            after = stored(edges.coalesce(1).mapInArrow(_forests, edges.schema), "links")
            drop_stored(edges)
            edges = after
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, now = _kept(rest.union(least).distinct())
        drop_stored(edges)
        edges = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.stored_at = edges.stored_at
    return out


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component): as `rooted`, with the smallest node of each component too."""
    found = rooted(links, a, b, max_rounds)
    return found.union(found.select("component", "component").distinct())
