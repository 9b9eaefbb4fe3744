"""SimHash near-duplicates by covering locality-sensitive hashing.

A covering family of bit masks for radius r gives each bit position i a nonzero vector m(i) of r+1 bits;
table v (a nonzero vector too) keeps the positions with odd m(i)·v. Any r differing positions span at
most r dimensions, so some v is orthogonal to them all: that table keeps none of them, and the pair
collides there. With r = 2 there are 7 tables of 36 or 37 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, utf8, words
from tidemark.llm.components import connected_components

BITS, BLOCK, SMALL_BUCKET = 64, 1 << 14, 64


def covering_masks(radius: int) -> list[int]:
    vectors = range(1, 2 ** (radius + 1))
    owner = [i % len(vectors) + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (owner[i] & v).bit_count() % 2) for v in vectors]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(tokens: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the space-joined shingles in order, repeats included; fewer words: of the whole sequence."""
    if not tokens:
        return np.empty(0, np.uint64)
    joined, last = b" ".join(tokens), max(len(tokens) - size, 0)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:last].tolist()]
    stops = (ends[min(size, len(tokens)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], seed) for i, j in zip(starts, stops)], np.uint64)


def votes(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            total[8 * k : 8 * k + 8] += np.bincount(part[:, k], minlength=256) @ BYTE_BITS
    return total


BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero for none."""
    return int(np.packbits(votes(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the 64-bit SimHash of each whole text. Null, empty or wordless texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(words(t), shingle)) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def covering_links(points: DataFrame, radius: int = 2, small: int = SMALL_BUCKET) -> DataFrame:
    """(a, b): links that join exactly the points whose fingerprints differ in at most radius (even) bits,
    directly or through others within the radius of each other.

    points: (node long, fp long), fp distinct. A bucket of up to `small` points has its pairs verified in
    place. Points of larger buckets are linked through midpoints instead: each is sent to every value
    within radius/2 of it; two points are within the radius just if they share such a value, and no value
    can have more than sum C(64, i), i <= radius/2, points, so groups stay bounded however alike a hot
    group of copies is, and links grow with the points, not with their pairs.
    """
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("radius must be 2 or 4")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(covering_masks(radius))])
    keys = points.select("node", "fp", F.explode(tables).alias("k")).select("k.t", "k.key", "node", "fp")
    shared = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    keys = keys.join(shared, ["t", "key"])
    near = f"bit_count(x.fp ^ y.fp) <= {radius}"
    pairs = (
        keys.where(F.col("n") <= small).groupBy("t", "key").agg(F.collect_list(F.struct("node", "fp")).alias("p"))
        .select(F.explode(F.expr(f"flatten(transform(p, x -> transform(filter(p, y -> y.node > x.node and {near}), y -> struct(x.node as a, y.node as b))))")).alias("e"))
        .select("e.a", "e.b")
    )
    hot = keys.where(F.col("n") > small).select("node", "fp").distinct()
    ball = [0]
    for _ in range(radius // 2):
        ball = sorted({m ^ (1 << i) for m in ball for i in range(BITS)} | set(ball))
    midpoints = hot.select("node", F.explode(F.transform(F.lit([signed(m) for m in ball]), lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    stars = midpoints.groupBy("z").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1)
    return pairs.union(stars.select("a", F.explode("all").alias("b")).where("a != b"))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, fp, component_id (smallest id reachable through links of at most
    radius bits). Equal fingerprints count as one point, so a third of all rows may be copies of one text.

    Rows with equal ids each keep their row and go with their own fingerprint. A null id keeps its row and never names a component unless
    all ids of the component are null; then component_id is null. Wordless texts share fingerprint zero
    and are linked like any other. An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    points = fps.groupBy("fp").agg(F.min("id").alias("node"))
    known = points.where("node is not null")
    links = covering_links(known, radius)
    comps = connected_components(links)
    named = points.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
