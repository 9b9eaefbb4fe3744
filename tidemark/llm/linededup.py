"""Line dedup by content-defined chunks of lines, with an anchor at every line.

A passage is a run of lines, blank ones aside: two lines or more with MIN_WORDS words together, or one line of
LONG_LINE words. A rolling hash over the hashes of the last two non-blank lines ends a chunk where it is divisible by two,
so equal passages are cut alike wherever they stand, but for the cuts at their edges, which fall where the
neighbours say. So that every shared passage is found whole, each line also offers its anchors: the shortest
passage that starts with it and the shortest that ends with it. A line of a shared passage has one of the two
inside it, so anchors depend on the passage alone and cover it to the line.

Of each chunk or anchor that occurs more than once, the occurrence in the smallest (doc_id, text hash, position)
stays; others go if their bytes are equal. A line goes if any occurrence over it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import stored, utf8

MIN_WORDS, LONG_LINE = 12, 30
MOD, BASE = (1 << 61) - 1, 0x9E3779B97F4A7C15 >> 3


def line_chunks(text: bytes) -> list[tuple[int, int, int]]:
    """(first line, lines, words) of each chunk; blank lines belong to the chunk that they stand in."""
    out, first, n_words, n_lines, last = [], 0, 0, 0, 0
    lines = text.split(b"\n")
    for i, line in enumerate(lines):
        w = len(line.split())
        if not w:
            continue
        h = xxhash.xxh64_intdigest(line.strip()) % MOD
        if w >= LONG_LINE:
            if n_lines:
                out.append((first, i - first, n_words if n_lines > 1 else min(n_words, MIN_WORDS - 1)))
            out.append((i, 1, w))
            first, n_words, n_lines, last = i + 1, 0, 0, h
            continue
        n_words, n_lines = n_words + w, n_lines + 1
        rolled, last = (last * BASE + h) % MOD, h
        if rolled % 2 == 0 and n_lines > 1:
            out.append((first, i + 1 - first, n_words))
            first, n_words, n_lines = i + 1, 0, 0
    if n_lines:
        out.append((first, len(lines) - first, n_words if n_lines > 1 else min(n_words, MIN_WORDS - 1)))
    return out


def line_anchors(text: bytes) -> list[tuple[int, int]]:
    """(first line, lines) of the shortest passages that start or end with each non-blank line, sorted."""
    words = [len(x.split()) for x in text.split(b"\n")]
    full = [i for i, w in enumerate(words) if w]

    def shortest(order: list[int]) -> Iterator[tuple[int, int]]:
        end, total = 0, 0
        for k, i in enumerate(order):
            while end < len(order) and (end < k + 2 or total < MIN_WORDS) and not (end == k + 1 and words[i] >= LONG_LINE):
                total, end = total + words[order[end]], end + 1
            if end > k + 1 and total >= MIN_WORDS or words[i] >= LONG_LINE:
                yield i, i if words[i] >= LONG_LINE else order[end - 1]
            total -= words[i]

    spans = {(a, b) for a, b in shortest(full)} | {(b, a) for a, b in shortest(full[::-1])}
    return sorted((a, b + 1 - a) for a, b in spans)


def chunk_body(lines: list[bytes]) -> bytes:
    """What is compared: the lines without blank ones and without white space at their ends."""
    return b"\n".join(s for x in lines if (s := x.strip()))


def _key(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("__tm_th", F.xxhash64(F.col(text_col)))


def _chunk_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, start, n, ch): the chunks and anchors of each text, without their text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, start, n, ch = [], [], [], []
            for i, text in enumerate(utf8(b.column(2))):
                lines = [x.strip() for x in text.split(b"\n")]
                seen = set()
                for s, k in [*line_anchors(text), *((s, k) for s, k, w in line_chunks(text) if w >= MIN_WORDS)]:
                    while not lines[s]:
                        s, k = s + 1, k - 1
                    while not lines[s + k - 1]:
                        k -= 1
                    if (s, k) not in seen:
                        seen.add((s, k))
                        at.append(i), start.append(s), n.append(k), ch.append(xxhash.xxh64_intdigest(chunk_body(lines[s : s + k]), 1))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(np.array(ch, np.uint64).view(np.int64))], names=["id", "th", "start", "n", "ch"])

    return docs.select(F.col(id_col).alias("id"), F.col("__tm_th").alias("th"), text_col).mapInArrow(run, f"id {kind}, th long, start int, n int, ch long")


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the text compressed: texts are what is shuffled, so this halves the shuffles."""
    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if i == at else f for i, f in enumerate(docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([None if t is None else squeeze(t) for t in cols[at].cast(pa.large_binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, schema)


def _with_bodies(texts: DataFrame, kind: str) -> DataFrame:
    """(ch, id, th, start, n, kept, body) of the passages asked for in texts.wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            at, rows = [], []
            for i, (text, wanted) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                lines = [x.strip() for x in unpack(text).split(b"\n")]
                for w in wanted:
                    at.append(i), rows.append((w["ch"], w["start"], w["n"], w["kept"], chunk_body(lines[w["start"] : w["start"] + w["n"]])))
            take, cols = pa.array(at, pa.int64()), list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "th", "ch", "start", "n", "kept", "body"])

    return texts.mapInArrow(run, f"id {kind}, th long, ch long, start int, n int, kept boolean, body binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut from the text, and n_removed_lines, n_removed_words (long) and kept_in
    (ids of the rows that hold the kept occurrences, sorted).

    Every row stays; a text that is repeated whole becomes empty. Texts that lose nothing are unchanged to the byte; a null
    text stays null. Rows equal in id and text are one document: they keep or lose the same passages. A
    null id sorts before all others. An occurrence that overlaps the kept one in its own text loses only the lines after it.
    Blank lines go where the lines on both sides do. Columns with the names above are replaced, others pass.

    Texts are shuffled twice, compressed (to find the passages' bytes, and to cut them); else hashes move. A
    passage that thousands of texts share is a key of one kept row against many, which adaptive skew
    handling splits; only minima and counts are grouped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = _key(docs.drop("n_removed_lines", "n_removed_words", "kept_in"), text_col)
    chunks = stored(_chunk_rows(docs, id_col, text_col), "chunks")
    packed = _packed(docs, text_col)
    place = F.struct("id", "th", "start")
    repeated = chunks.groupBy("ch").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    wanted = (
        chunks.join(repeated, "ch").select("id", "th", F.struct("ch", "start", "n", place.eqNullSafe(F.col("first")).alias("kept")).alias("w"))
        .groupBy("id", "th").agg(F.collect_set("w").alias("wanted")).withColumnsRenamed({"id": "__tm_id", "th": "__tm_own"})
    )
    own = (F.col(id_col).eqNullSafe(F.col("__tm_id"))) & (F.col("__tm_th") == F.col("__tm_own"))
    texts = packed.select(id_col, "__tm_th", text_col).join(wanted, own).select(F.col(id_col).alias("id"), F.col("__tm_th").alias("th"), text_col, "wanted")
    bodies = stored(_with_bodies(texts, kind), "passages")
    first = bodies.where("kept").select("ch", *(F.col(c).alias(f"first_{c}") for c in ("id", "th", "start", "n", "body"))).dropDuplicates(["ch"])
    here = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    own_end = F.when(here, F.col("first_start") + F.col("first_n")).otherwise(0)
    cuts = (
        bodies.where("not kept").join(first, "ch").where("body = first_body")
        .select("id", "th", F.struct(F.greatest("start", own_end).alias("start"), (F.col("start") + F.col("n")).alias("end"), "first_id").alias("cut"))
        .groupBy("id", "th").agg(F.collect_set("cut").alias("__tm_cuts")).withColumnsRenamed({"id": "__tm_id", "th": "__tm_own"})
    )
    keep = [c for c in docs.columns if c != "__tm_th"]
    joined = packed.join(cuts, own, "left").select(*keep, "__tm_cuts")
    return _cut(joined, keep, id_col, text_col)


def _cut(docs: DataFrame, keep: list[str], id_col: str, text_col: str) -> DataFrame:
    schema = docs.select(*keep).schema.add("n_removed_lines", "long").add("n_removed_words", "long").add("kept_in", T.ArrayType(docs.schema[id_col].dataType))
    text_at = keep.index(text_col)
    schema.fields[text_at] = T.StructField(text_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts, n_lines, n_words, kept_in = [], [], [], []
            for blob, cuts in zip(b.column(text_at).to_pylist(), b.column(len(keep)).to_pylist()):
                out = text = None if blob is None else unpack(blob)
                gone, ids = set(), set()
                if cuts and text is not None:
                    lines = text.split(b"\n")
                    for c in cuts:
                        if c["start"] < c["end"]:
                            gone.update(range(c["start"], c["end"]))
                            ids.add(c["first_id"])
                    stay = [i for i, x in enumerate(lines) if x.strip() and i not in gone]
                    for lo, hi in zip([-1, *stay], [*stay, len(lines)]):
                        inside = [i for i in range(lo + 1, hi) if lines[i].strip()]
                        if inside:
                            gone.update(range(0 if lo < 0 else inside[0], hi if hi == len(lines) else inside[-1] + 1))
                    out = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
                    n_words.append(sum(len(lines[i].split()) for i in gone))
                else:
                    n_words.append(0)
                texts.append(out), n_lines.append(len(gone)), kept_in.append(sorted(ids, key=lambda x: (x is not None, x)))
            cols = list(b.columns[: len(keep)])
            cols[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_words, pa.int64()), pa.array(kept_in, pa.list_(b.schema.field(len(keep)).type.value_type.field("first_id").type))], names=[*keep, "n_removed_lines", "n_removed_words", "kept_in"])

    return docs.mapInArrow(run, schema)
