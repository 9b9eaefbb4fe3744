"""Importance resampling towards a target: hashed n-grams, whose CRCs are taken from running CRCs of whole texts.

A text is cut into words, written anew with one space between them, and scanned once: the register of its CRC after every byte is
kept. CRCs are linear over GF(2), so an n-gram's CRC is the register at its end, less the register at its start moved on by
the n-gram's length; moving on is a product of tables for 1, 2, 4, 8 ... zero bytes. No n-gram is ever cut out or hashed by itself.

Documents and target texts are both counted in hash buckets; the gain of a bucket is the log of its two shares' quotient, a
document's weight the mean gain of its features. Weights with Gumbel noise from the id are scores; the largest are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stored, stored, utf8
from tidemark.operators.ranks import with_sums_before

BUCKETS, LONGEST, SHARE, MIN_WORDS, SEED = 10_000, 2, 25, 20, 7
POLYNOMIAL, ONES = np.uint32(0xEDB88320), np.uint32(0xFFFFFFFF)
ROWS, GROUP = 10, 1 << 21  # a scan has 2**ROWS steps; texts are scanned together up to GROUP bytes

#: Bytes of words are kept, A-Z in lower case; all others separate.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@cache
def step() -> np.ndarray:
    """The register after one more byte: step()[(c ^ byte) & 255] ^ (c >> 8)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ POLYNOMIAL, c >> np.uint32(1))
    return c


def moved(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> np.uint32(8)) & 255] ^ tables[2][(c >> np.uint32(16)) & 255] ^ tables[3][c >> np.uint32(24)]


@cache
def zeros(k: int) -> np.ndarray:
    """Tables, one for each byte of a register, that move registers on by 2**k zero bytes."""
    if k:
        half = zeros(k - 1)
        return moved(half, half)
    c = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    return step()[c & 255] ^ (c >> np.uint32(8))


def move_on(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers moved on by n zero bytes each."""
    c, longest = c.copy(), int(n.max(initial=0))
    for k in range(longest.bit_length()):
        some = np.flatnonzero(n >> k & 1)
        c[some] = moved(zeros(k), c[some])
    return c


def running(data: np.ndarray) -> np.ndarray:
    """Registers, begun at zero, after 0, 1, ... bytes. Columns of 2**ROWS bytes are scanned side by side, then
    each takes over what the columns before it end with."""
    table, rows = step(), 1 << ROWS
    m = -(-len(data) // rows)
    across = np.zeros(m * rows, np.uint8)
    across[: len(data)] = data
    across = np.ascontiguousarray(across.reshape(m, rows).T)
    out = np.empty((rows, m), np.uint32)
    c = np.zeros(m, np.uint32)
    for i in range(rows):
        c = table[(c ^ across[i]) & 255] ^ (c >> np.uint32(8))
        out[i] = c
    a, b, d, e = zeros(ROWS).tolist()
    before, x = np.zeros(m, np.uint32), 0
    for k, end in enumerate(c.tolist()):
        before[k] = x
        x = a[x & 255] ^ b[x >> 8 & 255] ^ d[x >> 16 & 255] ^ e[x >> 24] ^ end
    for i in range(rows):
        before = table[before & 255] ^ (before >> np.uint32(8))
        out[i] ^= before
    return np.concatenate([np.zeros(1, np.uint32), out.T.ravel()[: len(data)]])


def span_crcs(registers: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of the bytes from start to end, from two registers."""
    return registers[end] ^ move_on(registers[start] ^ ONES, end - start) ^ ONES


def features_of(texts: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, where each text's begin, words of each text). At each word its n-grams, shortest first."""
    plain = [b" ".join(t.translate(WORD_BYTES).split()) for t in texts]
    data = np.frombuffer(b"\n".join(plain), np.uint8)
    edge = np.flatnonzero(np.diff((data > 32).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    begin = np.cumsum([0, *(len(t) + 1 for t in plain)])
    first = np.searchsorted(start, begin)
    n, last = len(start), np.repeat(first[1:], np.diff(first))
    registers = running(data)
    found, there = np.zeros((n, longest), np.int32), np.zeros((n, longest), bool)
    for k in range(longest):
        at = np.flatnonzero(np.arange(n) + k < last)
        found[at, k] = span_crcs(registers, start[at], end[at + k]) % np.uint32(buckets)
        there[at, k] = True
    upto = np.concatenate([[0], np.cumsum(there.sum(1))])
    return found[there], upto[first], np.diff(first)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP bytes; a longer text is alone."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if i > a and n + len(t) > GROUP:
            yield a, i
            a, n = i, 0
        n += len(t) + 1
    if texts:
        yield a, len(texts)


def featured(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """docs without their text, with n_words and features (the buckets of all n-grams). A null text has none of either;
    columns of these names are replaced."""
    others = [c for c in docs.columns if c not in (text_col, "n_words", "features")]
    rows = docs.select(*others, F.col(text_col).alias("__tm_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = utf8(batch.column("__tm_text")), batch.drop_columns(["__tm_text"])
            for a, b in _groups(texts):
                values, first, n = features_of(texts[a:b], buckets, longest)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([*own.slice(a, b - a).columns, pa.array(n, pa.int64()), lists], names=[*others, "n_words", "features"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__tm_text"), "n_words bigint", "features array<int>"])
    return rows.mapInArrow(scan, schema)


def bucket_counts(featured_: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket. A task sends at most `buckets` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some])], names=["bucket", "n"])

    return featured_.select("features").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the bucket counts of both sides: floor(1000 * ln of the quotient of smoothed shares)."""
    d, t = docs.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(d, "bucket", "left").join(t, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    whole = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return rows.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def weighted(featured_: DataFrame, gain: np.ndarray) -> DataFrame:
    """n_features and weight (the floored mean gain, zero without features) in place of features."""
    others = [c for c in featured_.columns if c != "features"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])])
            upto = np.concatenate([[0], np.cumsum(n)])
            weight = (sums[upto[1:]] - sums[upto[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n), pa.array(weight)], names=[*others, "n_features", "weight"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in featured_.schema if f.name != "features"), "n_features bigint", "weight bigint"])
    return featured_.mapInArrow(weigh, schema)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise from the id alone, times 1000; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, text_col: str = "text", id_col: str = "doc_id", target_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document's id and `keep` columns, with n_words, n_features, weight, score and rank: 1, 2, 3 ... for the `share` percent
    (rounded down) of the documents of at least min_words words that have the highest scores, null for the others.

    Ties go to the smaller id; of rows with one id and score any may come first. Null and empty texts have no features and weight
    0, and aren't drawn. Without documents the result is empty; without target texts all gains come from the
    documents' own counts. Kept columns with the name of a result are replaced.
    """
    results = ("n_words", "n_features", "weight", "score", "rank")
    rows = docs.select(id_col, *[c for c in keep if c != id_col and c not in results], F.col(text_col).alias("__tm_text"))
    counted = stored(featured(rows, "__tm_text", buckets, longest), "features")
    wanted = featured(target.select(F.col(target_text_col).alias("__tm_text")), "__tm_text", buckets, longest)
    table = gains(bucket_counts(counted, buckets), bucket_counts(wanted, buckets), buckets).collect()  # one row a bucket
    gain = np.zeros(buckets, np.int64)
    gain[[r.bucket for r in table]] = [r.gain for r in table]
    scored = weighted(counted, gain).withColumn("score", F.col("weight") + noise(F.col(id_col), seed)).withColumn("__tm_in", (F.col("n_words") >= min_words).cast("long"))
    narrow = stored(scored, "scored")
    drop_stored(counted)
    ranked = with_sums_before(narrow.withColumn("__tm_one", F.lit(1).cast("long")), [F.desc("__tm_in"), F.desc("score"), F.asc(id_col)], ["__tm_one", "__tm_in"])
    drop_stored(narrow)
    place = F.col("__tm_one_before") + 1
    drawn = (F.col("__tm_in") == 1) & (place <= F.floor(F.col("__tm_in_all") * share / 100))
    return ranked.withColumn("rank", F.when(drawn, place).cast("long")).select(*[c for c in rows.columns if c != "__tm_text"], *results)


def oracle(buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> str:
    """DuckDB SQL for resample() over documents and benchmark with n-grams of one and two words: each distinct n-gram's CRC is the
    sum of its bytes' own terms, moved on to its end."""
    return rf"""WITH RECURSIVE both_ AS (SELECT 0 AS side, doc_id, row_number() OVER () AS i, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
 w AS (SELECT side, doc_id, i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM both_),
 f AS (SELECT side, i, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS feature FROM w),
 fc AS (SELECT side, i, feature, count(*) AS n FROM f GROUP BY ALL),
 x AS (SELECT feature, hex(encode(feature)) AS h, strlen(feature) AS n FROM fc GROUP BY feature),
 bits AS (SELECT range AS v, list_reduce(list_concat([range], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256)),
 z AS (SELECT 0 AS k, v, t FROM bits UNION ALL SELECT k + 1, z.v, xor(b.t, z.t >> 8) FROM z JOIN bits b ON b.v = z.t & 255 WHERE k < (SELECT max(n) FROM x)),
 ones AS (SELECT 0 AS k, 4294967295 AS t UNION ALL SELECT k + 1, xor(b.t, o.t >> 8) FROM ones o JOIN bits b ON b.v = o.t & 255 WHERE k < (SELECT max(n) FROM x)),
 ats AS (SELECT feature, n, h, unnest(range(n)) AS j FROM x),
 sums AS (SELECT feature, any_value(ats.n) AS n, bit_xor(z.t) AS c FROM ats JOIN z ON z.k = ats.n - 1 - ats.j AND z.v = ('0x' || substr(ats.h, 2 * ats.j + 1, 2))::BIGINT GROUP BY feature),
 crc AS (SELECT feature, xor(xor(sums.c, ones.t), 4294967295) % {buckets} AS bucket FROM sums JOIN ones ON ones.k = sums.n),
 fb AS (SELECT side, i, bucket, sum(n) AS n FROM fc JOIN crc USING (feature) GROUP BY ALL),
 c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM fb GROUP BY bucket),
 g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + {buckets})) / ((s + 1) * (sum(t) OVER () + {buckets}))))::BIGINT AS gain FROM c),
 d AS (SELECT i, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM fb JOIN g USING (bucket) WHERE side = 0 GROUP BY i),
 s AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= {min_words} AS ok,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d USING (i) WHERE side = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY ok) AS n FROM s)
 SELECT doc_id, n_features, weight, score, CASE WHEN ok AND place <= n * {share} // 100 THEN place END AS rank FROM r"""
