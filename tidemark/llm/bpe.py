"""Byte-pair encoding and decoding of whole texts through a table of distinct words.

Texts are split into the words that the tokenizer merges within. Each chunk of texts keeps its words as a dictionary and the texts
as positions in it. Equal words of all dictionaries meet in one slot of the table of distinct words, where each is encoded once; ids go back
to the dictionaries by place, where they are joined with the pieces of the vocabulary, and to the texts by position. Chunks are
stored in buckets, so that only words and ids are shuffled, many to a row and compressed. decode() takes any rows of ids: each
id is joined with its piece, whose table the vocabulary bounds, without a shuffle.

The tokenizer is a file of the tokenizers library: byte-level BPE without a normalizer. Its JSON, whose size the vocabulary
bounds, travels with the tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import new_folder

CHUNK, BLOCK, SLICE, LATIN, SLOTS = 1 << 25, 1 << 18, 1 << 18, 0x530, 256  # code points, runs, code points, code points, slots of a dictionary at least
# White space from LATIN on; the contractions that are words of their own, in order.
WIDE_SPACES = "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


@cache
def tokenizer_of(source: str) -> Tokenizer:
    """The tokenizer of a JSON text, without truncation or padding."""
    t = Tokenizer.from_str(source)
    t.no_truncation()
    t.no_padding()
    return t


def read_tokenizer(path: str) -> str:
    """The JSON of a tokenizer file that this library can split for: byte-level, its own pattern, no prefix space, no normalizer."""
    source = open(path, encoding="utf-8").read()
    j = json.loads(source)
    pre = j["pre_tokenizer"] or {}
    if j["model"]["type"] != "BPE" or j["normalizer"] is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level BPE with its own pattern")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in j["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take in their surroundings")
    return source


@cache
def latin_classes(source: str) -> tuple[str, str, str, str]:
    """Letters, numbers, others and white space among the code points under LATIN, as the library itself tells them apart."""
    split = tokenizer_of(source).pre_tokenizer.pre_tokenize_str
    one = lambda s: len(split(s)) == 1
    letter, number, other, space = "", "", "", ""
    for c in map(chr, range(LATIN)):
        if one("a" + c):
            letter += re.escape(c)
        elif one("1" + c):
            number += re.escape(c)
        elif one("!" + c):
            other += re.escape(c)
        else:
            space += re.escape(c)
    return letter, number, other, space


@cache
def latin_words(source: str) -> re.Pattern[str]:
    """The pattern of words for texts of code points under LATIN."""
    letter, number, other, space = latin_classes(source)
    return re.compile(f"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[{other}]+|[{space}]+(?![^{space}])|[{space}]+")


@cache
def runs(source: str) -> re.Pattern[str]:
    """Runs that no word crosses: of other than white space, with a space before them, or of white space as words have it."""
    space = latin_classes(source)[3] + WIDE_SPACES
    return re.compile(f" ?[^{space}]+|[{space}]+(?![^{space}])|[{space}]+")


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in parts of about size, cut before a space that follows no white space: no word spans such a place."""
    a = 0
    while len(text) - a > size:
        b = text.find(" ", a + size)
        while b >= 0 and text[b - 1].isspace():
            b = text.find(" ", b + 1)
        if b < 0:
            break
        yield text[a:b]
        a = b
    yield text[a:] if a else text


def word_splitter(source: str) -> Callable[[str], list[str]]:
    """A function that cuts a run into words: by pattern, or by the library where the run has code points from LATIN on."""
    t, pattern = tokenizer_of(source), latin_words(source)

    def words(run: str) -> list[str]:
        return pattern.findall(run) if ord(max(run)) < LATIN else [run[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(run)]

    return words


def run_splitter(source: str) -> Callable[[str], Iterator[list[str]]]:
    """A function that cuts a text into lists of runs. Added tokens, longest first as they stand, are runs of their own."""
    pattern = runs(source)
    added = sorted((a.content for a in tokenizer_of(source).get_added_tokens_decoder().values()), key=len, reverse=True)
    special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def split(text: str) -> Iterator[list[str]]:
        for i, part in enumerate(special.split(text) if special and special.search(text) else [text]):
            if i % 2:
                yield [part]
            elif part:
                for s in slices(part):
                    yield pattern.findall(s)

    return split


class Words:
    """The words of a chunk, numbered, and its distinct runs as numbers of words."""

    def __init__(self, source: str):
        self.numbers, self.split, self.added = Dictionary(), word_splitter(source), {a.content for a in tokenizer_of(source).get_added_tokens_decoder().values()}
        self.runs, self.flat, self.starts = Dictionary(), array("I"), array("q", [0])

    def coded(self, runs: list[str]) -> np.ndarray:
        """The numbers of runs, in order; new ones are cut into words."""
        known, codes = len(self.runs), np.fromiter(map(self.runs.__getitem__, runs), np.int64, len(runs))
        fresh = list(islice(reversed(self.runs), len(self.runs) - known))
        for run in reversed(fresh):
            self.flat.extend(map(self.numbers.__getitem__, [run] if run in self.added else self.split(run)))
            self.starts.append(len(self.flat))
        return codes

    def words_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of words, how many each run has) of the coded runs."""
        starts, flat = np.array(self.starts), np.array(self.flat)
        size = starts[codes + 1] - starts[codes]
        at = np.cumsum(size)
        return flat[np.arange(at[-1] if len(at) else 0) + np.repeat(starts[codes] - at + size, size)], size


class Dictionary(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blob(**columns: pa.Array) -> bytes:
    """Columns of one length as compressed bytes."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(blobs: pa.ChunkedArray) -> list[pa.Table]:
    return [pa.ipc.open_stream(b).read_all() for b in blobs.to_pylist()]


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers under 2**32, compressed: of each array first all lowest bytes, then the next ..., behind the arrays' lengths."""
    planes = b"".join(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    return np.array([len(arrays), *map(len, arrays)], "<i8").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(packed, "<i8", 1)[0])
    lengths = np.frombuffer(packed, "<i8", k, 8).tolist()
    planes = np.frombuffer(pa.decompress(packed[8 * (k + 1) :], decompressed_size=4 * sum(lengths), codec="zstd", asbytes=True), np.uint8) if sum(lengths) else np.zeros(0, np.uint8)
    parts = np.split(planes, np.cumsum(lengths)[:-1] * 4)
    return [np.ascontiguousarray(x.reshape(4, n).T).view("<u4").ravel().astype(np.int64) for x, n in zip(parts, lengths)]


def chunked(docs: DataFrame, source: str, text_col: str, slots: int, chunk: int = CHUNK) -> DataFrame:
    """Two kinds of rows, told apart by __tm_text. A text's: its chunk, its place there, its columns, its number of words and,
    with the last text of a block of them, the packed codes of all words of the block. A slot's: its chunk, number and, sorted, those words of the
    dictionary whose hash falls in it, with their places, packed.

    A chunk is a run of texts of one task of about `chunk` code points, or one longer text.
    """
    others = [c for c in docs.columns if c != text_col]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(["__tm_text boolean", "__tm_chunk bigint", "__tm_place int", *(f"`{c}` {types[c]}" for c in others), "__tm_n int", "__tm_codes binary", "__tm_words binary"])
    names = ["__tm_text", "__tm_chunk", "__tm_place", *others, "__tm_n", "__tm_codes", "__tm_words"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of, k = run_splitter(source), TaskContext.get().partitionId() << 32
        seen, size, placed, kinds = Words(source), 0, 0, []

        def block(own: pa.RecordBatch, found: list[np.ndarray], counts: list[int]) -> pa.RecordBatch:
            n, runs = len(counts), np.concatenate([[0], np.cumsum(counts)])
            codes, sizes = seen.words_of(np.concatenate(found) if found else np.zeros(0, np.int64))
            n_words = np.diff(np.concatenate([[0], np.cumsum(sizes)])[runs])
            blobs = pa.array([None] * (n - 1) + [_packed(codes)], pa.binary())
            ends = [pa.array(n_words, pa.int32()), blobs, pa.nulls(n, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.repeat(True, n), pa.repeat(pa.scalar(k, pa.int64()), n), pa.array(range(placed, placed + n), pa.int32()), *own.columns, *ends], names=names)

        def dictionary() -> Iterator[pa.RecordBatch]:
            numbers = seen.numbers
            listed = sorted(numbers)
            slot = np.fromiter((zlib.crc32(w.encode()) for w in listed), np.int64, len(listed)) % slots
            order = np.argsort(slot, kind="stable")
            held, first = np.unique(slot[order], return_index=True)
            words = pa.array(listed, pa.string()).take(pa.array(order))
            places = pa.array([numbers[w] for w in listed], pa.int32()).take(pa.array(order))
            ends = np.append(first, len(listed)).tolist()
            blobs = [_blob(word=words.slice(a, b - a), place=places.slice(a, b - a)) for a, b in zip(ends, ends[1:])]
            n = len(held)
            yield pa.RecordBatch.from_arrays([pa.repeat(False, n), pa.repeat(pa.scalar(k, pa.int64()), n), pa.array(held, pa.int32()), *(pa.nulls(n, t) for t in kinds), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(blobs, pa.binary())], names=names)

        for batch in batches:
            own, column = batch.select(others), batch.column(text_col)
            kinds = own.schema.types
            found, counts, first, held = [], [], 0, 0
            for i in range(len(column)):
                text = column[i].as_py()
                parts = [seen.coded(r) for r in runs_of(text)] if text else []
                found += parts
                counts.append(sum(map(len, parts)))
                held += counts[-1]
                size += len(text or "")
                if size >= chunk or held >= BLOCK or i == len(column) - 1:
                    yield block(own.slice(first, i + 1 - first), found, counts)
                    placed += i + 1 - first
                    found, counts, first, held = [], [], i + 1, 0
                if size >= chunk:
                    yield from dictionary()
                    seen, size, placed, k = Words(source), 0, 0, k + 1
        if size:
            yield from dictionary()

    return docs.mapInArrow(split, schema)


def bucketed(rows: DataFrame, name: str, key: str, sort: str, *parts: str) -> DataFrame:
    """rows as a table in the shared folder, in buckets by key: readers that group by key need no shuffle of it. Its
    name, tm_<name>_<random>, stays in the session's catalog."""
    spark = rows.sparkSession
    path = new_folder(spark, name)
    table = "tm_" + path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").option("path", path).option("compression", "zstd").partitionBy(*parts).bucketBy(n, key).sortBy(sort).saveAsTable(table)
    return spark.table(table)


def encoded_slots(slots: DataFrame, source: str) -> DataFrame:
    """(chunk, ids) of rows (chunk, slot, words): the places of each chunk's words of a slot, how many ids each has, and the ids, packed. All equal
    words are in one slot, where each distinct one is encoded once."""

    def encode(slot: pa.Table) -> pa.Table:
        tables = _read(slot["words"])
        words = pa.concat_tables(tables)
        coded = pa.concat_arrays(words["word"].chunks).dictionary_encode()
        found = [e.ids for e in tokenizer_of(source).encode_batch(coded.dictionary.to_pylist(), add_special_tokens=False)]
        ids, places, which = pa.array(found, pa.list_(pa.int32())), words["place"].to_numpy(), coded.indices.to_numpy()
        blobs, a = [], 0
        for t in tables:
            order = a + np.argsort(places[a : a + len(t)])
            own = ids.take(pa.array(which[order]))
            blobs.append(_packed(np.diff(places[order], prepend=0), pc.list_value_length(own).to_numpy(zero_copy_only=False), own.flatten().to_numpy(zero_copy_only=False)))
            a += len(t)
        return pa.table({"chunk": slot["chunk"], "ids": pa.array(blobs, pa.binary())})

    return slots.groupBy("slot").applyInArrow(encode, "chunk bigint, ids binary")


def _pieces_of(ids: np.ndarray, source: str) -> pa.Array:
    """The pieces of ids, in order, by a join with the vocabulary."""
    each = pa.table({"id": pa.array(ids, pa.int32()), "at": pa.array(np.arange(len(ids)))})
    return pa.concat_arrays(each.join(vocabulary(source), "id").sort_by("at")["piece"].chunks or [pa.array([], pa.binary())]).fill_null(b"")


def _chunk_texts(docs: DataFrame, source: str, text_col: str, chunk: int, text: bool) -> DataFrame:
    others = [c for c in docs.columns if c not in (text_col, "ids")]
    # Slots grow with the cluster's partitions, so that a slot's words fit in a task.
    slots = max(SLOTS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = bucketed(chunked(docs.select(*others, text_col), source, text_col, slots, chunk), "chunks", "__tm_chunk", "__tm_place", "__tm_text")
    listed = both.where("not __tm_text").select(F.col("__tm_chunk").alias("chunk"), F.col("__tm_place").alias("slot"), F.col("__tm_words").alias("words"))
    spelled = encoded_slots(listed, source)
    texts = both.where("__tm_text").select("__tm_chunk", "__tm_place", *others, "__tm_n", "__tm_codes")
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), "ids array<int>", *([f"`{text_col}` string"] if text else [])])

    def put_back(texts: pa.Table, words: pa.Table) -> pa.Table:
        texts = texts.sort_by("__tm_place").combine_chunks()
        told = [_unpacked(x) for x in words["ids"].to_pylist()]
        joined = [np.concatenate(x) for x in zip(*((np.cumsum(places), counts, ids) for places, counts, ids in told))] or [np.zeros(0, np.int64)] * 3
        order, counts, ids_ = np.argsort(joined[0]), joined[1], joined[2].astype(np.int32)
        starts, counts_of = (np.cumsum(counts) - counts)[order], counts[order]
        if text:
            spelling = pa.array(_cut(_pieces_of(ids_, source), np.concatenate([[0], np.cumsum(counts)])), pa.binary()).take(pa.array(order))
        n_words, packed = texts["__tm_n"].to_numpy(), texts["__tm_codes"].to_pylist()
        out, a = [], 0
        for b in [i + 1 for i, x in enumerate(packed) if x is not None]:  # the blocks
            ends = np.concatenate([[0], np.cumsum(n_words[a:b])])
            codes = _unpacked(packed[b - 1])[0]
            size = counts_of[codes]
            at = np.concatenate([[0], np.cumsum(size)])
            ids = ids_[np.arange(at[-1]) + np.repeat(starts[codes] - at[:-1], size)]
            columns = [pa.ListArray.from_arrays(pa.array(at[ends], pa.int32()), pa.array(ids, pa.int32()))]
            if text:
                columns.append(pa.array([x.decode("utf-8", "replace") for x in _cut(spelling.take(pa.array(codes)), ends)], pa.string()))
            out.append(pa.Table.from_arrays([*(texts[c].slice(a, b - a) for c in others), *columns], names=[*others, "ids", *([text_col] if text else [])]))
            a = b
        return pa.concat_tables(out)

    return texts.groupBy("__tm_chunk").cogroup(spelled.groupBy("chunk")).applyInArrow(put_back, schema)


def encode(docs: DataFrame, source: str, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with ids (array<int>) in place of the text.

    A null or empty text has no ids. Texts that spell an added token hold its id, as in the library. Rows are never
    compared, so repeated ids and texts stay as they are; a column named ids is replaced.
    """
    return _chunk_texts(docs, source, text_col, chunk, False)


def encode_decode(docs: DataFrame, source: str, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with ids, and with the text that they decode to in place of the text: encode and decode in one pass over the words."""
    return _chunk_texts(docs, source, text_col, chunk, True)


@cache
def _byte_of() -> dict[str, int]:
    """The byte that each letter of byte-level pieces stands for: printable bytes for themselves, the others, in order, for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def vocabulary(source: str) -> pa.Table:
    """(id, piece): each id's bytes. One row an id of the vocabulary, which bounds what is sent."""
    t, byte_of = tokenizer_of(source), _byte_of()
    rows = [(i, bytes(byte_of[c] for c in p) if all(c in byte_of for c in p) else p.encode()) for p, i in t.get_vocab(with_added_tokens=True).items()]
    return pa.table({"id": pa.array([i for i, _ in rows], pa.int32()), "piece": pa.array([p for _, p in rows], pa.binary())})


def pieces(spark: SparkSession, source: str) -> DataFrame:
    return spark.createDataFrame(vocabulary(source))


def _cut(pieces: pa.Array, ends: np.ndarray) -> list[bytes]:
    """The bytes between places of a binary array, laid end to end."""
    if not len(pieces):
        return [b""] * (len(ends) - 1)
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1][ends].tolist()
    data = memoryview(pieces.buffers()[2]) if pieces.buffers()[2] is not None else memoryview(b"")
    return [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])]


def with_bytes(rows: DataFrame, source: str, name: str, ids: str = "ids") -> DataFrame:
    """rows with the bytes (binary) that their ids stand for.

    Each id is a row of its own that meets its piece in a broadcast join; the ids of a row stay together and in order, as nothing is
    shuffled, and its pieces are laid end to end again (a row whose ids came out of order would stop the job). Null and
    empty ids give no bytes, ids without a piece add none. A column of that name is replaced.
    """
    others = [c for c in rows.columns if c != name]
    each = rows.select(F.struct(*others).alias("__tm_row"), F.posexplode_outer(F.when(F.size(ids) > 0, F.col(ids))).alias("at", "id"))
    # The columns of a row go with its first id only.
    first = F.col("at").isNull() | (F.col("at") == 0)
    each = each.select(F.when(first, F.col("__tm_row")).alias("__tm_row"), first.alias("first"), "at", "id")
    joined = each.join(F.broadcast(pieces(rows.sparkSession, source)), "id", "left").select("__tm_row", "first", "at", "piece")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), f"`{name}` binary"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, parts, next_at = None, [], 0  # the row whose pieces are still coming

        def finished(rows: pa.Array, found: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pc.struct_field(rows, i) for i in range(len(others))), pa.array(found, pa.binary())], names=[*others, name])

        for batch in batches:
            starts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
            at = batch.column("at").fill_null(0).to_numpy()
            want = np.arange(len(at)) - np.repeat(np.concatenate([[-next_at], starts]), np.diff(np.concatenate([[0], starts, [len(at)]])))
            if not np.array_equal(at, want):
                raise ValueError("the ids of a row came out of order")
            found = _cut(batch.column("piece").fill_null(b""), np.concatenate([[0], starts, [len(at)]]))
            parts.append(found[0])
            if len(starts):
                if row is not None:
                    yield finished(row, [b"".join(parts)])
                if len(starts) > 1:
                    yield finished(batch.column("__tm_row").take(pa.array(starts[:-1])), found[1:-1])
                row, parts = batch.column("__tm_row").take(pa.array(starts[-1:])), [found[-1]]
            next_at = int(at[-1]) + 1 if len(at) else next_at
        if row is not None:
            yield finished(row, [b"".join(parts)])

    return joined.mapInArrow(lay, schema)


def decode(rows: DataFrame, source: str, text_col: str = "text", ids: str = "ids") -> DataFrame:
    """rows with the text that their ids decode to, in place of the ids; bytes that are no UTF-8 become U+FFFD, null and empty ids the empty
    text, and a column named like the text is replaced."""
    kept = [c for c in rows.columns if c != text_col]
    laid = with_bytes(rows.select(*kept), source, "__tm_bytes", ids).drop(ids)
    others = [c for c in kept if c != ids]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [x.decode("utf-8", "replace") for x in batch.column("__tm_bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(plain, pa.string())], names=[*others, text_col])

    return laid.mapInArrow(spell, ", ".join([*(f"`{c}` {types[c]}" for c in others), f"`{text_col}` string"]))
