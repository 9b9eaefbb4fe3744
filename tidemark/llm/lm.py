"""Trigram language model in Elias-Fano tries, built and queried in shards.

Model: p(w | u v) = (c(uvw) + PAIR c(vw) + BASE p(w)) / (c(uv) + PAIR c(v) + BASE) with p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)):
a proper distribution over the V training tokens and one for all unknown ones, by one rule at every size. The
logarithm is a sum of a term of (w; v, u), and one of (v; u), so the shards of w and v score a token.

Trie: level one holds the shard's words as a monotone sequence of 64-bit hashes, level two the contexts v seen before each
word, level three the contexts u seen before each of those. Elias-Fano splits numbers: high parts in unary, low parts in
packed bits. In levels two and three the high part of an entry is its parent's index, so the unary bits are the monotone pointers to each
parent's children; a query selects them by sampled counts of zeros and searches the successor of a context among the children of its parent
only. Log probabilities are smoothed, then quantised to 16 bits. A trie is one flat buffer, queried in place where it is mapped.

Flow: one pass counts words for N, V and the frequent words; a second cuts documents into chunks and sends
each token to the shard of its word (very frequent words are dealt by word and context, with their counts known to
all), where training tokens build the trie and all tokens query it; partial sums return by chunk. In messages a context is a
frequent word's number, or else its whole hash, so no two contexts are ever one.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import grouped, mixed, spaced, words_of

PAIR, BASE, SHARD_BYTES, CHUNK_TOKENS = 0.01, 8.0, 12 << 20, 1 << 20
EARLIER, START, END = (mixed(np.array([i], np.uint64))[0] for i in (1, 2, 3))
MIX, ESCAPE = np.uint64(0x9E3779B97F4A7C15), (1 << 24) - 1


class Packed:
    """Numbers of `width` <= 56 bits each, back to back, read in place."""

    def __init__(self, buffer: np.ndarray, width: int):
        self.buffer, self.width, self.mask = buffer, width, np.uint64((1 << width) - 1)

    @staticmethod
    def encode(x: np.ndarray, width: int) -> bytes:
        out = []
        for i in range(0, len(x), 1 << 14):
            bits = np.unpackbits(x[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out.append(np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes())
        return b"".join(out) + bytes(8)

    @staticmethod
    def size(n: int, width: int) -> int:
        return (n * width + 7) // 8 + 8

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        eight = self.buffer[(bit >> 3)[:, None] + np.arange(8)].view("<u8")[:, 0]
        return eight >> (bit & 7).astype(np.uint64) & self.mask


#: Where the k-th zero of a byte is.
ZERO_AT = np.array([([i for i in range(8) if not b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """A monotone sequence of (high, low): unary high parts with a count of ones before each 512 bits, packed low parts."""

    def __init__(self, buffer: memoryview):
        self.n, width, words, self.n_zeros = np.frombuffer(buffer, np.int64, 4).tolist()
        at = 32
        self.low = Packed(np.frombuffer(buffer, np.uint8, Packed.size(self.n, width), at), width)
        at += -(-Packed.size(self.n, width) // 8) * 8
        self.high = np.frombuffer(buffer, "<u8", words, at)
        at += 8 * words
        self.zeros_before = np.frombuffer(buffer, np.int64, words // 8 + 1, at)
        self.size = at + 8 * (words // 8 + 1)

    @staticmethod
    def encode(high: np.ndarray, low: np.ndarray, width: int) -> bytes:
        """high: non-decreasing; low: numbers of `width` bits, rising where high is equal."""
        n, top = len(high), int(high[-1]) + 1 if len(high) else 0
        words = -(-(n + top) // 512) * 8
        bits = np.zeros(words * 64, np.uint8)
        bits[high.astype(np.int64) + np.arange(n)] = 1
        bits[n + top :] = 1
        packed = np.packbits(bits, bitorder="little")
        zeros = np.concatenate([[0], np.cumsum(512 - np.bitwise_count(packed.reshape(-1, 64)).sum(axis=1, dtype=np.int64))])
        body = Packed.encode(low, width)
        return np.array([n, width, words, top], np.int64).tobytes() + body + bytes(-len(body) % 8) + packed.tobytes() + zeros.astype(np.int64).tobytes()

    @classmethod
    def of(cls, values: np.ndarray) -> bytes:
        """Any sorted 64-bit numbers, with about one high part an entry."""
        width = min(56, 64 - max(len(values), 1).bit_length())
        return cls.encode(values >> np.uint64(width), values & np.uint64((1 << width) - 1), width)

    def select_zero(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th zero of the unary part."""
        block = np.searchsorted(self.zeros_before, k, side="right") - 1
        left, rows = k - self.zeros_before[block], np.arange(len(k))
        words = self.high[(8 * block)[:, None] + np.arange(8)]
        sums = np.cumsum(64 - np.bitwise_count(words).astype(np.int64), axis=1)
        word = (sums <= left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, sums[rows, word - 1], 0)
        eight = np.ascontiguousarray(words[rows, word]).view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(8 - np.bitwise_count(eight).astype(np.int64), axis=1)
        byte = (sums <= left[:, None]).sum(axis=1)
        left = left - np.where(byte > 0, sums[rows, byte - 1], 0)
        return 512 * block + 64 * word + 8 * byte + ZERO_AT[eight[rows, byte], left]

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of each (high, low), -1 where it isn't there: successor search among the entries of that high part."""
        if not self.n or not len(high):
            return np.full(len(high), -1)
        h = np.minimum(high.astype(np.int64), self.n_zeros - 1)
        lo = np.where(h > 0, self.select_zero(np.maximum(h - 1, 0)) - (h - 1), 0)
        stop = np.where(high.astype(np.int64) < self.n_zeros, self.select_zero(h) - h, lo)
        hi = stop.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self.low[mid] < low[todo]
            lo[todo], hi[todo] = np.where(less, mid + 1, lo[todo]), np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        at = np.minimum(lo, self.n - 1)
        return np.where((lo < stop) & (self.low[at] == low), at, -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(16-bit codes, lowest, step): even steps between the extremes."""
    low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (high - low) / 65535 or 1.0
    return np.rint((x - low) / step).astype(np.uint16), low, step


class Frequent:
    """The frequent words with their counts. Their numbers, from two on, stand for them in messages; 0 and 1 are the two start marks."""

    def __init__(self, words: list[int], counts: list[int]):
        order = np.argsort(np.array(words, np.uint64))
        self.words, self.counts = np.array(words, np.uint64)[order], np.array(counts, np.int64)[order]

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Where each word is in the list, -1 for others."""
        if not len(self.words):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, at, -1)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = self.place(keys) + 2
        out[out == 1] = ESCAPE
        out[keys == EARLIER], out[keys == START] = 0, 1
        return out


class Trie:
    """Words with counts, pairs and triples, and quantised log10 terms of each."""

    def __init__(self, buffer):
        buffer, at = memoryview(buffer), 0
        levels = []
        for _ in range(3):
            levels.append(EliasFano(buffer[at:]))
            at += levels[-1].size
        self.words, self.pairs, self.triples = levels
        scales = np.frombuffer(buffer, np.float64, 10, at).reshape(5, 2)
        self.counts = np.frombuffer(buffer, np.int64, self.words.n, at + 80)
        at += 80 + 8 * self.words.n
        self.terms = []
        for n, (low, step) in zip((self.triples.n, self.pairs.n, self.pairs.n, self.words.n, self.words.n), scales.tolist()):
            self.terms.append((np.frombuffer(buffer, np.uint16, n, at), low, step))
            at += 2 * n

    def term(self, which: int, at: np.ndarray) -> np.ndarray:
        codes, low, step = self.terms[which]
        return low + step * codes[at]

    @staticmethod
    def build(word: np.ndarray, count: np.ndarray, pair_owner: np.ndarray, pair: np.ndarray, pair_count: np.ndarray, triple_owner: np.ndarray, triple: np.ndarray, triple_count: np.ndarray, n_all: float, n_types: float, width: int) -> bytes:
        """word: sorted hashes with their counts; pair and triple: sorted contexts of their owners (indices of words and pairs), with counts."""
        p = BASE * (count + 0.5) / (n_all + 0.5 * (n_types + 1))
        of_pair = PAIR * pair_count + p[pair_owner]
        terms = (triple_count + of_pair[triple_owner], of_pair, pair_count + PAIR * count[pair_owner] + BASE, p, PAIR * count + BASE)
        coded = [quantise(np.log10(x)) for x in terms]
        return (
            EliasFano.of(word) + EliasFano.encode(pair_owner, pair, width) + EliasFano.encode(triple_owner, triple, width)
            + np.array([c[1:] for c in coded], np.float64).tobytes() + count.astype(np.int64).tobytes() + b"".join(c[0].tobytes() for c in coded)
        )

    def find_words(self, word: np.ndarray) -> np.ndarray:
        shift = np.uint64(self.words.low.width)
        return self.words.find(word >> shift, word & self.words.low.mask)

    def scores(self, owner: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of c(uvw) + PAIR c(vw) + BASE p(w), and of c(vw) + PAIR c(w) + BASE, for words known to the trie."""
        num, den = self.term(3, owner), self.term(4, owner)
        at = self.pairs.find(owner.astype(np.uint64), v)
        seen = np.flatnonzero(at >= 0)
        if len(seen):
            num[seen], den[seen] = self.term(1, at[seen]), self.term(2, at[seen])
            deep = self.triples.find(at[seen].astype(np.uint64), u[seen])
            known = np.flatnonzero(deep >= 0)
            num[seen[known]] = self.term(0, deep[known])
        return num, den


def opened(buffer: bytes) -> Trie:
    """The trie in a mapping of its own, from which all levels are read in place."""
    mapped = mmap.mmap(-1, max(len(buffer), 1))
    mapped.write(buffer)
    return Trie(mapped)


def shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so sorted words are sorted by shard."""
    return ((x >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _count(docs: DataFrame, shards: int, least: int) -> tuple[int, int, Frequent]:
    """(N, V, words with over `least` training tokens). Only these reach the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def packed():
            keys, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(index, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
            own = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            small = n.max() < 1 << 31
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([_binary(keys[cuts[s] : cuts[s + 1]]) for s in own], pa.binary()), pa.array([_binary(n[cuts[s] : cuts[s + 1]].astype(np.int32 if small else np.int64)) for s in own], pa.binary())], names=["shard", "keys", "n"])

        for b in batches:
            for _, part in grouped(b.column(0).to_pylist()):
                tokens = np.append(words_of(part, spaced()).hash, np.full(len(part), END))
                parts.append((tokens, np.ones(len(tokens)))), (held := held + len(tokens))
                if held > 1 << 20:
                    keys, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    parts = [(keys, np.bincount(index, weights=np.concatenate([p[1] for p in parts])))]
                    held = len(keys)
                    if held > 1 << 19:
                        yield packed()
                        parts, held = [], 0
        if parts:
            yield packed()

    def merge(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int32 if 2 * len(x) == len(k) else np.int64) for x, k in zip(rows["n"].to_pylist(), rows["keys"].to_pylist())])
        keys, index = np.unique(keys, return_inverse=True)
        n = np.bincount(index, weights=n).astype(np.int64)
        top = n > least
        return pa.table({"types": [len(keys)], "tokens": [int(n.sum())], "words": pa.array([keys[top].view(np.int64)], pa.list_(pa.int64())), "counts": pa.array([n[top]], pa.list_(pa.int64()))})

    counted = docs.select("text").mapInArrow(local, "shard int, keys binary, n binary").groupBy("shard").applyInArrow(merge, "types long, tokens long, words array<long>, counts array<long>")
    rows = counted.collect()
    known = [(int(np.int64(w).view(np.uint64)), c) for r in rows for w, c in zip(r.words, r.counts)]
    return sum(r.tokens for r in rows), sum(r.types for r in rows), Frequent([w for w, _ in known], [c for _, c in known])


REQUEST = "shard int, chunk long, words binary, sizes binary, v binary, v_rare binary, u binary, u_rare binary, docs binary, train binary, ids array<{id}>, held array<boolean>, lengths array<long>"
ANSWER = "chunk long, docs binary, nums binary, base binary, known binary, ids array<{id}>, held array<boolean>, lengths array<long>"
RESULT = "{id_col} {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _contexts(x: np.ndarray, frequent: Frequent) -> tuple[bytes, bytes]:
    """Three bytes for each context, and the hashes of those without a number."""
    numbers = frequent.numbers(x)
    return _binary(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]), _binary(x[numbers == ESCAPE])


def _requests(shared, least_hot: int, shards: int, chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, number = shared.value, TaskContext.get().partitionId() << 24
        hot, kind = frequent.words[frequent.counts > least_hot], None
        ids, held, tokens, n = [], [], [], 0

        def packed():
            lengths = np.array([len(t) for t in tokens])
            w = np.concatenate(tokens)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            v = np.concatenate([[START], w[:-1]])
            v[first] = START
            u = np.concatenate([[EARLIER], v[:-1]])
            u[first] = EARLIER
            doc = np.repeat(np.arange(len(tokens), dtype=np.uint32), lengths)
            train = np.packbits(~np.array(held))
            own = shard_of(w, shards)
            spread = np.isin(w, hot)
            own[spread] = shard_of(mixed(w[spread] ^ v[spread] * MIX), shards)
            order = np.lexsort((v, w, own))
            w, v, u, doc, own = w[order], v[order], u[order], doc[order], own[order]
            cuts, rows = np.searchsorted(own, np.arange(shards + 1)), []
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[s], cuts[s + 1])
                sw = w[part]
                at = np.flatnonzero(np.concatenate([[True], sw[1:] != sw[:-1]]))
                sizes = np.diff(np.append(at, len(sw))).astype(np.uint32)
                narrow = doc[part].astype(np.uint16 if len(tokens) <= 1 << 16 else np.uint32)
                rows.append((s, number, _binary(sw[at]), _binary(sizes), *_contexts(v[part], frequent), *_contexts(u[part], frequent), _binary(narrow), _binary(train), None, None, None))
            rows.append((number % shards, number, *[None] * 8, ids, held, lengths.tolist()))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 8, pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "chunk", "words", "sizes", "v", "v_rare", "u", "u_rare", "docs", "train", "ids", "held", "lengths"])

        for b in batches:
            kind = b.schema.field(0).type
            some_ids, some_held = b.column(0).to_pylist(), b.column(1).to_pylist()
            for start, part in grouped(b.column(2).to_pylist()):
                found = words_of(part, spaced())
                for i in range(len(part)):
                    t = np.append(found.hash[found.first[i] : found.first[i + 1]], END)
                    ids.append(some_ids[start + i]), held.append(some_held[start + i]), tokens.append(t)
                    n += len(t)
                    if n >= chunk_tokens:
                        yield packed()
                        ids, held, tokens, n, number = [], [], [], 0, number + 1
        if ids:
            yield packed()

    return run


def _answers(n_all: int, n_types: int, shared):
    def run(rows: pa.Table) -> pa.Table:
        # a shard's tokens fill this task's memory, so each column is unpacked alone and chunks are answered one by one
        out, asked = [], [i for i, ok in enumerate(rows["words"].is_valid().to_pylist()) if ok]
        for i in sorted(set(range(len(rows))) - set(asked)):
            out.append((rows["chunk"][i].as_py(), None, None, None, None, *(rows[c][i].as_py() for c in ("ids", "held", "lengths"))))
        if asked:
            get = lambda c, i, kind: np.frombuffer(rows[c][i].as_buffer() or b"", kind)
            frequent = shared.value
            sizes = [get("sizes", i, np.uint32) for i in asked]
            lengths = [int(x.sum()) for x in sizes]
            docs = [get("docs", i, np.uint16 if rows["docs"][i].as_buffer().size == 2 * n else np.uint32) for i, n in zip(asked, lengths)]
            word, index = np.unique(np.concatenate([get("words", i, np.uint64) for i in asked]), return_inverse=True)
            node = np.repeat(index.astype(np.uint32), np.concatenate(sizes))
            rare = np.unique(np.concatenate([get(c, i, np.uint64) for c in ("v_rare", "u_rare") for i in asked]))

            def contexts(c: str) -> np.ndarray:
                """Numbers of the contexts in this shard: those of frequent words, then those of the others."""
                low = np.concatenate([get(c, i, np.uint8) for i in asked]).reshape(-1, 3)
                x = np.zeros((len(low), 4), np.uint8)
                x[:, :3] = low
                x = x.view("<u4")[:, 0]
                hashes = np.concatenate([get(f"{c}_rare", i, np.uint64) for i in asked])
                x[x == ESCAPE] = len(frequent.words) + 2 + np.searchsorted(rare, hashes)
                return x

            v, u = contexts("v"), contexts("u")
            width = max(1, int(len(frequent.words) + 2 + len(rare)).bit_length())
            learn = np.concatenate([np.unpackbits(get("train", i, np.uint8))[d].astype(bool) for i, d in zip(asked, docs)])
            del index, sizes
            counts = np.bincount(node[learn], minlength=len(word)).astype(np.int64)
            place = frequent.place(word)
            counts = np.where(place >= 0, frequent.counts[place] if len(frequent.words) else 0, counts)
            trained = np.flatnonzero(counts > 0)
            renumber = np.zeros(len(word), np.uint64)
            renumber[trained] = np.arange(len(trained))
            pairs, at, pair_count = np.unique(renumber[node[learn]] << np.uint64(32) | v[learn], return_inverse=True, return_counts=True)
            triples, triple_count = np.unique(at.astype(np.uint64) << np.uint64(32) | u[learn], return_counts=True)
            low = np.uint64((1 << 32) - 1)
            trie = opened(Trie.build(word[trained], counts[trained], (pairs >> np.uint64(32)).astype(np.int64), pairs & low, pair_count, (triples >> np.uint64(32)).astype(np.int64), triples & low, triple_count, n_all, n_types, width))
            del pairs, at, pair_count, triples, triple_count, learn, renumber, trained
            found = trie.find_words(word)
            z = n_all + 0.5 * (n_types + 1)
            count = np.where(found >= 0, trie.counts[found] if trie.words.n else 0, 0)
            base = np.log10(count + 0.5)
            ends = np.uint32(np.searchsorted(word, END)) if END in word else None
            start = 0
            for i, d, n in zip(asked, docs, lengths):
                own, seen_v, seen_u = (x[start : start + n] for x in (node, v, u))
                start += n
                at = found[own]
                num, den = np.full(n, np.log10(BASE * 0.5 / z)), np.full(n, np.log10(BASE))
                seen = np.flatnonzero(at >= 0)
                if len(seen):
                    num[seen], den[seen] = trie.scores(at[seen], seen_v[seen].astype(np.uint64), seen_u[seen].astype(np.uint64))
                if ends is not None:
                    den[own == ends] = 0.0
                some, back = np.unique(d, return_inverse=True)
                sums = [np.bincount(back, weights=x) for x in (num - den, base[own], count[own] > 0)]
                out.append((rows["chunk"][i].as_py(), _binary(some), _binary(sums[0]), _binary(sums[1]), _binary(sums[2].astype(np.uint32)), None, None, None))
        kind = rows.schema.field("ids").type
        kinds = [pa.int64(), *[pa.binary()] * 4, kind, pa.list_(pa.bool_()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["chunk", "docs", "nums", "base", "known", "ids", "held", "lengths"])

    return run


def _sums(id_col: str, n_all: int, n_types: int, start_cost: float):
    def run(rows: pa.Table) -> pa.Table:
        parts = rows.to_pylist()
        own = next(r for r in parts if r["ids"] is not None)
        n = len(own["ids"])
        num, base, known = np.zeros(n), np.zeros(n), np.zeros(n)
        for r in parts:
            if r["docs"] is None:
                continue
            size = len(r["base"]) // 8
            d = np.frombuffer(r["docs"], np.uint16 if len(r["docs"]) == 2 * size else np.uint32)
            num[d] += np.frombuffer(r["nums"], np.float64)
            base[d] += np.frombuffer(r["base"], np.float64)
            known[d] += np.frombuffer(r["known"], np.uint32)
        lengths = np.array(own["lengths"])
        z = n_all + 0.5 * (n_types + 1)
        return pa.Table.from_arrays(
            [pa.array(own["ids"], rows.schema.field("ids").type.value_type), pa.array(own["held"]), pa.array(lengths), pa.array(known.astype(np.int64)), pa.array(np.full(n, n_all)), pa.array(base - lengths * np.log10(z)), pa.array(num - start_cost)],
            names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per row of docs (RESULT; extra columns are left out): scored by the model of all rows where held_out is false.

    Null and empty texts have one token, the end. Nothing is left out of the counts: every training token enters N, V, c(w), c(vw) and
    c(uvw), and repeated rows count each time. Without training rows each token is unknown to a model with N = V = 0. A null id is an id.

    Shards grow in number, not in size, with the corpus (shard_bytes of text each). A word that alone would fill a quarter of a
    shard is dealt over all shards by the word before it. Frequent words are those with over a three-millionth of the corpus' bytes as
    their count, so their list is bounded (1.5 million at the very most) and can be broadcast. A pair of words is in one shard however frequent it is: its
    occurrences take eight bytes or so each. There is a message for each chunk and shard that have a token in common, so never more
    than tokens. docs is read three times and must give the same rows each time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    whole = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.when(~F.col("held"), 1)).alias("t")).first()
    shards, n_train = max(4, -(-(whole.b or 0) // shard_bytes)), whole.t or 0
    n_all, n_types, frequent = _count(rows.where("not held"), shards, (whole.b or 0) // 3_000_000)
    start_cost = float(np.log10(n_train + PAIR * n_train + BASE))
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    kind = docs.schema[id_col].dataType.simpleString()
    asked = rows.mapInArrow(_requests(shared, max(1_000, shard_bytes // 24), shards, chunk_tokens), REQUEST.format(id=kind))
    answered = asked.groupBy("shard").applyInArrow(_answers(n_all, n_types, shared), ANSWER.format(id=kind))
    return answered.groupBy("chunk").applyInArrow(_sums(id_col, n_all, n_types, start_cost), RESULT.format(id=kind, id_col=id_col))
