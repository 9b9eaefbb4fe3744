"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased, so punctuation, case and white space don't hide a
passage. Shingles of five words weigh their length in characters; an item or text of fewer words has one shingle, its
whole sequence. For an item of m shingles, each window of m shingles of a text is compared; item and window match at a
weighted Jaccard similarity of 0.8 or more (multisets: sum of smaller counts over sum of larger counts, times weights).

Windows are only fingerprinted where they can match: at similarity t, shingles that no item holds can have
at most 1 - t of a window's weight, and an item that matches shares a shingle with the text. Fingerprints are found through eight
blocks of eight bits: two fingerprints at most 8(e + 1) - 1 bits apart agree within e bits in some block. Candidates are verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.simhash import BYTE_BITS
from tidemark.llm.tokens import alphanumeric, grouped, shingles_of, words_of

SHINGLE, SPAN, ITEMS_AT_ONCE = 5, 1 << 15, 50_000
HITS = "array<struct<item_id:{id},similarity:double,start:int,n_words:int>>"


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """(n, 64) of +1 and -1."""
    b = BYTE_BITS[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)].reshape(-1, 64)
    return 2 * b - 1


def pack(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8")[:, 0]


class ItemIndex:
    """Benchmark items by fingerprint. Wordless items have no shingle and can't be held by a text."""

    def __init__(self, items: list[tuple[object, str]], block_errors: int = 2):
        self.ids, self.n_words, sizes, totals, fps, hashes, weights = [], [], [], [], [], [], []
        self.radius = 8 * (block_errors + 1) - 1
        for start, part in grouped([t for _, t in items]):
            w = words_of(part, alphanumeric())
            h, size, first = shingles_of(w, SHINGLE)
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                if a < b:
                    self.ids.append(items[start + i][0]), self.n_words.append(int(w.first[i + 1] - w.first[i]))
                    own = size[a:b].astype(float)
                    sizes.append(b - a), totals.append(float(own.sum())), hashes.append(h[a:b]), weights.append(own)
                    fps.append(pack((bits_of(h[a:b]) * own[:, None]).sum(0, keepdims=True))[0])
        self.sizes, self.totals, self.fps = np.array(sizes, np.int64), np.array(totals), np.array(fps, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.flat = np.concatenate([np.empty(0, np.uint64), *hashes])
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(self.flat, kind="stable")
        self.every, self.every_at = np.unique(self.flat[order], return_index=True)
        self.every_at, self.every_owner = np.append(self.every_at, len(order)), owner[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.every >> np.uint64(44)).astype(np.int64)] = True
        self.near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= block_errors

    def known(self, h: np.ndarray) -> np.ndarray:
        """Where each shingle is among those of all items, -1 for others."""
        out = np.full(len(h), -1)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if len(at):
            found = np.minimum(np.searchsorted(self.every, h[at]), len(self.every) - 1)
            out[at] = np.where(self.every[found] == h[at], found, -1)
        return out

    def within(self, own: np.ndarray, fp: np.uint64) -> np.ndarray:
        """Those of the items whose fingerprint is within the radius: block candidates, then all bits."""
        blocks = self.fps[own].view(np.uint8).reshape(-1, 8)
        own = own[self.near[blocks, np.frombuffer(fp.tobytes(), np.uint8)].any(axis=1)]
        return own[np.bitwise_count(self.fps[own] ^ fp) <= self.radius]

    def matches(self, texts: list[str | None], least: float = 0.8) -> list[list[tuple[object, float, int, int]]]:
        """For each text (item id, similarity, first word, words) of the best window for each item that matches."""
        out: list[list] = [[] for _ in texts]
        if not len(self.every):
            return out
        for start, part in grouped(texts):
            h, w, first = shingles_of(words_of(part, alphanumeric()), SHINGLE)
            known = self.known(h)
            for i in np.unique(np.searchsorted(first, np.flatnonzero(known >= 0), side="right") - 1).tolist():
                a, b = first[i], first[i + 1]
                out[start + i] = self._text(h[a:b], w[a:b].astype(float), known[a:b], least)
        return out

    def _text(self, h: np.ndarray, w: np.ndarray, known: np.ndarray, least: float) -> list[tuple[object, float, int, int]]:
        shared = np.unique(known[known >= 0])
        asked = np.unique(np.concatenate([self.every_owner[self.every_at[k] : self.every_at[k + 1]] for k in shared.tolist()]))
        all_w, known_w = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * (known >= 0))])
        best: dict[int, tuple[float, int]] = {}
        for m in np.unique(self.sizes[asked]).tolist():
            n, own = min(m, len(h)), asked[self.sizes[asked] == m]
            starts = np.flatnonzero(known_w[n:] - known_w[:-n] >= least * (all_w[n:] - all_w[:-n]) - 1e-9)
            while len(starts):
                now = starts[starts < starts[0] + SPAN]
                starts = starts[len(now) :]
                self._windows(h, w, n, own, now, least, best)
        return [(self.ids[i], s, at, self.n_words[i]) for i, (s, at) in sorted(best.items())]

    def _windows(self, h, w, n, own, starts, least, best) -> None:
        lo, hi = starts[0], starts[-1] + n
        votes = np.concatenate([np.zeros((1, 64)), np.cumsum(bits_of(h[lo:hi]) * w[lo:hi, None], axis=0)])
        fps = pack(votes[starts - lo + n] - votes[starts - lo])
        seen: set = set()
        for at, fp in zip(starts.tolist(), fps):
            window = h[at : at + n]
            key = window.tobytes()
            if key in seen:
                continue
            seen.add(key)
            for i in self.within(own, fp).tolist():
                weight = dict(zip(window.tolist(), w[at : at + n].tolist()))
                mine, item = Counter(window.tolist()), Counter(self.flat[self.first[i] : self.first[i + 1]].tolist())
                both = sum(min(c, item[x]) * weight[x] for x, c in mine.items() if x in item)
                total = sum(c * weight[x] for x, c in mine.items()) + self.totals[i] - both
                s = both / total if total else 0.0
                if s >= least and s > best.get(i, (0.0, 0))[0]:
                    best[i] = (float(s), at)


def with_hits(docs: DataFrame, items: DataFrame, least: float = 0.8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with a column hits: one struct for each item that a window of the whole text matches.

    Items are the stated query set: they go through in blocks of 50,000, each indexed and sent to the
    executors, against all texts; nothing is shuffled. Null, empty and wordless texts and items have no hits. An item
    of fewer than five words hits the texts that hold these words and no others. Items with equal texts or ids each hit, rows of docs that
    are repeated each get their hits, a text longer than a million characters is hashed piece by piece. A column named hits in docs is replaced.
    """
    n = items.count()
    blocks = max(1, -(-n // ITEMS_AT_ONCE))
    kind = HITS.format(id=items.schema[item_id].dataType.simpleString())
    out = docs.drop("hits").withColumn("hits", F.array().cast(kind))
    part = F.pmod(F.xxhash64(F.col(item_id).cast("string"), F.col(item_text)), F.lit(blocks))
    for k in range(blocks):
        rows = [(r[0], r[1]) for r in items.where(part == k).select(item_id, item_text).collect()]
        out = _one_block(out, docs.sparkSession.sparkContext.broadcast(ItemIndex(rows)), least, text_col)
    return out


def _one_block(docs: DataFrame, index, least: float, text_col: str) -> DataFrame:
    schema: StructType = docs.schema
    text, at = docs.columns.index(text_col), docs.columns.index("hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, kind = b.column(at).to_pylist(), b.schema.field(at).type
            found = index.value.matches(b.column(text).to_pylist(), least)
            new = [h + [dict(zip(("item_id", "similarity", "start", "n_words"), m)) for m in f] for h, f in zip(old, found)]
            yield pa.RecordBatch.from_arrays([pa.array(new, kind) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, schema)
