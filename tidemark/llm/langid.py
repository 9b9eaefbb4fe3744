"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of the bytes that followed every context in its training sample: all contexts of up to two bytes, and
those of up to five that occurred four times. The tree is frozen, so the code length of a byte after a context is fixed: a symbol seen n
times in a context with n_all occurrences and d distinct successors costs -log2(n/(n_all+d)); any other costs the escape
-log2(d/(n_all+d)) plus its cost one order lower, at last log2(256). A context that is not in the tree passes straight on to the
next shorter one. Code lengths are exact.

Trees are sorted arrays of (language, bytes from the last backwards), one for each order. A context holds the sum of the escapes down from
it, and a symbol its cost less the sum of its own context, so a byte costs what the longest context and the longest match say. Equal windows
of six bytes are looked up once for many texts. A-Z are lower-cased; five zero bytes stand before a text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import utf8
from tidemark.llm.sampling import smallest_hashes, told_apart

#: The longest context, how often one longer than two bytes must occur, and how many bytes are looked up at once.
ORDER, LEAST, PIECE = 5, 4, 1 << 20


def windows(pieces: list[bytes]) -> np.ndarray:
    """For each byte of each piece but its first ORDER ones, the last ORDER + 1 bytes; the last one counts most."""
    b = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(b) - ORDER
    if n <= 0:
        return np.empty(0, np.uint64)
    w = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        w |= b[ORDER - k : ORDER - k + n].astype(np.uint64) << np.uint64(8 * (ORDER - k))
    ends = np.cumsum([len(x) for x in pieces])[:-1]
    inside = np.ones(n, bool)
    for k in range(1, ORDER + 1):  # windows that reach over the end of a piece
        at = ends - k
        inside[at[(at >= 0) & (at < n)]] = False
    return w[inside]


def of_order(w: np.ndarray, k: int) -> np.ndarray:
    """A byte with its last k ones."""
    return w >> np.uint64(8 * (ORDER - k))


def context(w: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes before a byte."""
    return (w & np.uint64((1 << 8 * ORDER) - 1)) >> np.uint64(8 * (ORDER - k))


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class ByteModel:
    languages: list[str]
    grams: list[np.ndarray]  # for each order, sorted (language << 48 | byte and context)
    costs: list[np.ndarray]  # bits less the escapes down from the context
    contexts: list[np.ndarray]  # for each order, sorted (language << 48 | context)
    escapes: list[np.ndarray]  # bits of the escapes down from each context, its own included

    def bits(self, w: np.ndarray) -> np.ndarray:
        """(window, language): the bits that the last byte of each window costs. w: sorted."""
        out = np.empty((len(w), len(self.languages)))
        for i in range(len(self.languages)):
            own = np.uint64(i << 48)
            cost, escape = np.full(len(w), 8.0), np.zeros(len(w))
            for target, keys, table, values in ((cost, of_order, self.grams, self.costs), (escape, context, self.contexts, self.escapes)):
                left = np.arange(len(w))
                for k in range(ORDER, -1, -1):
                    at = find(table[k], own | keys(w[left], k))
                    hit = at >= 0
                    target[left[hit]] = values[k][at[hit]]
                    left = left[~hit]
            out[:, i] = cost + escape
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): bits of each whole text."""
        total, pieces, owners, n = np.zeros((len(texts), len(self.languages))), [], [], 0

        def add() -> None:
            w, at = np.unique(windows(pieces), return_inverse=True)
            costs, lengths = self.bits(w), [len(x) - ORDER for x in pieces]
            starts = np.cumsum([0, *lengths[:-1]])
            for i in range(len(self.languages)):
                np.add.at(total[:, i], owners, np.add.reduceat(costs[at, i], starts))

        for i, text in enumerate(texts):
            text = bytes(ORDER) + text.lower()
            for lo in range(ORDER, len(text), PIECE):
                pieces.append(text[lo - ORDER : lo + PIECE]), owners.append(i)
                n += len(pieces[-1])
                if n >= PIECE:
                    add()
                    pieces, owners, n = [], [], 0
        if pieces:
            add()
        return total


def count_contexts(sample: DataFrame) -> DataFrame:
    """(lang, k, gram, n): each byte of (lang, text) rows with its last k ones, counted in each partition and summed; without those
    after a context longer than two bytes that occurred less than LEAST times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                by.setdefault(lang, []).append(bytes(ORDER) + text.lower())
            for lang, texts in by.items():
                w, n = np.unique(windows(texts), return_counts=True)
                old = counts.get(lang, (w[:0], n[:0]))
                w, at = np.unique(np.concatenate([old[0], w]), return_inverse=True)
                counts[lang] = w, np.bincount(at, weights=np.concatenate([old[1], n]), minlength=len(w)).astype(np.int64)
        for lang, (w, n) in counts.items():
            for k in range(ORDER + 1):
                grams, at = np.unique(of_order(w, k), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(np.bincount(at, weights=n, minlength=len(grams)).astype(np.int64))], ["lang", "k", "gram", "n"])

    summed = sample.select("lang", "text").mapInArrow(run, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    before = F.expr("gram & (shiftleft(1L, 8 * k) - 1)")
    whole = F.sum("n").over(Window.partitionBy("lang", "k", before))
    return summed.withColumn("whole", whole).where(f"k <= 2 or whole >= {LEAST}").drop("whole")


def combined(models: list[ByteModel]) -> ByteModel | None:
    """One model of the models of one language each; None of none."""
    if not models:
        return None
    models = sorted(models, key=lambda m: m.languages[0])
    join = lambda parts, own: [np.concatenate([x[k] | np.uint64(i << 48) if own else x[k] for i, x in enumerate(parts)]) for k in range(ORDER + 1)]
    return ByteModel([m.languages[0] for m in models], join([m.grams for m in models], True), join([m.costs for m in models], False), join([m.contexts for m in models], True), join([m.escapes for m in models], False))


def built(counts: DataFrame) -> ByteModel | None:
    """The frozen trees of (lang, k, gram, n), each built in a task of its own."""

    def run(rows: pa.Table) -> pa.Table:
        lang = rows["lang"][0].as_py()
        model = build(lang, *(rows[c].to_numpy() for c in ("k", "gram", "n")))
        return pa.table({"lang": pa.array([lang], pa.string()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    return combined([pickle.loads(r.model) for r in counts.groupBy("lang").applyInArrow(run, "lang string, model binary").collect()])


def build(lang: str, k: np.ndarray, gram: np.ndarray, n: np.ndarray) -> ByteModel:
    """The frozen tree of the counts of one language."""
    gram, model = gram.astype(np.uint64), ByteModel([lang], [], [], [], [])
    for order in range(ORDER + 1):
        own = k == order
        key, count = gram[own], n[own].astype(float)
        order_of = np.argsort(key)
        key, count = key[order_of], count[order_of]
        after = key & ~np.uint64(255 << 8 * order)
        contexts, at = np.unique(after, return_inverse=True)
        n_all, d = np.bincount(at, weights=count, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
        escape = -np.log2(d / (n_all + d)) if len(contexts) else np.zeros(0)
        if order:
            escape = escape + model.escapes[-1][find(model.contexts[-1], contexts >> np.uint64(8))]
        model.grams.append(key), model.costs.append((-np.log2(count / (n_all + d)[at]) - escape[at]).astype(np.float32))
        model.contexts.append(contexts), model.escapes.append(escape.astype(np.float32))
    return model


def train(labelled: DataFrame, texts: DataFrame, per_language: int = 1500, id_col: str = "doc_id") -> ByteModel | None:
    """Learns from whole texts of at most `per_language` labelled rows of each language.

    labelled: (id, lang), without texts; rows with a null language are left out. texts: (id, text). The sample is bounded by `per_language`
    times the number of languages; each language's tree is built in a task, and only the trees reach the driver, of contexts that pass the rule above (some hundred thousand a
    language, twelve bytes each in the model). Ids that
    are repeated in either table are left out of it.
    """
    ids = told_apart(smallest_hashes(labelled.where("lang is not null"), per_language, by="lang", id_col=id_col), texts, id_col)
    sample = texts.select(id_col, "text").join(F.broadcast(ids.select(id_col, "lang")), id_col)
    return built(count_contexts(sample))


def predict(docs: DataFrame, model: ByteModel | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the share of the language in the posterior under equal priors.

    `und` with score 0 where the text is null or has no letter, or where nothing could be learned. Ties go
    to the language that sorts first. Columns of those names in docs are replaced; other columns pass.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            known = [i for i, letter in enumerate(b.column(at + 1).to_pylist()) if letter] if m is not None else []
            for i, bits in zip(known, m.code_lengths(utf8(b.column(at).take(pa.array(known, pa.int64())))) if known else ()):
                best = int(bits.argmin())
                langs[i], scores[i] = m.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*keep, F.col(text_col).alias("__tm_text"), letter.alias("__tm_letter")).mapInArrow(run, schema)
