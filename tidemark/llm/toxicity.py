"""Toxicity scores from a lexicon trie intersected with Levenshtein automata.

The lexicon is learned: words and word stems (prefixes, written `stem*`) that stand out in texts labelled
toxic. Its trie is intersected with the Levenshtein automaton of each token; the product is built lazily as
one deterministic automaton, shared by all tokens, whose states hold (trie node, edits so far). So a token
costs a table look-up a letter, however large the lexicon is. Misspellings (one edit) match whole words of
five letters or more.

Each match is weighed in its context: a window of tokens around it tells quoted use (quotation marks on both sides, or a word
that reports speech before it) from abuse, and a dense window counts more than a lone word. Reporting words are learned: they stand before
terms mostly in texts that are not labelled toxic. A logistic model over these features gives the score. Three quarters of the labelled
rows give the lexicon, the others the reporting words and the weights.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sampling import smallest_hashes, told_apart

TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
QUOTES = frozenset("\"“”„«»")
STEMS = range(4, 9)
WINDOW = 12
FUZZY_LENGTH = 5
FEATURES = ("abuse", "quoted", "fuzzy", "kinds", "density", "dense_window")


class State:
    """A state of the product automaton: (trie node, edits) pairs without dominated ones, and a stem already passed."""

    __slots__ = ("pairs", "stem", "next", "hit")

    def __init__(self, pairs: frozenset, stem: str | None, lexicon: Lexicon):
        self.pairs, self.stem, self.next = pairs, stem, {}
        best = None
        for node, edits in pairs:
            term = lexicon.word_at[node]
            if term is not None and (edits == 0 or len(term) >= FUZZY_LENGTH) and (best is None or (edits, term) < best):
                best = (edits, term)
        exact = best if best and best[0] == 0 else None
        self.hit = exact or ((0, stem) if stem else best)


class Lexicon:
    """A trie of words and stems with weights, and the automaton over it. match() returns (edits, term) or None."""

    def __init__(self, weights: dict[str, float], edits: int = 1):
        self.weights, self.edits = weights, edits
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[str | None] = [None]
        self.stem_at: list[str | None] = [None]
        for term in sorted(weights):
            node = 0
            for ch in term.rstrip("*"):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({}), self.word_at.append(None), self.stem_at.append(None)
                node = self.children[node][ch]
            (self.stem_at if term.endswith("*") else self.word_at)[node] = term
        self.states: dict = {}
        self.start = self._state({(0, 0)}, None)

    def _state(self, pairs: set, stem: str | None) -> State:
        todo = list(pairs)
        while todo:  # a letter of the lexicon that the token lacks
            node, e = todo.pop()
            if e < self.edits:
                for child in self.children[node].values():
                    if (child, e + 1) not in pairs:
                        pairs.add((child, e + 1)), todo.append((child, e + 1))
        kept = frozenset(p for p in pairs if not any((p[0], e) in pairs for e in range(p[1])))
        key = (kept, stem)
        if key not in self.states:
            self.states[key] = State(kept, stem, self)
        return self.states[key]

    def step(self, state: State, ch: str) -> State:
        pairs, stem = set(), state.stem
        for node, e in state.pairs:
            child = self.children[node].get(ch)
            if child is not None:
                pairs.add((child, e))
                if e == 0 and stem is None:
                    stem = self.stem_at[child]
            if e < self.edits:
                pairs.add((node, e + 1))
                pairs.update((other, e + 1) for c, other in self.children[node].items() if c != ch)
        state.next[ch] = out = self._state(pairs, stem)
        return out

    def match(self, token: str) -> tuple[int, str] | None:
        state = self.start
        for ch in token:
            state = state.next.get(ch) or self.step(state, ch)
            if not state.pairs and state.stem is None:
                return None
        return state.hit

    def __getstate__(self):
        return self.weights, self.edits

    def __setstate__(self, kept):
        self.__init__(*kept)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    reporting: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))

    def matches(self, text: str, known: dict) -> tuple[int, list, list, list]:
        """(tokens, matches as (place, edits, term), places of quotation marks, places of reporting words)."""
        n, hits, marks, reports, match = 0, [], [], [], self.lexicon.match
        for token in TOKEN.findall(text.lower()):
            if token in QUOTES:
                marks.append(n + 0.5)
                continue
            n += 1
            hit = known.get(token, 0)
            if hit == 0:
                hit = known[token] = match(token)
            if hit is not None:
                hits.append((n, *hit))
            elif token in self.reporting:
                reports.append(n)
        return n, hits, marks, reports

    def features(self, text: str, known: dict) -> np.ndarray:
        """FEATURES of a whole text. known: matches of tokens seen before; the caller bounds it."""
        abuse = quoted = fuzzy = 0.0
        n, hits, marks, reports = self.matches(text, known)
        at, kinds = [h[0] for h in hits], {h[2] for h in hits}
        for place, edits, term in hits:
            w = self.lexicon.weights[term]
            i, j = bisect_left(marks, place), bisect_left(reports, place)
            before, after = i and place - marks[i - 1] < WINDOW, i < len(marks) and marks[i] - place < WINDOW
            if edits:
                fuzzy += 0.5 * w
            elif before and after or j and place - reports[j - 1] < WINDOW:
                quoted += w
            else:
                abuse += w
        dense = max((sum(1 for b in at[i : i + 50] if b - a < WINDOW) for i, a in enumerate(at)), default=0)
        return np.array([np.log1p(abuse), np.log1p(quoted), np.log1p(fuzzy), np.log1p(len(kinds)), 100 * len(at) / (n + 20), np.log1p(dense)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _terms(text: str) -> set[str]:
    """The distinct words of a text, and their stems."""
    out = set()
    for t in set(TOKEN.findall(text.lower())):
        if len(t) > 2:
            out.add(t)
            out.update(f"{t[:k]}*" for k in STEMS if len(t) > k)
    return out


def _count_terms(sample: DataFrame) -> DataFrame:
    """(term, pos, neg): labelled texts that hold each word or stem, summed over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[1 - y].update(_terms(text or ""))
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[0][t] for t in terms], pa.int64()), pa.array([counts[1][t] for t in terms], pa.int64())], ["term", "pos", "neg"])

    return sample.select("text", "y").mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _choose(rows: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Weights of the terms kept: log odds ratios. A word or longer stem goes where a kept stem covers it at no loss."""
    odds = {t: np.log((p + 0.5) / (n_pos + 1)) - np.log((q + 0.5) / (n_neg + 1)) for t, p, q in rows}
    support = {t: p for t, p, _ in rows}
    kept: dict[str, float] = {}
    for t in sorted(odds, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"))):
        base = t.rstrip("*")
        shorter = [f"{base[:k]}*" for k in STEMS if k < len(base) or k == len(base) and not t.endswith("*")]
        covered = [s for s in shorter if s in kept]
        if covered and odds[t] <= kept[covered[-1]] + 0.7:
            continue
        kept[t] = float(odds[t])
    # a stem that merely abbreviates one word gives way to that word, which can be matched with an edit
    for t in [t for t in kept if t.endswith("*")]:
        whole = [w for w in odds if not w.endswith("*") and w.startswith(t[:-1]) and support[w] >= 0.9 * support[t]]
        if whole:
            w = max(whole, key=lambda w: (support[w], w))
            kept.pop(t)
            kept[w] = float(odds[w])
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(x1.shape[1]), ridge * np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pull)
        d = np.linalg.solve(h, x1.T @ (y - p) - pull * w)
        w = w + np.clip(d, -4, 4)
        if np.abs(d).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame, texts: DataFrame, sample: int = 20_000, min_support: int = 4, min_odds: float = 2.5, id_col: str = "doc_id") -> ToxicityModel:
    """Learns from whole texts of at most `sample` labelled rows: (id, toxic) and (id, text).

    Three quarters of the sample (by hash) give the lexicon, the others the reporting words and the logistic weights, so that these are
    fitted to the lexicon in use, but not to terms that were picked for the same rows. Only terms above min_support and min_odds,
    and features of the sample reach the driver. With no label of either kind the score is the share of label 1 (0 without
    labels). Ids that are repeated in either table are left out.
    """
    ids = told_apart(smallest_hashes(labelled.where("toxic is not null"), sample, id_col=id_col), texts, id_col).select(id_col, F.col("toxic").cast("int").alias("y"))
    rows = texts.select(id_col, "text").join(F.broadcast(ids), id_col).select("text", "y", (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(4)) != 0).alias("most"))
    sizes = {(r.most, r.y): r.n for r in rows.groupBy("most", "y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = (sum(n for (_, y), n in sizes.items() if y == k) for k in (1, 0))
    if not n_pos or not n_neg:
        model = ToxicityModel(Lexicon({}))
        model.weights[-1] = 30.0 if n_pos else -30.0
        return model

    def lexicon(part: DataFrame, pos: int, neg: int) -> Lexicon:
        odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
        best = _count_terms(part).where((F.col("pos") >= min_support) & (odds >= min_odds))
        return Lexicon(_choose([(r.term, r.pos, r.neg) for r in best.collect()], pos, neg))

    first = ToxicityModel(lexicon(rows.where("most"), sizes.get((True, 1), 0), sizes.get((True, 0), 0)))
    first.reporting = _reporting(rows.where("not most"), first, min_support)
    x, y = _features_of(rows.where("not most"), first)
    first.weights = _logistic(x, y) if len(set(y)) == 2 else _logistic(*_features_of(rows, first))
    return first


def _reporting(rows: DataFrame, model: ToxicityModel, min_support: int, min_odds: float = 2.0) -> frozenset:
    """Words that stand within a window before terms mostly where the label is 0."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, n = {}, (Counter(), Counter()), [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, hits, _, _ = shared.value.matches(text or "", known)
                if hits:
                    tokens = [t for t in TOKEN.findall(text.lower()) if t not in QUOTES]
                    counts[y].update({t for place, _, _ in hits for t in tokens[max(0, place - WINDOW) : place - 1] if known.get(t) is None})
                    n[y] += 1
        words = ["", *(counts[0].keys() | counts[1].keys())]
        per = [[n[k] if w == "" else counts[k][w] for w in words] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(words), *(pa.array(x, pa.int64()) for x in per)], names=["word", "calm", "toxic"])

    summed = rows.select("text", "y").mapInArrow(run, "word string, calm long, toxic long").groupBy("word").agg(F.sum("calm").alias("calm"), F.sum("toxic").alias("toxic"))
    n = summed.where("word = ''").first()
    if n is None or not n.calm:
        return frozenset()
    odds = F.log((F.col("calm") + 0.5) / (n.calm + 1)) - F.log((F.col("toxic") + 0.5) / (n.toxic + 1))
    return frozenset(r.word for r in summed.where((F.col("word") != "") & (F.col("calm") >= min_support) & (odds >= min_odds)).collect())


def _features_of(rows: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict = {}
            x = [shared.value.features(t or "", known) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(len(FEATURES))), b.column(1)], names=[*FEATURES, "y"])

    got = rows.select("text", "y").mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", y int").toPandas()
    return got[list(FEATURES)].to_numpy(), got["y"].to_numpy()


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with toxicity, 0 to 1. Null and empty texts get the score of a text without matches. Other
    columns pass; one named toxicity is replaced."""
    keep = [c for c in docs.columns if c != "toxicity"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.select(*keep).schema.add("toxicity", "double"), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for b in batches:
            scores = []
            for t in b.column(at):
                scores.append(float(m.score(m.features(t.as_py() or "", known))))
                if len(known) > 200_000:
                    known = {}
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(scores, pa.float64())], names=[*keep, "toxicity"])

    return docs.select(*keep, F.col(text_col).alias("__tm_text")).mapInArrow(run, schema)
