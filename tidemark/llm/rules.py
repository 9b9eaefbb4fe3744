"""Quality rules as learned decision lists.

Statistics of each document (counts of words, symbols, repeated lines and words) feed an ordered list of
rules `if t1 <= x and y > t2 ... then junk`. Sequential covering learns it from labelled statistics: a rule
grows on two thirds of the rows by the threshold condition with the best information gain, is pruned on the
remaining third as long as that does not hurt its accuracy there, and the rows it covers leave before the
next rule grows. The list becomes one nested conditional expression, evaluated by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import utf8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_lines", "n_distinct")
FEATURES = {
    "n_words": "n_words", "mean_word": "word_chars / n_words", "symbol_share": "n_symbols / n_words", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / n_words", "upper_share": "n_upper / word_chars", "digit_share": "n_digits / word_chars", "words_a_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / n_words", "bar_share": "n_bars / n_words",
}
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS and the number of words `|`, of a whole text."""
    w = text.split()
    letters = b"".join(w)
    chars = len(letters.translate(None, CONTINUATION))
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.split():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if len(w) > 2:
        at: dict[bytes, int] = {}
        ids = [at.setdefault(x, len(at)) for x in w]
        v = np.array(ids, np.int64)
        k = len(at) + 1
        # words are numbered, so that three of them make one number; beyond 2^21 distinct words pairs are numbered first
        pair = v[:-1] * k + v[1:]
        if k > 1 << 21:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        tri = pair[:-1] * k + v[2:]
        _, inverse, n = np.unique(tri, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(n[inverse] > 1)
        mark = np.zeros(len(v), bool)
        for j in range(3):
            mark[twice + j] = True
        repeated, distinct = int(mark.sum()), len(at)
    else:
        distinct = len(set(w))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    upper = len(letters) - len(letters.translate(None, UPPER))
    digits = len(letters) - len(letters.translate(None, DIGITS))
    return len(w), chars, symbols, dup, repeated, upper, digits, lines, distinct, w.count(b"|")


def quality_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text column, with COUNTS and n_bars as longs. Null texts count as empty. Columns of
    those names in docs are replaced."""
    names = (*COUNTS, "n_bars")
    keep = [c for c in docs.columns if c not in (*names, text_col)]
    schema = docs.select(*keep).schema
    for n in names:
        schema = schema.add(n, "long")
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(t) for t in utf8(b.column(at))]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *(pa.array(c, pa.int64()) for c in cols)], names=[*keep, *names])

    return docs.select(*keep, F.col(text_col).alias("__tm_text")).mapInArrow(run, schema)


def features() -> list[Column]:
    """FEATURES from the counts; a quotient by zero is zero."""
    return [F.coalesce(F.expr(f"try_divide({e.split(' / ')[0]}, {e.split(' / ')[1]})" if "/" in e else e).cast("double"), F.lit(0.0)).alias(n) for n, e in FEATURES.items()]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    verdict: int
    precision: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, max_conditions: int) -> list[Condition]:
    rows, found = np.arange(len(y)), []
    while len(found) < max_conditions:
        t = y[rows]
        p0, n0 = float(t.sum()), float(len(t) - t.sum())
        if not p0 or not n0:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for name, values in x.items():
            v = values[rows]
            order = np.argsort(v, kind="stable")
            s, c = v[order], np.cumsum(t[order])
            cut = np.flatnonzero(s[1:] > s[:-1])
            if not len(cut):
                continue
            p_low, size = c[cut].astype(float), (cut + 1).astype(float)
            for above, p, n in ((False, p_low, size - p_low), (True, p0 - p_low, n0 - (size - p_low))):
                g = _gain(p, n, p0, n0)
                k = int(g.argmax())
                if g[k] > best[0]:
                    best = (float(g[k]), Condition(name, above, float((s[cut[k]] + s[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        found.append(best[1])
        rows = rows[best[1].holds({k: v[rows] for k, v in x.items()})]
    return found


def _worth(conditions: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> float:
    hit = np.logical_and.reduce([c.holds(x) for c in conditions]) if conditions else np.ones(len(y), bool)
    p, n = float(y[hit].sum()), float(hit.sum() - y[hit].sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: dict[str, np.ndarray], target: np.ndarray, min_precision: float = 0.7, min_rows: int = 5, max_rules: int = 20, max_conditions: int = 4) -> list[Rule]:
    """The ordered rules for target = 1. Rows are in hash order; each third one prunes. Stops when a rule
    covers fewer than min_rows rows or its precision (Laplace) is under min_precision."""
    x, y, rules = {k: np.asarray(v, float) for k, v in rows.items()}, np.asarray(target, np.int64), []
    prune = np.arange(len(y)) % 3 == 2
    while len(rules) < max_rules and y.sum() >= min_rows:
        own = {k: v[prune] for k, v in x.items()}
        conditions = _grow({k: v[~prune] for k, v in x.items()}, y[~prune], max_conditions)
        while len(conditions) > 1 and _worth(conditions[:-1], own, y[prune]) >= _worth(conditions, own, y[prune]):
            conditions = conditions[:-1]
        if not conditions:
            break
        rule = Rule(tuple(conditions), 1, 0.0)
        hit = rule.holds(x)
        p = int(y[hit].sum())
        precision = (p + 1) / (int(hit.sum()) + 2)
        if hit.sum() < min_rows or precision < min_precision:
            break
        rules.append(Rule(rule.conditions, 1, precision))
        x, y, prune = {k: v[~hit] for k, v in x.items()}, y[~hit], prune[~hit]
    return rules


def verdict(rules: list[Rule], default: int = 0) -> Column:
    """The list as nested conditionals: the first rule that holds decides."""
    out = F.lit(default)
    for rule in reversed(rules):
        test = rule.conditions[0].column()
        for c in rule.conditions[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(rule.verdict)).otherwise(out)
    return out


def learn_from(labelled: DataFrame, target: str) -> list[Rule]:
    """labelled: features and a 0/1 column, of a bounded sample; its statistics (not its texts) are collected."""
    got = labelled.select(*FEATURES, target).toPandas()
    return learn({k: got[k].to_numpy() for k in FEATURES}, got[target].to_numpy())
