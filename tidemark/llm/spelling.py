"""Spelling variants: words one edit apart, found by search schemes on bidirectional FM-indexes.

Two words one edit apart share a half: the first half of one begins the other, or its second half ends the other. So every word
is sent, under its possible halves, to the shard of the half; a shard's words, each between delimiters, become one FM-index.
A search matches a half exactly, delimiter included, as an interval of suffix ranks, and extends it across the other half,
spending one error. Shards are dealt by the hash of the half, and halves that very many words share are split over several
shards, to each of which their searches go, so a shard's size doesn't grow with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stored, stored

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
SHARD, PIECE = 400_000, 10_000  # code points of a shard, about; words that one half brings to a shard, at most about

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"


class WaveletMatrix:
    """Symbols by bits, highest first: ranks of a symbol, and of those below it, in a few array look-ups."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.n_zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = symbols >> b & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.n_zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of symbol before lo and before hi, and symbols below it from lo to hi."""
        below, a, b = np.zeros(len(lo), np.int64), lo, hi
        start = np.zeros(len(lo), np.int64)  # where the symbol's own prefix begins on the level
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.n_zeros[level]
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            a1, b1, s1 = ones[a].astype(np.int64), ones[b].astype(np.int64), ones[start].astype(np.int64)
            below += np.where(one, (b - b1) - (a - a1), 0)
            a, b, start = (np.where(one, zeros + x1, x - x1) for x, x1 in ((a, a1), (b, b1), (start, s1)))
        return a - start, b - start, below


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix starts in order, by prefix doubling; the last symbol is the smallest and stands once."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:] + 1
        order = np.argsort(key := rank * (n + 1) + ahead, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class States:
    """Intervals of one search each: of suffix ranks in the text (f) and in the reversed text (r), with equal sizes."""

    def __init__(self, query: np.ndarray, f: np.ndarray, r: np.ndarray, size: np.ndarray):
        self.query, self.f, self.r, self.size = query, f, r, size

    def take(self, at: np.ndarray) -> States:
        return States(self.query[at], self.f[at], self.r[at], self.size[at])

    @staticmethod
    def joined(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("query", "f", "r", "size")))


class BidirectionalIndex:
    """FM-indexes of a delimited vocabulary and of its reversal, whose intervals are kept in step. Symbol 0 ends the text, 1 delimits."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)  # the delimiter is the smallest
        self.sigma = len(self.alphabet) + 1
        text = np.searchsorted(self.alphabet, points) + 1
        self.word_at = np.cumsum(points == 0) - 1
        bits = max(self.sigma - 1, 1).bit_length()
        self.before = np.concatenate([[0], np.cumsum(np.bincount(np.append(text, 0), minlength=self.sigma))])
        self.order, self.bwt, self.wavelet = [], [], []
        for t in (np.append(text, 0), np.append(text[::-1], 0)):
            order = suffix_order(t)
            bwt = t[order - 1]
            self.order.append(order), self.bwt.append(bwt), self.wavelet.append(WaveletMatrix(bwt, bits))

    def coded(self, word: str) -> np.ndarray:
        """Symbols of a word; one that the vocabulary lacks is -1."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1)

    def start(self, query: np.ndarray) -> States:
        zero = np.zeros(len(query), np.int64)
        return States(query, zero, zero, np.full(len(query), self.before[-1]))

    def extend(self, s: States, symbol: np.ndarray, right: bool) -> States:
        """The states with a symbol more on one side; those that nothing matches leave."""
        at = np.flatnonzero(symbol >= 0)
        s, symbol = s.take(at), symbol[at]
        own, other = (s.r, s.f) if right else (s.f, s.r)
        lo, hi, below = self.wavelet[int(right)].ranks(symbol, own, own + s.size)
        own, other, size = self.before[symbol] + lo, other + below, hi - lo
        out = States(s.query, other, own, size) if right else States(s.query, own, other, size)
        return out.take(np.flatnonzero(size > 0))

    def branches(self, s: States, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol): the letters by which states can be extended on a side. Small intervals are read, large ones offer the alphabet."""
        small = np.flatnonzero(s.size <= self.sigma)
        size = s.size[small]
        state = np.repeat(small, size)
        rows = np.arange(len(state)) - np.repeat(np.cumsum(size) - size, size) + np.repeat((s.r if right else s.f)[small], size)
        pairs = np.unique(state * self.sigma + self.bwt[int(right)][rows])
        large = np.flatnonzero(s.size > self.sigma)
        pairs = np.concatenate([pairs, (large[:, None] * self.sigma + np.arange(2, self.sigma)).ravel()])
        state, symbol = pairs // self.sigma, pairs % self.sigma
        letters = symbol > 1
        return state[letters], symbol[letters]

    def words_of(self, s: States) -> np.ndarray:
        """Which word each state, a whole delimited word, is."""
        return self.word_at[self.order[0][s.f]]


def one_error(index: BidirectionalIndex, halves: np.ndarray, others: np.ndarray, n_half: np.ndarray, n_other: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): the words that hold a query's half exactly and its other half with one edit.

    halves and others are symbols, a row a query, in the order in which they are matched: a half from its inner end outwards (so
    that it ends at the delimiter), the other half from its inner end outwards too. right: the other half is on the right.
    """
    n = len(halves)
    exact = index.start(np.arange(n))
    for i in range(int(n_half.max(initial=0))):  # the half itself, away from the other
        go = i < n_half[exact.query]
        symbol = halves[exact.query, i]
        exact = States.joined([exact.take(np.flatnonzero(~go)), index.extend(exact.take(np.flatnonzero(go)), symbol[go], not right)])
    exact = index.extend(exact, np.ones(len(exact.query), np.int64), not right)
    spent, found = index.start(np.zeros(0, np.int64)), []
    for i in range(int(n_other.max(initial=0)) + 1):
        # with i symbols of the other half matched: exact has no error yet, spent has one
        parts = []
        if len(exact.query):
            left = exact.take(np.flatnonzero(i < n_other[exact.query]))  # symbols are left
            state, symbol = index.branches(exact, right)
            inserted = index.extend(exact.take(state), symbol, right)  # the word has a letter more here
            state, symbol = index.branches(left, right)
            differs = symbol != others[left.query[state], i] if len(left.query) else np.zeros(0, bool)
            replaced = index.extend(left.take(state[differs]), symbol[differs], right)
            go = [left, replaced]  # left: the word lacks this letter; both stand after i + 1 symbols, with the error spent
            spent = States.joined([spent, inserted])
        else:
            left, go = exact, []
        ended = spent.query[:0] if not len(spent.query) else np.flatnonzero(n_other[spent.query] == i)
        if len(ended):
            done = index.extend(spent.take(ended), np.ones(len(ended), np.int64), right)
            found.append((done.query, index.words_of(done)))
        on = spent.take(np.flatnonzero(i < n_other[spent.query]))
        parts = [index.extend(on, others[on.query, i], right), *go]
        exact = index.extend(left, others[left.query, i], right) if len(left.query) else left
        spent = States.joined(parts)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows], np.int64)
    out = np.full((len(rows), int(n.max(initial=0)) + 1), -1, np.int64)
    for row, r in zip(out, rows):
        row[: len(r)] = r
    return out, n


def shard_pairs(shard: pd.DataFrame, at_once: int = 1 << 21) -> Iterator[tuple[list[str], list[str]]]:
    """(words, near words) of one shard: rows (word, first, held, asks) say which half brought a word,
    whether it is indexed, and whether it searches."""
    words = sorted(set(shard.loc[shard["held"], "word"]))
    if not words:
        return
    index = BidirectionalIndex(words)
    for first in (True, False):
        asking = sorted(shard.loc[shard["asks"] & (shard["first"] == first), "word"], key=len)
        a = 0
        while a < len(asking):  # searches of about one length at once, so that long words make no large tables
            b = a + 1
            while b < len(asking) and (b + 1 - a) * len(asking[b]) <= at_once // 16:
                b += 1
            some = asking[a:b]
            coded = [index.coded(w) for w in some]
            mid = [len(w) // 2 for w in some]
            heads, tails = [c[:m][::-1] for c, m in zip(coded, mid)], [c[m:] for c, m in zip(coded, mid)]
            half, other = (heads, tails) if first else (tails, heads)
            (h, nh), (o, no) = _padded(half), _padded(other)
            query, near = one_error(index, h, o, nh, no, right=first)
            pairs = np.unique(query * len(words) + near)
            query, near = pairs // len(words), pairs % len(words)
            yield [some[q] for q in query], [words[w] for w in near]
            a = b


def halves_of(word: Column, min_length: int) -> Column:
    """The halves under which a word is sent: those of words of its own length, one shorter and one longer; `asks`: of its own."""
    n = F.char_length(word)
    own = F.array_distinct(F.filter(F.array(n - 1, n, n + 1), lambda k: k >= min_length))
    first = F.array_distinct(F.transform(own, lambda k: F.floor(k / 2).cast("int")))
    last = F.array_distinct(F.transform(own, lambda k: (k - F.floor(k / 2)).cast("int")))
    rows = lambda sizes, is_first, mine: F.transform(sizes, lambda k: F.struct(F.lit(is_first).alias("first"), (F.substr(word, F.lit(1), k) if is_first else F.substr(word, n - k + 1)).alias("half"), (k == mine).alias("asks")))
    return F.concat(rows(first, True, F.floor(n / 2)), rows(last, False, n - F.floor(n / 2)))


def near_words(vocabulary: DataFrame, min_length: int = MIN_LENGTH, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """(word, near): all ordered pairs of words of the vocabulary (distinct words, none shorter than min_length, which is at
    least two) that one inserted, deleted or replaced code point makes equal."""
    sent = vocabulary.select("word", F.explode(halves_of(F.col("word"), min_length)).alias("h")).select("word", "h.first", "h.half", "h.asks")
    chars = vocabulary.agg(F.sum(F.char_length("word")).alias("n")).first().n or 0
    shards = max(1, -(-4 * chars // shard))
    hot = sent.groupBy("first", "half").agg(F.count("*").alias("n")).where(F.col("n") > piece).select("first", "half", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    rows = sent.join(hot, ["first", "half"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own, pieces = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"), F.col("pieces")
    every = F.sequence(F.lit(0), pieces - 1)
    # cell (i, j) of a half: its piece i is indexed, its piece j searches
    held = F.transform(every, lambda j: F.struct((own * pieces + j).alias("cell"), F.lit(True).alias("held"), (F.col("asks") & (j == own)).alias("asks")))
    asks = F.transform(F.filter(every, lambda i: F.col("asks") & (i != own)), lambda i: F.struct((i * pieces + own).alias("cell"), F.lit(False).alias("held"), F.lit(True).alias("asks")))
    rows = rows.select("word", "first", "half", F.explode(F.concat(held, asks)).alias("c"))
    dealt = rows.select("word", "first", "c.held", "c.asks", F.pmod(F.xxhash64("first", "half", "c.cell"), F.lit(shards)).alias("shard"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = list(shard_pairs(rows))
        return pd.DataFrame({"word": [w for a, _ in found for w in a], "near": [w for _, b in found for w in b]}, dtype=object)

    pairs = dealt.groupBy("shard").applyInPandas(search, "word string, near string")
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def variants(vocabulary: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """vocabulary (word, n; words once) with form, root, n_near, form_n.

    n_near: words one edit away. form: of these the one of largest n, ties going to the smallest in code-point order, if its n is at
    least `ratio` times the word's, else null; root: the last of a word's chain of forms, or the word. ratio is two or more, so
    chains are no longer than the binary digits of a count. Null words and words under min_length aren't allowed.
    """
    words = stored(vocabulary.select("word", "n"), "vocabulary")
    pairs = near_words(words, min_length).join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
    rows = words.join(best, "word", "left")
    strong = -F.col("best.m") >= ratio * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")), "forms")
    drop_stored(words)
    links = rows.where("form is not null").select(F.col("word").alias("from_"), F.col("form").alias("to_"))
    roots = stored(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each turn follows all chains by one form; chains are a few words long
        moved = stored(roots.join(links, F.col("root") == F.col("from_"), "left").select("word", F.coalesce("to_", "root").alias("root"), F.col("to_").isNotNull().alias("moved")), "roots")
        drop_stored(roots)
        roots = moved
        if moved.where("moved").isEmpty():
            break
    return rows.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary_of(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, letters: str = LETTERS, every: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): maximal runs of letters of at least min_length code points, A-Z lower-cased, that stand at least min_count times.

    every: runs of a document whose crc32 of `<id>:<run>` that number divides lose one code point, a stand-in for slips of the
    pen. A null id counts as the empty text, a null text has no words. Runs shorter than min_length can't give words, and are
    left out by the pattern already.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({letters}{{{min_length},}})"), F.lit(1))).alias("run")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if every is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = F.pmod(h, F.char_length("run").cast("long")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        rows = rows.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("run")).where(F.char_length("run") >= min_length)
    return rows.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def oracle(every: int = 31, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> str:
    """DuckDB SQL for variants() of the vocabulary of documents: words meet in what is left when a code point is deleted."""
    return rf"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]{{{min_length},}}')) AS run FROM documents),
 rc AS (SELECT doc_id || ':' || run AS feature, run, count(*) AS times FROM r GROUP BY ALL),
 x AS (SELECT feature, hex(encode(feature)) AS h, strlen(feature) AS n FROM rc GROUP BY feature),
 bits AS (SELECT range AS v, list_reduce(list_concat([range], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256)),
 z AS (SELECT 0 AS k, v, t FROM bits UNION ALL SELECT k + 1, z.v, xor(b.t, z.t >> 8) FROM z JOIN bits b ON b.v = z.t & 255 WHERE k < (SELECT max(n) FROM x)),
 ones AS (SELECT 0 AS k, 4294967295 AS t UNION ALL SELECT k + 1, xor(b.t, o.t >> 8) FROM ones o JOIN bits b ON b.v = o.t & 255 WHERE k < (SELECT max(n) FROM x)),
 ats AS (SELECT feature, n, h, unnest(range(n)) AS j FROM x),
 sums AS (SELECT feature, any_value(ats.n) AS n, bit_xor(z.t) AS c FROM ats JOIN z ON z.k = ats.n - 1 - ats.j AND z.v = ('0x' || substr(ats.h, 2 * ats.j + 1, 2))::BIGINT GROUP BY feature),
 crc AS (SELECT feature, xor(xor(sums.c, ones.t), 4294967295) AS h FROM sums JOIN ones ON ones.k = sums.n),
 e AS (SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM rc JOIN crc USING (feature)),
 v AS (SELECT word, sum(times)::BIGINT AS n FROM e WHERE length(word) >= {min_length} GROUP BY word HAVING sum(times) >= {min_count}),
 d AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v), c AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM d),
 p AS (SELECT a.word, b.word AS near, b.n AS m FROM c a JOIN c b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM c a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM c a JOIN v b ON a.rest = b.word),
 q AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word), bn AS (SELECT p.word, n_near, q.m, min(p.near) AS near FROM p JOIN q ON p.word = q.word AND p.m = q.m GROUP BY ALL),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * v.n THEN near END AS form, CASE WHEN m >= {ratio} * v.n THEN m END AS form_n FROM v LEFT JOIN bn USING (word)),
 chain AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT chain.word, f.form, steps + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
 roots AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
 SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)"""
