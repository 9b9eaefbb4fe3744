"""Words and shingles of many texts at once, as NumPy arrays of 64-bit hashes.

Texts are laid end to end as code points. A table gives each code point a 64-bit value, zero for separators;
a word's hash is the polynomial of its values, taken from running sums, and mixed. A shingle's hash is a
polynomial of its words' hashes, mixed. No step works word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np

PIECE, GROUP = 1 << 17, 1 << 20
BASE, STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
INVERSE = pow(BASE, -1, 1 << 64)


class Words(NamedTuple):
    hash: np.ndarray  # uint64
    size: np.ndarray  # code points
    first: np.ndarray  # where each text's words start; one entry more than texts


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


@cache
def spaced() -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    points = np.arange(0x110000, dtype=np.uint64)
    points[65:91] += np.uint64(32)
    table = mixed((points + np.uint64(1)) * np.uint64(BASE)) | np.uint64(1)
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


@cache
def alphanumeric() -> np.ndarray:
    """Words of letters and digits, lower-cased letter by letter."""
    lower = np.array([ord(chr(i).lower()[0]) if chr(i).isalnum() else 0 for i in range(0x110000)], np.uint64)
    return np.where(lower > 0, mixed((lower + np.uint64(1)) * np.uint64(BASE)) | np.uint64(1), np.uint64(0))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0, 1, ..., n - 1."""
    out = []
    for b in (BASE, INVERSE):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def grouped(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) in groups of about GROUP code points; a longer text is a group of its own."""
    start, part, n = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if part and n + len(t) > GROUP:
            yield start, part
            start, part, n = i, [], 0
        part.append(t)
        n += len(t) + 1
    if part:
        yield start, part


def words_of(texts: list[str], table: np.ndarray) -> Words:
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes, starts, sizes, at = [], [], [], 0
    span = PIECE
    while at < len(points):
        value = table[points[at : at + span]]
        inside = value != 0
        if at + span < len(points) and inside[-1]:  # pieces end between words
            gaps = np.flatnonzero(~inside)
            if not len(gaps):
                span *= 2
                continue
            value, inside = value[: gaps[-1] + 1], inside[: gaps[-1] + 1]
        n = len(value)
        up, down = powers(span)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value * up[:n], out=total[1:])
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        a, b = edge[::2], edge[1::2]
        hashes.append(mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * STEP))
        starts.append(a + at), sizes.append(b - a)
        at, span = at + n, PIECE
    if not hashes:
        return Words(np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(np.concatenate(hashes), np.concatenate(sizes), np.searchsorted(np.concatenate(starts), begin))


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, code points, first): the shingles of each text in order, repeats included. A text of fewer words
    has one shingle, the whole sequence; a text without words has none."""
    n, first = len(words.hash), words.first
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(first), np.int64)
    total = np.zeros(n, np.uint64)
    ahead = np.append(words.hash, np.zeros(size, np.uint64))
    for k in range(size):
        total = total * STEP + ahead[k : k + n]
    sums = np.concatenate([[0], np.cumsum(words.size)])
    length = sums[np.minimum(np.arange(n) + size, n)] - sums[:-1] + size - 1
    whole = np.ones(n, bool)
    for k in range(1, size):
        whole[np.maximum(first[1:][first[1:] > 0] - k, 0)] = False
    counts = np.diff(first)
    for t in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        a, b = int(first[t]), int(first[t + 1])
        h = np.zeros(1, np.uint64)
        for x in words.hash[a:b]:
            h = h * STEP + x
        total[a], length[a] = h[0] ^ np.uint64(b - a), sums[b] - sums[a] + b - a - 1
        whole[a:b] = False
        whole[a] = True
    taken = np.concatenate([[0], np.cumsum(whole)])
    return mixed(total[whole]), length[whole], taken[first]
