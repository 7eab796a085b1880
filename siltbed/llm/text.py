"""Shared text-to-array primitives of the training-data operators.

Texts are handled a few hundred thousand characters at a time as arrays of code points: lower-casing, finding words and
hashing them are NumPy passes with no loop over words, and every word keeps its place in the original text. Nothing
depends on the process (no ``hash()``), so retried tasks and different executors agree.

A word is a run of word characters (``\\w``: letters, digits, underscore). Lower-casing maps single code points to single
code points, so offsets never move. Null counts as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_TABLES: list[np.ndarray] = []
CHUNK_CHARS = 400_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code point, is a word character) by code point."""
    if not _TABLES:
        lower, word = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            if (ch := chr(c)).isalnum() or ch == "_":
                word[c] = True
            low = ch.lower()
            if low != ch and len(low) == 1:
                lower[c] = ord(low)
        _TABLES.extend((lower, word))
    return _TABLES[0], _TABLES[1]


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` characters; a longer text has a range to itself."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > limit:
            yield begin, k
            begin, size = k, 0
        size += len(text or "") + 1
    if begin < len(texts):
        yield begin, len(texts)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a separator, and where each begins (one more than there are texts)."""
    joined = "\n".join([t or "" for t in texts] + [""])
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or "") + 1 for t in texts], out=begins[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), begins


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: 64-bit hash, begin and end in the own text; offsets has where each text's words begin."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words(texts: list[str | None], prefix: int | None = None) -> Words:
    """All words; with ``prefix``, hashes of so many of their first characters."""
    lower, is_word = _tables()
    points, begins = code_points(texts)
    points = lower[points]
    inside = np.empty(len(points) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = is_word[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(texts) + 1, np.int64))
    length = stop - start
    chars = points[inside[1:-1]].astype(np.uint64)
    first = np.zeros(len(start), np.int64)
    np.cumsum(length[:-1], out=first[1:])
    place = np.arange(len(chars)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        each = mix(chars + (place.astype(np.uint64) << np.uint64(21)) + _MULT)
        if prefix is not None:
            each[place >= prefix] = 0
        hashes = mix(np.add.reduceat(each, first))
    offsets = np.searchsorted(start, begins)
    base = np.repeat(begins[:-1], np.diff(offsets))
    return Words(hashes, start - base, stop - base, offsets)


def word_list(text: str | None) -> list[str]:
    """The words that :func:`words` hashes, spelled out (slow; for tests and the few)."""
    if not text:
        return []
    lower, is_word = _tables()
    points = lower[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return "".join(chr(c) if is_word[c] else " " for c in points).split()


def gram_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of the ``n`` words from each place on, in O(log n) passes."""
    if len(flat) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, size, done, out = mix(flat), 1, 0, None
        while True:
            if n & size:
                m = len(flat) - (done + size) + 1
                out = power[:m] if out is None else mix(out[:m] * _MULT + power[done : done + m])
                done += size
            if size * 2 > n:
                return out
            m = len(power) - size
            power = mix(power[:m] * _MULT + power[size : size + m])
            size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours."""
    if len(x) < w:
        return x[:0]
    size = 1
    while size * 2 <= w:
        m = len(x) - size
        x = np.minimum(x[:m], x[size : size + m])
        size *= 2
    extra = w - size
    return np.minimum(x[: len(x) - extra], x[extra:]) if extra else x


def gram_sets(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, gram hash) of each distinct gram, sorted by text, then hash.

    A text of fewer than ``n`` words, but at least one, has one gram: all its words.
    """
    flat, lengths = found.hashes, np.diff(found.offsets)
    docs, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    whole = gram_hashes(flat, n)
    if len(whole):
        owner = found.owner
        inside = owner[: len(whole)] == owner[n - 1 : n - 1 + len(whole)]
        docs.append(owner[: len(whole)][inside])
        grams.append(whole[inside])
    for size in range(1, n):
        short = np.flatnonzero(lengths == size)
        if len(short):
            rows = flat[found.offsets[short][:, None] + np.arange(size)]
            docs.append(short)
            grams.append(np.array([gram_hashes(r, size)[0] for r in rows], np.uint64) + np.uint64(size))
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[fresh], gram[fresh]


def winnow(found: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints by winnowing: (text index, word place in it, hash of the ``k`` words there).

    Of any ``w`` neighbouring ``k``-grams of one text the least hash is selected (all of them in a tie), so two equal
    passages of ``k + w - 1`` words share a selected gram at the same place of the passage.
    """
    grams = gram_hashes(found.hashes, k)
    least = sliding_min(grams, w)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, span = found.owner, k + w - 1
    inside = owner[: len(least)] == owner[span - 1 : span - 1 + len(least)]
    # of the windows that cover a gram, the greatest minimum equals the gram just if the gram is one's minimum
    least = np.where(inside, least, np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    cover = ~sliding_min(~np.concatenate([edge, least, edge]), w)
    at = np.flatnonzero((cover == grams) & (cover != 0))
    return owner[at], at - found.offsets[owner[at]], grams[at]
