"""Hashed word and character n-gram features of text batches, computed in numpy over code points.

The code points of several texts lie in one array, with PAD zeros after each text, so no n-gram reaches from one
text into the next and a text's features do not depend on its neighbours in the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PAD = 6
CHARS_AT_ONCE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
WORD_POWERS = 4096
_powers = np.empty(WORD_POWERS, dtype=np.uint64)
_powers[0] = 1
for _k in range(1, WORD_POWERS):
    _powers[_k] = np.uint64((int(_powers[_k - 1]) * int(BASE)) & (1 << 64) - 1)


def grouped(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in groups of about CHARS_AT_ONCE characters; a longer text is a group alone."""
    group, size = [], 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > CHARS_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points with padding, and where each text starts."""
    pad = "\0" * PAD
    points = np.frombuffer((pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.cumsum([0, *(len(x) + PAD for x in texts)])[:-1]
    return points, starts


def _bucket(values: np.ndarray, kind: int, bits: int) -> np.ndarray:
    mixed = (values ^ np.uint64(kind * 0x51ED2701)) * MIX
    return ((mixed ^ (mixed >> np.uint64(29))) * BASE >> np.uint64(64 - bits)).astype(np.int32)


def features(texts: list[str], bits: int, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) arrays, one pair per kind of feature: words, pairs of adjacent words (a word
    and itself being one feature whatever the word), and character n-grams of ``sizes``, in which any white space
    counts as one blank. Rows are in text order within a kind."""
    points, starts = code_points(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.r_[starts, len(points)]))
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    word = ~blank & (points != 0)
    first = np.flatnonzero(word & np.r_[True, ~word[:-1]])
    wide = points.astype(np.uint64)
    if len(first):
        at = np.flatnonzero(word)
        lengths = np.diff(np.r_[np.searchsorted(at, first), len(at)])
        within = (np.arange(len(at)) - np.repeat(np.searchsorted(at, first), lengths)) % WORD_POWERS
        hashed = np.add.reduceat((wide[at] + np.uint64(1)) * _powers[within], np.searchsorted(at, first))
        owners = owner[first]
        yield _bucket(hashed, 1, bits), owners
        same = owners[1:] == owners[:-1]
        pairs = np.where(hashed[:-1] == hashed[1:], np.uint64(1), hashed[:-1] * MIX + hashed[1:])
        yield _bucket(pairs[same], 2, bits), owners[1:][same]
    wide = np.where(blank, np.uint64(32), wide)
    for size in sizes:
        if len(points) < size:
            continue
        gram = np.zeros(len(points) - size + 1, dtype=np.uint64)
        for k in range(size):
            gram = gram * np.uint64(0x1000193) + wide[k : len(points) - size + 1 + k]
        full = (points[: len(gram)] != 0) & (points[size - 1 :] != 0)
        yield _bucket(gram[full], 10 + size, bits), owner[: len(gram)][full]
