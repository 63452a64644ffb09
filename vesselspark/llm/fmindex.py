"""An FM-index over word numbers: a Burrows-Wheeler transform in a wavelet matrix with packed bits, searched backward for
many patterns at once in numpy."""

from __future__ import annotations

import numpy as np

#: Suffixes are sorted by so many symbols at least, so a backward search may match as many.
DEPTH = 64


def suffix_order(symbols: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols, by doubling; the end of the text sorts first."""
    n = len(symbols)
    rank, width = symbols.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        following = np.zeros(n, dtype=np.int64)
        following[: n - width] = rank[width:]
        key = rank * (n + 2) + following if int(rank.max()) < (1 << 62) // (n + 2) else None
        if key is None:
            raise ValueError("symbols must be dense numbers")
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        steps = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = steps
        width *= 2
        if steps[-1] == n:
            break
    return order


class FMIndex:
    """``symbols``: dense numbers from 0, one per distinct word; 0 separates texts and is in no pattern. Patterns may have
    up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, depth: int = DEPTH):
        self.depth = depth
        order = suffix_order(symbols, depth)
        before = symbols[order - 1]  # of the first suffix the last symbol, a separator
        self.n, self.size = len(symbols), int(symbols.max()) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=self.size))]
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        row = before.astype(np.int64)
        for level in range(max(1, (self.size - 1).bit_length()) - 1, -1, -1):
            bits = (row >> level & 1).astype(bool)
            padded = np.zeros(-(-self.n // 64) * 64 + 64, dtype=bool)
            padded[: self.n] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]].astype(np.int32)
            self.levels.append((words, counts, int(self.n - bits.sum())))
            row = np.r_[row[~bits], row[bits]]
        every = np.arange(self.size)
        self.base = self._walk(every, np.zeros(self.size, dtype=np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (words, counts, zeros) in enumerate(self.levels):
            shift = len(self.levels) - 1 - level
            block = at >> 6
            low = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[block] + np.bitwise_count(low)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of each pattern with a symbol put before it."""
        both = self._walk(np.r_[symbols, symbols], np.r_[low, high])
        start = np.r_[self.first[symbols], self.first[symbols]] + both - np.r_[self.base[symbols], self.base[symbols]]
        return start[: len(symbols)], start[len(symbols) :]


def repeated_windows(index: FMIndex, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """For texts of the index, each ``symbols[start : start + length]``, the maximal stretches of windows that occur
    twice or more: (text, first window, windows).

    From an end the search goes back as long as a second occurrence remains, which is the matching statistic of that end.
    The index must be at least as deep as the window. Where the search stops at a word, probes look for a short stretch from that word on, of two words and twice as many each
    time, that occurs once: no window that has the stretch is repeated, so the next end lies within it. All texts move
    in step."""
    if window > index.depth:
        raise ValueError(f"an index of depth {index.depth} can't find windows of {window}")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    text = np.flatnonzero(lengths >= window)
    end = lengths[text].copy()  # of the search, or while probing of the one to come
    tip, at, stop = end.copy(), end.copy(), np.full(len(text), -1)  # the stretch being matched is [at, tip); -1: no probe
    low, high = np.zeros(len(text), np.int64), np.full(len(text), index.n)
    while len(text):
        new_low, new_high = index.extend(symbols[starts[text] + at - 1], low, high)
        more = new_high - new_low >= 2
        at, low, high = at - more, np.where(more, new_low, low), np.where(more, new_high, high)
        probing = stop >= 0
        over = ~more | np.where(probing, at == stop, (at == 0) | (tip - at >= index.depth))
        if not over.any():
            continue
        main, probe = over & ~probing, over & probing
        hit = main & (tip - at >= window)
        found.append((text[hit], at[hit], tip[hit] - window - at[hit] + 1))
        once = probe & ~more
        size = np.where(main, 2, 2 * (tip - stop))
        stop = np.where(main & ~more, at - 1, stop)
        end = np.where(hit, at + window - 1, np.where(main, end - 1, np.where(once, np.minimum(end, tip - 1), end)))
        # on with a probe, as long as it is shorter than what is known to occur once
        ahead = (main & ~more | probe & ~once) & (stop + size <= end)
        stop = np.where(over & ~ahead, -1, stop)
        tip = np.where(ahead, stop + size, np.where(over, end, tip))
        at, low, high = np.where(over, tip, at), np.where(over, 0, low), np.where(over, index.n, high)
        alive = end >= window
        text, end, tip, at, stop, low, high = (x[alive] for x in (text, end, tip, at, stop, low, high))
    return [tuple(map(int, row)) for part in found for row in zip(*part)]
