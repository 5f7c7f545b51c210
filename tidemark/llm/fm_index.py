"""An FM-index of words in numpy: suffix order, wavelet matrix, backward search and location by sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` (integers from 0 under 2^31) in order, by prefix doubling over those that still tie."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    width = 3 if int(text.max()) < (1 << 21) - 1 else 2
    shift = 63 // width
    key, padded = np.zeros(n, np.int64), np.concatenate([text + 1, np.zeros(width, np.int64)])
    for i in range(width):
        key = key << shift | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    rank, reach = np.empty(n, np.int64), width
    tied = _rank(order, key[order], np.arange(n), rank)
    while len(tied):
        own = order[tied]
        after = own + reach
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[tied] = own[by]
        tied, reach = _rank(order, key[by], tied, rank), 2 * reach
    return order


def _rank(order: np.ndarray, key: np.ndarray, places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks the suffixes at ``places`` of the order by their sorted keys; gives the places that still tie."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank[order[places]] = places[first][group]
    return places[np.diff(np.append(first, len(places)))[group] > 1]


class Bits:
    """A row of bits with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(64 * (n // 64 + 1), bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: a level of bits for each binary digit of a symbol, highest first, zeros before ones."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.digits = [], max(1, (size - 1).bit_length())
        for digit in reversed(range(self.digits)):
            bit = (symbols >> digit & 1).astype(bool)
            self.levels.append((digit, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        #: where each symbol's occurrences begin after the last level
        self.first = self._down(np.zeros(size, np.int64), np.arange(size))

    def _down(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        for digit, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbols >> digit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of times each symbol occurs before a place."""
        return self._down(at, symbols) - self.first[symbols]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and how often each occurs before its place."""
        symbols = np.zeros(len(at), np.int64)
        for digit, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            symbols |= one.astype(np.int64) << digit
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at - self.first[symbols]


class FMIndex:
    """Runs of words of a shard, held by their Burrows-Wheeler transform alone.

    ``words`` are symbols from 1 to ``size`` - 1, and 0 for a gap, which nothing spans: each
    gap is a letter of its own, below all words. ``places`` are the words' places in the
    shard. A suffix's place is sampled where its run begins and at each ``every``-th word.
    """

    def __init__(self, words: np.ndarray, places: np.ndarray, size: int, every: int = 16):
        # gaps at both ends, so that each word has a suffix after it and one before
        words = np.concatenate([[0], np.asarray(words, np.int64), [0]])
        places = np.concatenate([[-1], np.asarray(places, np.int64), [-1]])
        gap = words == 0
        gaps = int(gap.sum())
        order = suffix_order(np.where(gap, np.cumsum(gap) - 1, words + gaps - 1))
        before = words[order - 1]
        before[order == 0] = 0
        self.counts = np.bincount(words, minlength=size)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.wavelet = Wavelet(before, size)
        begins = np.concatenate([[True], gap[:-1]])
        sampled = (begins | (np.arange(len(words)) % every == 0))[order]
        self.sampled, self.samples = Bits(sampled), places[order[sampled]]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes that begin with each phrase, by backward search.

        ``phrases`` has a phrase a row, its last word first, 0 where it has no more words.
        """
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        last = phrases[:, 0]
        low[:], high[:] = self.starts[last], self.starts[last] + self.counts[last]
        for i in range(1, phrases.shape[1]):
            on = np.flatnonzero((low < high) & (lengths > i))
            if not len(on):
                continue
            symbols = phrases[on, i]
            ranks = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low[on], high[on]]))
            low[on], high[on] = self.starts[symbols] + ranks[: len(on)], self.starts[symbols] + ranks[len(on) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes, each by steps back to a sampled one."""
        out, on, steps, rows = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0, rows.copy()
        while len(on):
            known = self.sampled.get(rows)
            out[on[known]] = self.samples[self.sampled.ones(rows[known])] + steps
            on, rows, steps = on[~known], rows[~known], steps + 1
            if len(on):
                symbols, ranks = self.wavelet.read(rows)
                rows = self.starts[symbols] + ranks
        return out
