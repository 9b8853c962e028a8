"""An FM-index over a sequence of word numbers, in numpy.

The suffix array is sorted by rank tripling, where only suffixes that are
still tied are sorted again. Ranks in the Burrows-Wheeler transform come from
a wavelet matrix of packed bits, positions from sampled suffixes.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols; the last symbol must be the only one of its kind or a shorter suffix is the smaller."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    width = 3 if max(n, int(symbols.max()) + 1) < (1 << 21) - 1 else 2
    bits = 63 // width

    def key(ranks: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        out = ranks[at] + 1
        for k in range(1, width):
            place = at + k * step
            out = out << bits | np.where(place < n, ranks[np.minimum(place, n - 1)] + 1, 0)
        return out

    ranks = symbols.astype(np.int64)
    todo, step = np.arange(n), 1
    base = np.zeros(n, np.int64)  # of a suffix's group: its first row
    order = np.zeros(n, np.int64)
    while len(todo):
        keys = key(ranks, todo, step)
        by = np.argsort(keys)
        todo, keys = todo[by], keys[by]
        # Groups of the last round stay together, as a key starts with its group's rank.
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        if step == 1:
            row = np.arange(n)
        else:
            group = base[todo]
            first = np.concatenate([[True], group[1:] != group[:-1]])
            starts = np.flatnonzero(first)
            row = group + np.arange(len(todo)) - np.repeat(starts, np.diff(np.append(starts, len(todo))))
        order[row] = todo
        lead = np.flatnonzero(new)
        head = np.repeat(row[lead], np.diff(np.append(lead, len(todo))))
        if step == 1:
            ranks = np.empty(n, np.int64)
        ranks[todo] = head
        base[todo] = head
        sizes = np.diff(np.append(lead, len(todo)))
        todo = todo[np.repeat(sizes > 1, sizes)]
        step *= width
    return order


class Bits:
    """A bit vector with rank, as packed words and a count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Rank and access over a sequence of numbers."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.depth = max(1, int(values.max(initial=0)).bit_length())
        values = values.astype(np.int32)
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            zeros = values[~bit]
            self.levels.append((Bits(bit), len(zeros)))
            values = np.concatenate([zeros, values[bit]])
        heads = np.flatnonzero(np.diff(values, prepend=-1))
        self.first = np.full(1 << self.depth, 0, np.int64)  # where a value's run starts after the last level
        self.first[values[heads]] = heads

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before each place."""
        for k, (bits, zeros) in enumerate(self.levels):
            one = (value >> (self.depth - 1 - k) & 1).astype(bool)
            ones = bits.ones(at)
            at = np.where(one, zeros + ones, at - ones)
        return at - self.first[value]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each place, and how often it occurs before it."""
        value = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            value = value << 1 | one
            at = np.where(one > 0, zeros + ones, at - ones)
        return value, at - self.first[value]


class FMIndex:
    """Documents of word numbers (1 and up), separated by 0, indexed for exact phrases."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        """``words``: all documents' words; ``ends``: where each document ends."""
        docs = len(ends)
        self.starts = np.concatenate([[0], ends[:-1]]) + np.arange(docs)  # in the text with separators
        self.text_len = len(words) + docs
        text = np.zeros(self.text_len, np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(ends, prepend=0))] = words
        # Separators differ from one another, so that no comparison runs on into the next document.
        distinct = text + docs
        distinct[ends + np.arange(docs)] = np.arange(docs)
        order = suffix_array(distinct)
        self.bwt = WaveletMatrix(text[order - 1])
        counts = np.bincount(text, minlength=int(words.max(initial=0)) + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        sampled = order % SAMPLE == 0
        sampled |= np.isin(order, self.starts)  # a walk back never crosses a separator
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (right-aligned rows of word numbers, negative: a word the index lacks)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.text_len, np.int64)
        width = phrases.shape[1] if phrases.ndim == 2 else 0
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            word = phrases[live, width - back]
            known = word >= 0
            hi[live[~known]] = lo[live[~known]]
            live, word = live[known], word[known]
            if len(live):
                ranks = self.bwt.rank(np.concatenate([word, word]), np.concatenate([lo[live], hi[live]]))
                lo[live] = self.before[word] + ranks[: len(live)]
                hi[live] = self.before[word] + ranks[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            done = self.sampled.get(rows[open_]) > 0
            here = open_[done]
            out[here] = self.positions[self.sampled.ones(rows[here])] + steps[here]
            open_ = open_[~done]
            word, rank = self.bwt.access_rank(rows[open_])
            rows[open_] = self.before[word] + rank
            steps[open_] += 1
        return out

    def place(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, word in it) of text positions."""
        doc = np.searchsorted(self.starts, positions, "right") - 1
        return doc, positions - self.starts[doc]
