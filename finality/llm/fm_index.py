"""An FM-index over words: Burrows-Wheeler transform of many short segments in a wavelet matrix, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

#: Suffixes are told apart by so many words; patterns may have as many.
DEPTH = 128


class WaveletMatrix:
    """Bits of a sequence of small numbers, level by level from the highest, with counts of ones before each 64-bit word."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for level in range(bits - 1, -1, -1):
            ones = ((sequence >> level) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(sequence) // 64 + 2, dtype="<u8")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), dtype=np.int64)
            before[1:] = np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)
            zeros = len(sequence) - int(ones.sum())
            self.levels.append((level, words, before, zeros))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` elements' copies of each symbol end in the order of the last level."""
        for level, words, before, zeros in self.levels:
            word = at >> 6
            below = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = before[word] + np.bitwise_count(below)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions ordered by the ``depth`` symbols from there on, by doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    length = 1
    while length < depth:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - length)] = rank[length:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        steps = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            break
        length *= 2
    return order


class FmIndex:
    """Segments of words with weights; an interval of suffixes has the weights of the segments they lie in.

    ``words``: word hashes of all segments end to end; ``lengths`` and ``weights``: of each segment.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        distinct, ids = np.unique(words, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        # each segment is followed by symbol 0
        text = np.zeros(len(words) + len(lengths), dtype=np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        text[np.arange(len(words)) + owner] = ids
        order = suffix_order(text)
        self.size, self.segments = len(text), len(lengths)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.text = text
        self.transform = WaveletMatrix(text[order - 1], max(1, int(len(distinct)).bit_length()))
        symbols = np.arange(len(distinct) + 1)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(symbols)))])[:-1]
        self.base = self.transform.place(symbols, np.zeros(len(symbols), dtype=np.int64))
        per_position = np.repeat(weights, lengths + 1).astype(np.int64)
        self.weight = np.concatenate([[0], np.cumsum(per_position[order])])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the patterns with one more symbol before them."""
        both = self.transform.place(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        shift = self.smaller[symbols] - self.base[symbols]
        n = len(symbols)
        return both[:n] + shift, both[n:] + shift

    def reach(self, segments: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
        """Matching statistics: for each segment and end, the smallest start for which [start, end) has the weight ``least``."""
        begin = self.starts[segments]
        at = ends.copy()
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.size, dtype=np.int64)
        live = np.flatnonzero(at > 0)
        while len(live):
            symbols = self.text[begin[live] + at[live] - 1]
            new_low, new_high = self.extend(symbols, low[live], high[live])
            good = self.weight[new_high] - self.weight[new_low] >= least
            live, new_low, new_high = live[good], new_low[good], new_high[good]
            low[live], high[live] = new_low, new_high
            at[live] -= 1
            live = live[at[live] > 0]
        return at

    def repeated(self, segments: np.ndarray, anchor_ends: np.ndarray, window: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal ranges (segment, from, to) of ``window`` words or more whose windows all have the weight ``least``.

        Every window of a segment holds the words before its ``anchor_end`` down to its anchor, so no window begins
        before the place that the search from there reaches. Ends go down from the end of the segment; the range that an end
        reaches is reported if it is long enough.
        """
        lowest = self.reach(segments, anchor_ends, least)
        ends = self.starts[segments + 1] - self.starts[segments] - 1
        live = np.flatnonzero(ends - lowest >= window)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            start = self.reach(segments[live], ends[live], least)
            hit = ends[live] - start >= window
            out.append((segments[live][hit], start[hit], ends[live][hit]))
            # windows that begin before ``start`` end below this end, and within ``window`` of it
            ends[live] = np.minimum(ends[live] - 1, start + window - 1)
            live = live[(ends[live] - lowest[live] >= window) & (start > 0)]
        if not out:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, empty
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
