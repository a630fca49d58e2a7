"""A compressed full-text index of word sequences: BWT in a wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

#: Length of the windows; suffixes are ordered by as many symbols.
SPAN = 13
ONE = np.uint64(1)


class Bits:
    """A bit vector packed into 64-bit words with cumulative counts."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32 if len(bits) < 1 << 31 else np.int64)
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        below = (ONE << (at & 63).astype(np.uint64)) - ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class Wavelet:
    """Wavelet matrix of a symbol array: rank of any symbol in any prefix."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1 == 1
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def range(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of ``symbol[i]`` before ``lo[i]`` and before ``hi[i]``, up to one common offset."""
        for k, bits in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - k)) & 1 == 1
            a, b = bits.ones(lo), bits.ones(hi)
            lo, hi = np.where(one, bits.zeros + a, lo - a), np.where(one, bits.zeros + b, hi - b)
        return lo, hi


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (first[i], second[i])."""
    key = first.astype(np.uint64) * np.uint64(int(second.max()) + 1) + second.astype(np.uint64)
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


class FmIndex:
    """Index of several sequences of symbols 1..sigma-1; 0 ends each of them.

    Suffixes are ordered by their first ``SPAN`` symbols, which is what backward
    search for patterns up to that length needs.
    """

    def __init__(self, sequences: list[np.ndarray], sigma: int) -> None:
        text = np.zeros(sum(map(len, sequences)) + len(sequences) + 1, dtype=np.int64)
        at, owner = 0, np.zeros(len(text), dtype=np.int64)
        for k, s in enumerate(sequences):
            text[at : at + len(s)] = s
            owner[at : at + len(s) + 1] = k
            at += len(s) + 1
        owner[at:] = max(0, len(sequences) - 1)

        def later(rank: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate([rank[by:] + 1, np.zeros(min(by, len(rank)), dtype=np.int64)])[: len(rank)]

        rank = text
        for by in (1, 2, 4):  # ranks by 2, 4 and 8 symbols
            rank = paired(rank, later(rank, by))
        # SPAN symbols are the first eight and the last eight of them, SPAN - 1 likewise
        shorter, full = later(rank, SPAN - 9), later(rank, SPAN - 8)
        order = np.argsort(rank.astype(np.uint64) * np.uint64(len(text) + 2) + full.astype(np.uint64), kind="stable")
        first = rank[order]
        self.owner = owner[order]
        self.wavelet = Wavelet(text[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # where the wavelet puts the first occurrence of each symbol
        symbols = np.arange(sigma, dtype=np.int64)
        self.origin, _ = self.wavelet.range(symbols, np.zeros(sigma, np.int64), np.zeros(sigma, np.int64))
        self.size = len(text)
        changed = np.concatenate([[True], np.diff(first) != 0])
        wider = changed | np.concatenate([[True], np.diff(shorter[order]) != 0])
        starts = np.flatnonzero(wider)
        ends = np.concatenate([starts[1:], [self.size]])
        group = np.cumsum(wider) - 1
        self.wider_lo, self.wider_hi = starts[group], ends[group]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of ``symbol`` followed by what ``[lo, hi)`` matches."""
        a, b = self.wavelet.range(symbol, lo, hi)
        return self.before[symbol] + a - self.origin[symbol], self.before[symbol] + b - self.origin[symbol]

    def interval(self, pattern: np.ndarray) -> tuple[int, int]:
        """Suffixes that begin with the pattern (at most ``SPAN`` symbols); empty if none does."""
        lo, hi = np.array([0]), np.array([self.size])
        for symbol in pattern[::-1]:
            lo, hi = self.extend(np.array([symbol]), lo, hi)
            if lo[0] >= hi[0]:
                return 0, 0
        return int(lo[0]), int(hi[0])

    def least(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For each interval of suffixes the least ``value`` of the sequences they are in; the largest number if it is empty.

        The intervals are those of equally long patterns, hence equal or apart.
        """
        out = np.full(len(lo), np.iinfo(np.int64).max)
        some = np.flatnonzero(lo < hi)
        if len(some):
            begin, first, which = np.unique(lo[some], return_index=True, return_inverse=True)
            ends = np.stack([begin, hi[some][first]], axis=1).ravel()
            out[some] = np.minimum.reduceat(value[np.append(self.owner, 0)], ends)[::2][which]  # an interval may end behind the last suffix
        return out

    def stream(self, sequences: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Matching statistics cut at ``SPAN``: for every window of each sequence, its interval of suffixes (lo, hi), empty if it does not occur.

        All sequences are read from their ends at once.  After a whole window the
        interval is widened to its first ``SPAN - 1`` symbols, so that each further
        word costs one step.  After a mismatch, windows are searched one by one
        until one occurs.
        """
        n = np.array([len(s) for s in sequences], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(n)])
        flat = np.concatenate([*sequences, np.empty(0, np.int64)]).astype(np.int64)
        first, last = np.zeros(len(flat), dtype=np.int64), np.zeros(len(flat), dtype=np.int64)
        lo, hi, length = np.zeros(len(n), np.int64), np.full(len(n), self.size), np.zeros(len(n), np.int64)
        for back in range(1, int(n.max(initial=0)) + 1):
            live = np.flatnonzero(n >= back)
            at = begin[live + 1] - back
            lost = length[live] < 0
            whole = live[length[live] == SPAN]
            lo[whole], hi[whole] = self.wider_lo[lo[whole]], self.wider_hi[lo[whole]]
            length[whole] -= 1
            if lost.any():
                again = live[lost]
                lo[again], hi[again] = 0, self.size
                if back >= SPAN:
                    for k in range(SPAN - 1, 0, -1):
                        lo[again], hi[again] = self.extend(flat[at[lost] + k], lo[again], hi[again])
                length[again] = SPAN - 1
            lo[live], hi[live] = self.extend(flat[at], lo[live], hi[live])
            length[live] = np.where(lo[live] < hi[live], length[live] + 1, -1)
            if back < SPAN:
                length[live[lost]] = -1
            hit = live[length[live] == SPAN]
            first[begin[hit + 1] - back], last[begin[hit + 1] - back] = lo[hit], hi[hit]
        windows = [slice(begin[k], max(begin[k], begin[k + 1] - SPAN + 1)) for k in range(len(n))]
        return [(first[w], last[w]) for w in windows]
