"""Words of many texts at once, as places in one flat byte array."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15


def lower_ascii(flat: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    upper = (flat >= 0x41) & (flat <= 0x5A)
    return flat + (upper.astype(np.uint8) << 5)


def word_spans(flat: np.ndarray, borders: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that `inside` (256 flags) allows, text by text."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = inside[flat]
    fresh = np.zeros(n + 1, bool)
    fresh[borders] = True
    starts = held.copy()
    starts[1:] &= ~held[:-1] | fresh[1:n]
    ends = held.copy()
    ends[:-1] &= ~held[1:] | fresh[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class SpanHasher:
    """64-bit hashes of byte spans; equal bytes give equal hashes on every machine."""

    def __init__(self):
        self.powers = np.zeros(0, np.uint64)

    def __call__(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of spans in ascending order that do not overlap, each of one byte or more."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        lengths = ends - starts
        longest = int(lengths.max())
        if len(self.powers) < longest:
            powers = np.full(max(64, longest), _MULTIPLIER, np.uint64)
            powers[0] = 1
            self.powers = np.multiply.accumulate(powers)
        sizes = lengths.astype(np.int64)
        first = np.cumsum(sizes) - sizes
        within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        taken = flat[np.repeat(starts, sizes) + within].astype(np.uint64) + np.uint64(7)
        sums = np.add.reduceat(taken * self.powers[within], first)
        return mixed(sums, lengths.astype(np.uint64))


def mixed(values: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One well-spread 64-bit number from two."""
    out = values ^ (values >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9) + more
    out ^= out >> np.uint64(32)
    out = out * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))
