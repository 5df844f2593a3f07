"""Canonical Huffman codes of limited length, and coding of whole arrays of ids at once."""

from __future__ import annotations

import numpy as np

MAX_BITS = 16


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each id's code, 0 for ids that don't occur; the shortest total of all prefix codes
    whose codes have at most ``max_bits`` bits (package-merge).

    A single id gets one bit.  More ids than the bits can tell apart are refused.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit codes of {max_bits} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    merged, are_leaves = weights, []
    for _ in range(max_bits):
        are_leaves.append(None)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1) if are_leaves[:-1] else np.empty(0)
        both = np.concatenate((weights, pairs))
        sorting = np.argsort(both, kind="stable")
        merged, are_leaves[-1] = both[sorting], sorting < n
    # From the last level down: leaves among the chosen items are the smallest ids, and each
    # chosen package stands for two items of the level before.
    chosen, bits = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for leaves in reversed(are_leaves):
        k = int(leaves[:chosen].sum())
        bits[:k] += 1
        chosen = 2 * (chosen - k)
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: in order of length, then id, counting up."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        of = np.flatnonzero(lengths == bits)
        codes[of] = code + np.arange(len(of))
        code = (code + len(of)) << 1
    return codes


class Encoder:
    def __init__(self, lengths: np.ndarray) -> None:
        self._bits, self._codes = lengths.astype(np.int64), canonical_codes(lengths).astype(np.int64)

    def encode(self, ids: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
        """The bits, highest first, and the bit offset of every ``every``-th id."""
        bits = self._bits[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        # each code lies within three bytes; no two codes share a bit, so adding sets them
        shifted = self._codes[ids] << (24 - bits - (starts & 7))
        size = (int(ends[-1]) + 7) // 8 if len(ids) else 0
        out = np.zeros(size + 3, dtype=np.float64)
        at = starts >> 3
        for k, part in enumerate((shifted >> 16, shifted >> 8 & 255, shifted & 255)):
            sums = np.bincount(at, part, minlength=size)
            out[k:k + len(sums)] += sums
        return out[:size].astype(np.uint8).tobytes(), starts[::every]


class Decoder:
    """Decodes by one table look-up per id, all checkpoints of the given blocks in step."""

    def __init__(self, lengths: np.ndarray) -> None:
        self._width = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        entries = (used.astype(np.uint32) << 8) | lengths[used]
        self._table = np.zeros(1 << self._width, dtype=np.uint32)
        filled = np.repeat(entries, 1 << (self._width - lengths[used].astype(np.int64)))
        self._table[: len(filled)] = filled

    def decode(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All ids: ``counts[i]`` of them from bit ``starts[i]`` on, one lane after the other."""
        raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
        window = raw[:-3] << 16 | raw[1:-2] << 8 | raw[2:-1]
        steps = int(counts.max(initial=0))
        at, last = starts.astype(np.int64), 8 * len(data)
        out = np.empty((steps, len(starts)), dtype=np.uint32)
        low, mask = 24 - self._width, (1 << self._width) - 1
        for i in range(steps):
            found = self._table[window[at >> 3] >> (low - (at & 7)).astype(np.uint32) & mask]
            out[i] = found
            at = np.minimum(at + (found & 255), last)
        ids = out.T >> 8
        return ids[np.arange(steps) < counts[:, None]]
