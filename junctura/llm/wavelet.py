"""A Huffman-shaped wavelet matrix of token ids, and its file format.

Each id has a Huffman code over the ids' frequencies in this sequence, so that all planes together hold the sequence in
about its zero-order entropy. Level 0 holds the first code bit of each id in order; each next level holds the next bit of those
whose code goes on, in the order of a stable partition by the bit before (zeros first). Codes are dealt so that at each
level those that end stand last: they are cut off, and places of the others are not moved by it. Rank over a
level's bits leads from a place to its place on the next level, so one structure answers access (id at a place), rank (how
often an id occurs before a place), select (where the k-th occurrence is) and all places of an id.

File: magic ``WVM2``; little-endian int64 n, levels, documents, distinct ids; the distinct ids (uint32) in the order of their
codes' ends (level, then place), their code lengths (uint8) and frequencies (uint32); for each level its size and
zeros (int64), its packed bits, and a running count of ones for every 512 bits (uint32); then document ids and starts (int64 each,
one more start than documents).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

MAGIC = b"WVM2"
ROW = 512


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of symbols with these counts; a single symbol has length 1."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, np.int64)
    for node in range(n, 2 * n - 1):
        c, a = heapq.heappop(heap)
        d, b = heap[0]
        parent[a] = parent[b] = node
        heapq.heapreplace(heap, (c + d, node))
    depth = np.zeros(2 * n - 1, np.int64)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return depth[:n]


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Codes of symbols with ascending ``lengths``, first bit lowest: of each level's nodes, by their reversed codes, the last ones end."""
    out = np.zeros(len(lengths), np.uint64)
    nodes, at = np.zeros(1, np.uint64), 0
    for level in range(int(lengths.max(initial=0))):
        nodes = np.concatenate([nodes, nodes | np.uint64(1 << level)])
        k = int(np.searchsorted(lengths, level + 1, "right")) - at
        out[at : at + k] = nodes[len(nodes) - k :]
        nodes, at = nodes[: len(nodes) - k], at + k
    return out


def parted(values: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Stable partition of ``values`` by a bit each, zeros first (places, not masks: masks of random bits are slow to follow)."""
    return np.concatenate([np.compress(~one, values), np.compress(one, values)])


class Plane:
    """Bits of a level with rank and select."""

    def __init__(self, size: int, zeros: int, bits: np.ndarray, counts: np.ndarray) -> None:
        self.size, self.zeros, self.bits, self.counts = size, zeros, bits, counts

    @classmethod
    def of(cls, one: np.ndarray) -> Plane:
        bits = np.packbits(one, bitorder="little")
        row = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), ROW // 8), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        counts = np.concatenate([[0], np.cumsum(row)]).astype("<u4")
        return cls(len(one), len(one) - int(counts[-1]), bits, counts)

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=self.size, bitorder="little").view(bool)

    def bit(self, at: int) -> int:
        return int(self.bits[at >> 3]) >> (at & 7) & 1

    def rank1(self, at: int) -> int:
        row = at // ROW
        part = np.unpackbits(self.bits[row * ROW // 8 : -(-at // 8)], bitorder="little")[: at - row * ROW]
        return int(self.counts[row]) + int(part.sum())

    def down(self, bit: int, at: int) -> int:
        """Place on the next level."""
        ones = self.rank1(at)
        return self.zeros + ones if bit else at - ones

    def up(self, at: int) -> int:
        """Place on this level of what stands at ``at`` on the next one."""
        bit = int(at >= self.zeros)
        k = at - self.zeros if bit else at
        counts = self.counts.astype(np.int64)
        counts = counts if bit else np.arange(len(counts)) * ROW - counts
        row = int(np.searchsorted(counts, k, "right")) - 1
        part = np.unpackbits(self.bits[row * ROW // 8 : (row + 1) * ROW // 8], bitorder="little")
        return row * ROW + int(np.flatnonzero(part == bit)[k - int(counts[row])])


class WaveletMatrix:
    def __init__(self, n: int, planes: list[Plane], symbols: np.ndarray, lengths: np.ndarray, freqs: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        self.n, self.planes, self.symbols, self.lengths, self.freqs, self.ids, self.starts = n, planes, symbols, lengths, freqs, ids, starts
        self.codes = code_words(lengths)
        self.number = {s: i for i, s in enumerate(symbols.tolist())}
        #: By level: the first symbol that ends there; by symbol: occurrences of the symbols before it.
        self.first = np.searchsorted(lengths, np.arange(len(planes) + 2))
        self.before = np.concatenate([[0], np.cumsum(freqs.astype(np.int64))])

    def ended(self, level: int) -> int:
        """How many occurrences end with their ``level``-th bit."""
        return int(self.before[self.first[level + 1]] - self.before[self.first[level]])

    def kept(self, level: int) -> int:
        """How many go on to ``level``."""
        return self.planes[level].size if level < len(self.planes) else 0

    @classmethod
    def build(cls, tokens: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> WaveletMatrix:
        counts = np.bincount(tokens, minlength=1) if len(tokens) else np.zeros(0, np.int64)
        symbols = np.flatnonzero(counts)
        lengths = code_lengths(counts[symbols])
        order = np.argsort(lengths, kind="stable")
        symbols, lengths = symbols[order], lengths[order]
        self = cls(len(tokens), [], symbols.astype("<u4"), lengths, counts[symbols], np.asarray(ids, np.int64), np.asarray(starts, np.int64))
        codes = np.zeros(len(counts), np.uint64)
        codes[symbols] = self.codes
        levels = int(lengths.max(initial=0))
        self.first = np.searchsorted(lengths, np.arange(levels + 2))
        now = codes[tokens] if len(tokens) else np.zeros(0, np.uint64)
        if levels <= 32:
            now = now.astype(np.uint32)
        for level in range(levels):
            one = (now & now.dtype.type(1 << level)) != 0
            self.planes.append(Plane.of(one))
            now = parted(now, one)
            now = now[: len(now) - self.ended(level + 1)]
        return self

    def dump(self) -> bytes:
        parts = [MAGIC, np.array([self.n, len(self.planes), len(self.ids), len(self.symbols)], "<i8").tobytes()]
        parts += [self.symbols.astype("<u4").tobytes(), self.lengths.astype(np.uint8).tobytes(), self.freqs.astype("<u4").tobytes()]
        for p in self.planes:
            parts += [np.array([p.size, p.zeros], "<i8").tobytes(), p.bits.tobytes(), p.counts.astype("<u4").tobytes()]
        return b"".join([*parts, self.ids.astype("<i8").tobytes(), self.starts.astype("<i8").tobytes()])

    @classmethod
    def load(cls, data: bytes) -> WaveletMatrix:
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a wavelet matrix")
        at = 4

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        n, levels, docs, distinct = take("<i8", 4).tolist()
        symbols, lengths, freqs = take("<u4", distinct), take("<u1", distinct).astype(np.int64), take("<u4", distinct)
        planes = []
        for _ in range(levels):
            size, zeros = take("<i8", 2).tolist()
            planes.append(Plane(size, zeros, take("<u1", -(-size // 8)), take("<u4", -(-size // ROW) + 1)))
        return cls(n, planes, symbols, lengths, freqs, take("<i8", docs), take("<i8", docs + 1))

    def tokens(self) -> np.ndarray:
        """All ids in order: every place goes down the levels, until its code ends."""
        out = np.zeros(self.n, np.uint32)
        place = np.arange(self.n, dtype=np.uint32)
        for level, plane in enumerate(self.planes):
            one = plane.unpacked()
            place = parted(place, one)
            keep = len(place) - self.ended(level + 1)
            a, b = self.first[level + 1], self.first[level + 2]
            out[place[keep:]] = np.repeat(self.symbols[a:b], self.freqs[a:b])
            place = place[:keep]
        return out

    def access(self, at: int) -> int:
        for level, plane in enumerate(self.planes):
            at = plane.down(plane.bit(at), at)
            keep = self.kept(level + 1)
            if at >= keep:
                place = self.before[self.first[level + 1]] + at - keep
                return int(self.symbols[np.searchsorted(self.before, place, "right") - 1])
        raise IndexError(at)

    def rank(self, token: int, at: int) -> int:
        """How often ``token`` occurs before place ``at``."""
        i = self.number.get(token)
        if i is None:
            return 0
        lo, hi, code = 0, at, int(self.codes[i])
        for level in range(int(self.lengths[i])):
            bit = code >> level & 1
            lo, hi = self.planes[level].down(bit, lo), self.planes[level].down(bit, hi)
        return hi - lo

    def _end(self, i: int) -> int:
        """Place behind its last level of the first occurrence of the i-th symbol."""
        length = int(self.lengths[i])
        return self.kept(length) + int(self.before[i] - self.before[self.first[length]])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of ``token``, or -1."""
        i = self.number.get(token)
        if i is None or not 0 <= k < self.freqs[i]:
            return -1
        at = self._end(i) + k
        for level in range(int(self.lengths[i]) - 1, -1, -1):
            at = self.planes[level].up(at)
        return at

    def places(self, token: int) -> np.ndarray:
        """All places of ``token``, ascending: selects of all its occurrences, a level at a time."""
        i = self.number.get(token)
        if i is None:
            return np.zeros(0, np.int64)
        at = self._end(i) + np.arange(int(self.freqs[i]))
        for level in range(int(self.lengths[i]) - 1, -1, -1):
            plane = self.planes[level]
            bit = int(self.codes[i]) >> level & 1
            at = np.flatnonzero(plane.unpacked() == bool(bit))[at - plane.zeros if bit else at]
        return at

    def documents(self) -> Iterator[tuple[int, int, int]]:
        """(document id, start, end)"""
        return zip(self.ids.tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)
