"""Words and word shingles of many texts at once, as 64-bit hashes, by numpy over the joined bytes."""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64
#: Odd multipliers of the words of a shingle and of the polynomial over a word's bytes.
BASE = 0x9E3779B97F4A7C15
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values that are the same on every machine."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(BASE)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def mix(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> U64(33))
    z = z * U64(0xFF51AFD7ED558CCD)
    z ^= z >> U64(29)
    return z


#: Bytes that are hashed at once; powers start anew there, so that a long text costs no more memory.
BLOCK = 1 << 18


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(BLOCK, BASE, U64), np.full(BLOCK, inverse, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


@functools.lru_cache(maxsize=2)
def _tables(letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """By byte: its random value in lower case (A-Z only), and whether it belongs to a word."""
    low = np.arange(256)
    low[65:91] += 32
    inside = np.ones(256, bool)
    if letters_only:
        inside[:128] = False
        inside[48:58] = inside[65:91] = inside[97:123] = True
    else:
        inside[list(SPACES)] = False
    return splitmix(256, 11)[low], inside


def word_hashes(texts: list[bytes], letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end): A-Z count as a-z.

    Words are runs of non-space bytes or, with ``letters_only``, runs of ASCII letters, digits and non-ASCII.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    value, inside = _tables(letters_only)
    up, down = _powers()
    starts, stops, sums = [], [], []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        edge = np.diff(inside[part].astype(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(value[part] * up[: len(part)], out=total[1:])
        starts.append(a + at)
        stops.append(b + at)
        sums.append((total[b] - total[a]) * down[a])
    start, stop, hashes = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((starts, np.int64), (stops, np.int64), (sums, U64)))
    whole = np.ones(len(start), bool)
    whole[1:] = start[1:] != stop[:-1]
    first = np.flatnonzero(whole)
    for i in np.flatnonzero(~whole).tolist():  # a word that goes on in the next block: one for each block at most
        begin = int(start[first[np.searchsorted(first, i) - 1]])
        hashes[i : i + 1] *= U64(pow(BASE, int(start[i]) - begin, 1 << 64))
    hashes = mix(np.add.reduceat(hashes, first)) if len(first) else hashes
    start = start[first]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.concatenate([[0], np.searchsorted(start, ends)])


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words; fewer words are one run."""
    words, first = word_hashes(texts)
    scale = splitmix(size, 77) | U64(1)
    runs = np.zeros(max(0, len(words) - size + 1), U64)
    for k in range(size):
        runs += words[k : len(words) - size + 1 + k] * scale[k]
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mix((words[a:b] * scale[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out
