"""Lossless JPEG frames in AVI files, many at a time.

A frame is a lossless JPEG (SOF3, one 8-bit component, predictor 1): each sample is coded as its difference to
its left neighbour (in the first column to the one above, at first to 128), a Huffman code for the number of
bits of the difference and then these bits. Encoder and decoder work on all frames of a batch side by side: the
decoder takes one sample of every frame a step, reading code and bits with one table look-up.

An AVI file holds ``hdrl`` (avih, one MJPG video stream), ``movi`` with one ``00dc`` chunk a frame, and ``idx1``.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass

import numpy as np

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Code lengths by number of difference bits (0 to 8); all alike, so a code is the number itself.
CODE_BITS = (4,) * 9
EOI = b"\xff\xd9"


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">HH", 0xFF00 | kind, len(body) + 2) + body


def frame_head() -> bytes:
    counts = bytes(CODE_BITS.count(n) for n in range(1, 17))
    order = bytes(sorted(range(9), key=lambda k: CODE_BITS[k]))
    return b"\xff\xd8" + _marker(0xC3, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _marker(0xC4, b"\0" + counts + order) + _marker(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def canonical(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as JPEG writes it."""
    out, code, at = [], 0, 0
    for n, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            out.append((symbol, code, n))
            code += 1
        at += count
        code <<= 1
    return out


@functools.cache
def _coding() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: code and bits together, and their length."""
    codes = {s: (c, n) for s, c, n in canonical(bytes(CODE_BITS.count(n) for n in range(1, 17)), bytes(sorted(range(9), key=lambda k: CODE_BITS[k])))}
    word, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code, n = codes[k]
        word[d + 255], size[d + 255] = code << k | (d if d >= 0 else d + (1 << k) - 1), n + k
    return word, size


@functools.lru_cache(maxsize=8)
def _decoding(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: difference * 32 + bits used."""
    table = np.full(1 << 16, 1 << 30, np.int32)
    for k, code, n in canonical(counts, symbols):
        if n + k > 16:
            raise ValueError("codes with their bits exceed 16 bits")
        for bits in range(1 << k):
            d = bits if not k or bits >> (k - 1) else bits - (1 << k) + 1
            first = (code << k | bits) << (16 - n - k)
            table[first : first + (1 << (16 - n - k))] = d * 32 + n + k
    return table


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each frame; samples: (frame, row, column)."""
    f = len(samples)
    if not f:
        return []
    now = samples.astype(np.int16)
    diff = np.empty_like(now)
    diff[:, :, 1:] = now[:, :, 1:] - now[:, :, :-1]
    diff[:, 1:, 0] = now[:, 1:, 0] - now[:, :-1, 0]
    diff[:, 0, 0] = now[:, 0, 0] - 128
    diff = diff.reshape(f, FRAME) + 255
    word, size = _coding()
    size = size[diff]
    end = np.cumsum(size, axis=1)
    wide = (end[:, -1] + 7) // 8
    begin = np.concatenate([[0], np.cumsum(wide)])
    at = end - size + begin[:-1, None] * 8
    placed = word[diff] << (24 - size - (at & 7)).astype(np.uint32)
    byte = (at >> 3).reshape(-1)
    placed = placed.reshape(-1)
    n = int(begin[-1])
    data = np.zeros(n + 3, np.int64)
    for k in range(3):
        data[k : k + n] += np.bincount(byte, (placed >> np.uint32(16 - 8 * k)) & np.uint32(255), n).astype(np.int64)[:n]
    data = data[:n].astype(np.uint8)
    data[begin[1:] - 1] |= ((1 << (wide * 8 - end[:, -1])) - 1).astype(np.uint8)
    stuffed = np.flatnonzero(data == 255)
    data = np.insert(data, stuffed + 1, 0).tobytes()
    edges = (begin + np.searchsorted(stuffed, begin)).tolist()
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


@dataclass(frozen=True)
class Head:
    rows: int
    columns: int
    counts: bytes
    symbols: bytes
    size: int


@functools.lru_cache(maxsize=64)
def parse_head(head: bytes) -> Head:
    """Checks that a frame's markers up to SOS are those of a lossless frame that this decoder reads."""
    at, seen = 2, {}
    while at < len(head):
        kind, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        seen[kind] = head[at + 4 : at + 2 + size]
        at += 2 + size
    sof, table = seen.get(0xC3, b""), seen.get(0xC4, b"")
    if head[:2] != b"\xff\xd8" or len(sof) != 9 or sof[0] != 8 or sof[5] != 1 or seen.get(0xDA, b"")[3:] != b"\1\0\0" or len(table) < 18 or 0xDD in seen:
        raise ValueError("not a lossless JPEG frame of one 8-bit component and predictor 1")
    return Head(*struct.unpack_from(">HH", sof, 1), table[1:17], table[17:], at)


def head_size(frame: bytes) -> int:
    """Bytes of a frame up to its coded data."""
    sos = frame.find(b"\xff\xda")
    if sos < 0 or len(frame) < sos + 4:
        raise ValueError("no scan")
    return sos + 2 + struct.unpack_from(">H", frame, sos + 2)[0]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (frame, row, column) of lossless JPEG frames that have one head."""
    f = len(frames)
    if not f:
        return np.zeros((0, SIDE, SIDE), np.uint8)
    size = head_size(frames[0])
    head = frames[0][:size]
    parsed = parse_head(head)
    if any(x[:size] != head or x[-2:] != EOI for x in frames):
        raise ValueError("frames differ in their heads")
    count = parsed.rows * parsed.columns
    parts = [x[size:-2] for x in frames]
    data = np.frombuffer(b"".join(parts), np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[:-1] != 255) | (data[1:] != 0)
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    begin = begin - np.searchsorted(np.flatnonzero(~keep), begin)
    data = np.concatenate([data[keep], np.full(4, 255, np.uint8)]).astype(np.uint32)
    window = data[:-3] << np.uint32(16) | data[1:-2] << np.uint32(8) | data[2:-1]
    table = _decoding(parsed.counts, parsed.symbols)
    at = begin[:-1] * 8
    diff = np.empty((count, f), np.int32)
    for k in range(count):
        peek = window[np.minimum(at >> 3, len(window) - 1)] >> (8 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)
        got = table[peek]
        diff[k] = got
        at += got & 31
    if np.any((at + 7) // 8 != begin[1:]) or np.any(diff == 1 << 30):
        raise ValueError("frame data ends early or late")
    diff = (diff >> 5).T.reshape(f, parsed.rows, parsed.columns)
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    return np.cumsum(diff, axis=2).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, max(map(len, frames), default=0), SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    parts, index, at = [b"movi"], [], 4
    for x in frames:
        chunk = _chunk(b"00dc", x)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        parts.append(chunk)
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(seconds of a frame, video frames in order) by the file's index, or by its chunks if it has none; ValueError if it is no whole AVI file.

    Index offsets may count from the ``movi`` list or from the file's start.
    """
    try:
        return _read_avi(data)
    except (struct.error, IndexError) as e:
        raise ValueError("broken AVI file") from e


def _read_avi(data: bytes) -> tuple[float, list[bytes]]:
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, stop, index, tick = 12, 0, 0, None, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi, stop = at + 8, at + 8 + size
        elif name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            tick = struct.unpack_from("<I", data, at + 20)[0]
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if not movi or stop > len(data):
        raise ValueError("no whole list of frames")
    places = []
    if index:
        entries = [(name, place, size) for name, _, place, size in struct.iter_unpack("<4sIII", index)]
        base = 0 if entries and data[entries[0][1] : entries[0][1] + 4] == entries[0][0] and entries[0][1] >= movi else movi
        places = [(base + place + 8, size) for name, place, size in entries if name[2:] in (b"dc", b"db")]
    else:
        at = movi + 4
        while at + 8 <= stop:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                at += 12
                continue
            if name[2:] in (b"dc", b"db"):
                places.append((at + 8, size))
            at += 8 + size + (size & 1)
    if any(a + n > len(data) for a, n in places):
        raise ValueError("a frame lies outside the file")
    return tick / 1e6, [data[a : a + n] for a, n in places]
