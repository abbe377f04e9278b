"""Luma of baseline JPEG frames, as cameras and other programs write them into AVI files.

Sequential Huffman frames of 8 bits (SOF0, SOF1) with any size, components, sampling, and restart intervals; the frame must
bring its own Huffman tables. Everything else raises ValueError.
"""

from __future__ import annotations

import struct

import numpy as np

from junctura.llm.mjpeg import canonical

#: Row by row place of the k-th coefficient: along the diagonals, up and down by turns.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: symbol and code length, 0 for none."""
    table = [0] * (1 << 16)
    for symbol, code, n in canonical(counts, symbols):
        first = code << (16 - n)
        table[first : first + (1 << (16 - n))] = [symbol << 5 | n] * (1 << (16 - n))
    return table


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data.replace(b"\xff\0", b"\xff") + b"\xff" * 4, 0, 0
        self.end = 8 * (len(self.data) - 4)

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, table: list[int]) -> int:
        got = table[self.peek()]
        if not got or self.at > self.end:
            raise ValueError("bad Huffman code")
        self.at += got & 31
        return got >> 5

    def value(self, n: int) -> int:
        """A signed value of n bits as JPEG writes it."""
        if not n:
            return 0
        v = self.peek() >> (16 - n)
        self.at += n
        return v if v >> (n - 1) else v - (1 << n) + 1


def _block(bits: _Bits, dc: list[int], ac: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """(DC difference, (place, value) of the other coefficients)"""
    n = bits.symbol(dc)
    if n > 15:
        raise ValueError("bad DC code")
    diff, k, out = bits.value(n), 1, []
    while k < 64:
        s = bits.symbol(ac)
        if s == 0:
            break
        k += s >> 4
        if s & 15:
            if k > 63:
                raise ValueError("too many coefficients")
            out.append((ZIGZAG[k], bits.value(s & 15)))
        k += 1
    return diff, out


def decode_baseline(frame: bytes) -> np.ndarray:
    """(row, column) luma samples of a JPEG frame."""
    try:
        return _decode(frame)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("broken JPEG frame") from e


def _decode(frame: bytes) -> np.ndarray:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, huff, sof, every = 2, {}, {}, None, 0
    while True:
        while frame[at + 1] == 255:
            at += 1
        kind, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1):
            precision, high, wide, count = struct.unpack_from(">BHHB", body)
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)}
            if precision != 8 or not high or not wide:
                raise ValueError("not an 8-bit frame of known size")
            sof = high, wide, parts
        elif kind == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            break
        elif 0xC2 <= kind <= 0xCF:
            raise ValueError("not a baseline frame")
    if sof is None:
        raise ValueError("no frame head")
    high, wide, parts = sof
    scan = [(body[1 + 2 * i], huff[body[2 + 2 * i] >> 4], huff[16 | body[2 + 2 * i] & 15]) for i in range(body[0])]
    luma = next(iter(parts))
    if scan[0][0] != luma or len(scan) not in (1, len(parts)):
        raise ValueError("luma is not in the first scan")
    most_h, most_v = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
    h, v, table = parts[luma]
    if len(scan) == 1:  # blocks of a component by itself stand one by one, whatever its sampling
        h_mcu = v_mcu = 1
        across, down = -(-(-(-wide * h // most_h)) // 8), -(-(-(-high * v // most_v)) // 8)
    else:
        h_mcu, v_mcu = h, v
        across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    coefficients = np.zeros((down * v_mcu, across * h_mcu, 64))
    ends = []
    i = at
    while True:  # cut the coded data at restart marks
        i = frame.index(b"\xff", i) if b"\xff" in frame[i:] else len(frame)
        mark = frame[i + 1] if i + 1 < len(frame) else 0xD9
        if mark == 0:
            i += 2
        elif 0xD0 <= mark <= 0xD7:
            ends.append((at, i))
            at = i = i + 2
        else:
            ends.append((at, i))
            break
    total = across * down
    for k, first in enumerate(range(0, total, every or total)):
        bits = _Bits(frame[slice(*ends[k])])
        last = dict.fromkeys(parts, 0)
        for m in range(first, min(total, first + (every or total))):
            for name, dc, ac in scan:
                ph, pv, _ = parts[name] if len(scan) > 1 else (1, 1, 0)
                for y in range(pv):
                    for x in range(ph):
                        diff, others = _block(bits, dc, ac)
                        last[name] += diff
                        if name == luma:
                            cell = coefficients[m // across * v_mcu + y, m % across * h_mcu + x]
                            cell[0] = last[name]
                            for place, value in others:
                                cell[place] = value
    scale = np.zeros(64)
    scale[ZIGZAG] = quant[table]
    cos = _cosines()
    samples = cos.T @ (coefficients * scale).reshape(*coefficients.shape[:2], 8, 8) @ cos
    image = samples.transpose(0, 2, 1, 3).reshape(8 * coefficients.shape[0], -1)
    return np.clip(np.rint(image + 128), 0, 255).astype(np.uint8)[: -(-high * v // most_v), : -(-wide * h // most_h)]
