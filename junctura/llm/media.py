"""Media columns: AVI motion-JPEG files as binary values, decoded to timed clips.

``to_media`` stores bytes as the 8-bit samples of lossless JPEG frames in an AVI file (format: ``mjpeg``);
``clips_of`` parses any AVI file's RIFF index, decodes its intra frames (those lossless ones and baseline JPEG, of any size; see ``jpeg``)
and finds shots: a frame begins a new clip if its
sample histogram differs from that of the frame before by more than the mean of the last WINDOW differences
of its clip plus SPREAD deviations, and by FLOOR at least (ties do not begin one).

Null texts count as empty; equal texts give equal values; repeated rows and null ids are rows like others; no rows give no rows; other
columns are ignored. A null file has no clips; one that is no whole AVI file has one row with null clip columns; a frame that cannot be decoded
repeats the one before it, as players do (black before the first); a file without frames has no clips.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import blocks, documents, map_batches, texts_of
from junctura.llm.jpeg import decode_baseline
from junctura.llm.mjpeg import EOI, FRAME, SIDE, decode_frames, encode_frames, frame_head, head_size, read_avi, write_avi

BINS, WINDOW, SPREAD, FLOOR = 16, 8, 3.0, 0.2
BLOCK_BYTES = 1 << 20


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def payload(text: str | None) -> bytes:
    """UTF-8 of ``text`` with bytes 255 up to a positive multiple of a frame's samples."""
    return padded((text or "").encode())


def to_media(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, coded together."""
    head = frame_head()
    coded = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE))
    out, at = [], 0
    for p in payloads:
        n = len(p) // FRAME
        out.append(write_avi([head + x + EOI for x in coded[at : at + n]]))
        at += n
    return out


def from_media(files: list[bytes]) -> list[tuple[float, np.ndarray]]:
    """(seconds of a frame, samples (frame, row, column)) of each file of ``to_media``, decoded together."""
    read = [read_avi(x) for x in files]
    samples = decode_frames([f for _, frames in read for f in frames])
    out, at = [], 0
    for tick, frames in read:
        out.append((tick, samples[at : at + len(frames)]))
        at += len(frames)
    return out


def decode_any(frames: list[bytes]) -> list[np.ndarray]:
    """Samples (row, column) of each frame of a file: lossless ones together by their heads, baseline ones each; see above for others."""
    found: list[np.ndarray | None] = [None] * len(frames)
    heads: dict[bytes, list[int]] = {}
    for i, f in enumerate(frames):
        try:
            heads.setdefault(f[: head_size(f)], []).append(i)
        except ValueError:
            continue
    for ids in heads.values():
        try:
            together = decode_frames([frames[i] for i in ids])
            for i, x in zip(ids, together, strict=True):
                found[i] = x
        except ValueError:
            for i in ids:
                found[i] = decode_one(frames[i])
    last = np.zeros((1, 1), np.uint8)
    out = []
    for x in found:
        last = last if x is None else x
        out.append(last)
    return out


def decode_one(frame: bytes) -> np.ndarray | None:
    for decode in (lambda f: decode_frames([f])[0], decode_baseline):
        try:
            return decode(frame)
        except ValueError:
            continue
    return None


def histograms(frames: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """(frame, bin) shares of samples."""
    return np.array([np.bincount(x.reshape(-1) >> 4, minlength=BINS) / max(1, x.size) for x in frames]).reshape(-1, BINS)


def shots(frames: list[np.ndarray] | np.ndarray) -> list[int]:
    """First frames of the clips."""
    if len(frames) < 2:
        return list(range(len(frames)))
    change = (np.abs(np.diff(histograms(frames), axis=0)).sum(axis=1) / 2).tolist()
    out, past = [0], []
    for i, x in enumerate(change, 1):
        mean = sum(past) / len(past) if past else 0.0
        dev = (sum((y - mean) ** 2 for y in past) / len(past)) ** 0.5 if past else 0.0
        if x > max(FLOOR, mean + SPREAD * dev):
            out.append(i)
            past = []
        else:
            past = [*past[1 - WINDOW :], x]
    return out


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): the AVI file of each row's text."""

    def make(batch: pa.RecordBatch) -> dict:
        out = []
        for _, part in blocks(map(padded, texts_of(batch.column(1))), BLOCK_BYTES):
            out += to_media(part)
        return {"id": batch.column(0), "media": out}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id", "text"], make, "id long, media binary")


def clips_of(media: DataFrame) -> DataFrame:
    """(id, clip, first_frame, frames, start_s, end_s): the timed clips of each file of (id, media)."""

    def make(batch: pa.RecordBatch) -> dict:
        rows = []
        for key, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not file.is_valid:
                continue
            try:
                tick, frames = read_avi(file.as_py())
            except ValueError:
                rows.append((key, None, None, None, None, None))
                continue
            cuts = [*shots(decode_any(frames)), len(frames)]
            rows += [(key, n, a, b - a, a * tick, b * tick) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        names = ("id", "clip", "first_frame", "frames", "start_s", "end_s")
        return dict(zip(names, zip(*rows, strict=True) if rows else [[]] * 6, strict=True))

    return map_batches(media.select("id", "media"), ["id", "media"], make, "id long, clip int, first_frame int, frames int, start_s double, end_s double")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest columns of each row's file and of what is read back from its bytes; files stay in the task."""

    def make(batch: pa.RecordBatch) -> dict:
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clips")
        rows = []
        for _, part in blocks(map(padded, texts_of(batch.column(1))), BLOCK_BYTES):
            files = to_media(part)
            for file, (tick, samples) in zip(files, from_media(files), strict=True):
                back = samples.tobytes()
                cuts = shots(samples)
                times = ",".join(f"{a * tick:.2f}" for a in cuts)
                rows.append((len(back.rstrip(b"\xff")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"frames={len(samples)};mean={samples.mean():.3f};clips={times}", len(cuts)))
        return {"doc_id": batch.column(0)} | dict(zip(names, zip(*rows, strict=True), strict=True))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips int"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id", "text"], make, schema)


def op9_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))
