"""Features of media columns, and very long texts, by plain loops."""

import hashlib
import random
import struct
import zlib

from junctura.llm import chat, media

SCHEMA = "doc_id long, text string, feature string"


def by_hand(text, file):
    """The digest columns of one text, from its bytes and from the header of its file."""
    data = (text or "").encode()
    n = max(1, -(-len(data) // 576))
    payload = data + b"\xff" * (n * 576 - len(data))
    assert file[:4] == b"RIFF" and struct.unpack("<I", file[4:8])[0] == len(file) - 8 and file[24:28] == b"avih"
    tick = struct.unpack("<I", file[32:36])[0] / 1e6
    shares = []
    for i in range(n):
        bins = [0] * 16
        for b in payload[i * 576 : i * 576 + 576]:
            bins[b // 16] += 1
        shares.append([x / 576 for x in bins])
    cuts, past = [0], []
    for i in range(1, n):
        change = sum(abs(a - b) for a, b in zip(shares[i], shares[i - 1], strict=True)) / 2
        recent = past[-8:]
        mean = sum(recent) / len(recent) if recent else 0.0
        dev = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if change > max(0.2, mean + 3 * dev):
            cuts.append(i)
            past = []
        else:
            past.append(change)
    feature = f"frames={n};mean={sum(payload) / len(payload):.3f};clips={','.join(f'{c * tick:.2f}' for c in cuts)}"
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature, len(cuts)


def test_features_by_hand(spark):
    rng = random.Random(7)
    scenes = ["~" * 576 * 3 + "!" * 576 * 2 + "ab" * 288, "".join(rng.choice("az é0~") * rng.randrange(1, 700) for _ in range(60)), "日本語 " * 900]
    noisy = ["".join(rng.choices("abcdefgh ÿ~0", k=rng.randrange(20_000))) for _ in range(12)]
    texts = [None, "", "x", "y" * 576, "y" * 577, *scenes, *noisy, scenes[0], "long text " * 300_000]
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], SCHEMA)
    files = {r.id: bytes(r.media) for r in media.encode_media(docs).collect()}
    got = {r.doc_id: tuple(r)[1:] for r in media.media_digests(docs).collect()}
    assert got == {i: by_hand(t, files[i]) for i, t in enumerate(texts)}
    assert got[5][-1] == 3 and got[5] == got[len(texts) - 2]


def test_long_conversations(spark):
    text = "</turn> <turn \\l " + "very long " * 200_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", text if i == 1 else f"turn {i} <") for i in range(400)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert out.ok and [(t.role, t.text) for t in out.turns] == [(r, t) for _, _, r, t in rows] and len(out.loss_spans) == 200
