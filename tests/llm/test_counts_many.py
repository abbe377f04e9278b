"""Trees of many texts: what the worker does not remember goes to the library in few calls; leaves equal the library's."""

import random

import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from junctura.llm import bpe, token_counts
from junctura.llm.token_store import tokenizer


class Counting:
    def __init__(self, lib: Tokenizer) -> None:
        self.lib, self.calls = lib, 0
        lib.encode_special_tokens = True

    def encode_batch_fast(self, *a, **k):
        self.calls += 1
        return self.lib.encode_batch_fast(*a, **k)


@pytest.mark.parametrize("block, memo, join, calls", [(1 << 17, 1_000_000, 64, 4), (200, 40, 1, None), (1, 0, 1, None)])
def test_leaves_of_many_texts_by_few_calls(monkeypatch, block, memo, join, calls):
    for name, value in (("MEMO_SIZES", memo), ("JOIN_LEAST", join)):
        monkeypatch.setattr(bpe, name, value, raising=False)
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", block, raising=False)
    path, pattern = tokenizer()
    code, find, lib = bpe.Coder(path, pattern), regex.compile(pattern).findall, Tokenizer.from_file(path)
    code.tokenizer = Counting(code.tokenizer)
    lib.encode_special_tokens = True
    monkeypatch.setattr(token_counts, "coder", lambda *_: code)
    rng = random.Random(7)
    cells = [" ", "  ", "\n", " a", " é", " ŋord", "'s", " <|endoftext|>", "<|endoftext|>", " 12", "½", " 中文", "　", "🙂", ".", "\xa0x", "\x1c", " ª"]
    word = lambda: "".join(rng.choices("abcdeforst", k=rng.randrange(1, 9)))
    texts = ["".join(rng.choice([" " + word(), " " + word(), rng.choice(cells)]) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "x" * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    for _ in range(2):  # the second time from what is remembered
        made = token_counts._built(batch, tokenizer())
        for t, chars, tokens in zip(texts, made["chars"], made["tokens"], strict=True):
            parts = find(t or "")
            assert token_counts.unpack(chars).tolist() == [len(x) for x in parts]
            assert token_counts.unpack(tokens).tolist() == [len(lib.encode(x, add_special_tokens=False).ids) for x in parts]
            assert token_counts.unpack(tokens).sum() == len(lib.encode(t or "", add_special_tokens=False).ids)
        if calls:
            assert code.tokenizer.calls <= calls
