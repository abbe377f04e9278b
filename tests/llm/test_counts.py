"""Counts of pre-tokens beyond Latin letters: many at once, remembered, equal to one at a time."""

import random

import regex

from junctura.llm import bpe
from junctura.llm.token_store import tokenizer


def test_counts_of_wide_texts(monkeypatch):
    path, pattern = tokenizer()
    code, find = bpe.Coder(path, pattern), regex.compile(pattern).findall
    rng = random.Random(3)
    cells = ["a", "b", " ", "  ", "é", "—", "中", "文", "\n", "1", "'s", "<|endoftext|>", "🙂", "ض", "　", "x"]
    monkeypatch.setattr(bpe, "MEMO_ROWS", 500)
    for _ in range(2000):
        text = "".join(rng.choices(cells, k=rng.randrange(40)))
        parts = find(text)
        assert code.counts(parts, text) == [len(code.ids(x)) for x in parts]
