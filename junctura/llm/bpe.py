"""Byte-level encoding with the tokenizers library and a public tokenizer file.

All ids come from the library. It splits a text into pre-tokens before it merges, so a text's ids are those of its
pre-tokens one after another.

Many texts at once (``encode``) are cut before each space that follows a character which nobody takes for white space: a
pre-token holds white space only at its start or throughout, so one always ends there. Texts are taken in blocks; a block's
distinct pieces that the worker does not remember (bounded; started anew when full and of little help) are joined again and encoded, and the ids' byte lengths tell
where each piece ends. Texts with other white space before a space, or with a special token's content, go to the library whole.

Single pre-tokens: the library encodes only those that are not in the worker's memo (bounded; started anew when full). ``counts`` takes those of many texts at
once; Latin words with a space before them are joined as above, others go to the library each by itself, many a call. ``ids`` cuts texts in Latin letters by the file's pattern; other
texts, whose letters two Unicode versions might class differently, go to the library whole. Tests hold all of it against the unchanged library.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from junctura.llm.common import resident

OTHER = re.compile("[^\x00-ɏ]")
#: Pre-tokens of which a worker remembers the ids, and of which it remembers their number.
MEMO_ROWS, MEMO_SIZES = 250_000, 1_000_000
#: New pre-tokens from which on words among them are joined.
JOIN_LEAST = 64
#: Text that ends in what some Unicode version takes for white space or a control.
BLANK_END = r"[\x{0}-\x{20}\x{7f}-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]\z"
#: Bytes of distinct pieces in one call of the library.
CALL_BYTES = 256 << 10
#: Bytes of text that are cut into pieces at once (or one longer text), and pieces to remember.
BLOCK_BYTES, MEMO_PIECES = 8 << 20, 600_000


class Coder:
    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}
        self._forget()
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # one character of a byte-level token is one byte
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each pre-token."""
        memo = self.memo
        new = list({x for x in parts if x not in memo})
        if new:
            if len(memo) + len(new) > MEMO_ROWS:
                memo.clear()
                new = list(set(parts))
            for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                memo[x] = np.array(e.ids, "<u2").tobytes()
        return [memo[x] for x in parts]

    def _whole(self, text: str, ordinary: bool) -> bytes:
        self.tokenizer.encode_special_tokens = ordinary
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def counts(self, parts: list[str], text: str | None = None) -> list[int]:
        """Number of ids of each pre-token, special tokens' contents as ordinary text; ``text``, of which they may be, does not matter."""
        found = [*map(self.sizes.get, parts)]
        if None in found:
            self._learn({x for x, n in zip(parts, found, strict=True) if n is None}, parts)
            found = [self.sizes[x] if n is None else n for x, n in zip(parts, found, strict=True)]
        return found

    def _learn(self, new: set[str], parts: list[str]) -> None:
        """Remembers the number of ids of the pre-tokens ``new``, or of all ``parts`` where the memo is full and starts anew."""
        if len(self.sizes) + len(new) > MEMO_SIZES:
            self.sizes.clear()
            new = set(parts)
        self.tokenizer.encode_special_tokens = True
        if len(new) >= JOIN_LEAST:
            words = [x for x in new if x[:1] == " " and x[1:].isalpha() and not OTHER.search(x)]
            self.sizes.update(zip(words, self._pieces(pa.array([x[1:] for x in words], pa.string()))[1].tolist(), strict=True))
            new = new.difference(words)
        rest = [*new]
        self.sizes.update(zip(rest, map(len, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))

    def _forget(self) -> None:
        self.known, self.known_ids, self.known_sizes = pa.array([], pa.string()), np.zeros(0, "<u2"), np.zeros(0, np.int32)

    def _rows(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each of ``pieces``, ids of all rows, ids of each row): rows are the known pieces, then new ones."""
        row = pc.fill_null(pc.index_in(pieces, self.known), -1).to_numpy().copy()
        new = row < 0
        more = int(new.sum())
        full = len(self.known) + more > MEMO_PIECES
        if full and len(self.known) and 2 * more > len(pieces):  # what is known helps little here
            self._forget()
            return self._rows(pieces)
        row[new] = len(self.known) + np.arange(more)
        fresh = pieces.filter(pa.array(new))
        ids, sizes = self._pieces(fresh)
        ids, sizes = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_sizes, sizes.astype(np.int32)])
        if not full:
            self.known, self.known_ids, self.known_sizes = pa.concat_arrays([self.known, fresh]), ids, sizes
        return row, ids, sizes

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of ``pieces``, each with a space before it."""
        end = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        ids, sizes = [], []
        at = 0
        while at < len(pieces):
            before = end[at - 1] if at else 0
            after = max(at + 1, int(np.searchsorted(end, before + CALL_BYTES, "right")))
            text = " " + pc.binary_join(pa.ListArray.from_arrays([0, after - at], pieces[at:after]), " ")[0].as_py()
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
            reached, wanted = np.cumsum(self.bytes[found]), end[at:after] - before
            cuts = np.searchsorted(reached, wanted)
            if reached[-1] != wanted[-1] or (reached[cuts] != wanted).any():
                raise ValueError("the tokenizer does not keep a text's bytes and spaces")
            ids.append(found)
            sizes.append(np.diff(cuts, prepend=-1))
            at = after
        return np.concatenate([*ids, np.zeros(0, "<u2")]), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text) in the library's default setting: contents of added tokens become those tokens."""
        made = [(np.zeros(0, "<u2"), np.zeros(0, np.int64))]
        self.tokenizer.encode_special_tokens = False
        block, size = [], 0
        for text in texts:
            own = len(text.encode()) + 1
            if block and size + own > BLOCK_BYTES:
                made.append(self._block(block))
                block, size = [], 0
            block.append(text)
            size += own
        if block:
            made.append(self._block(block))
        pa.default_memory_pool().release_unused()
        ids, sizes = zip(*made, strict=True)
        return np.concatenate(ids), np.concatenate(sizes)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(texts, pa.string())
        whole = np.zeros(len(texts), bool)
        for a in self.added:
            whole |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", column), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.dictionary_encode()
        number = words.indices.to_numpy().copy()
        blank = pc.or_(pc.equal(words.dictionary, ""), pc.match_substring_regex(words.dictionary, BLANK_END)).to_numpy(zero_copy_only=False)
        bad = blank[number]
        bad[starts[1:] - 1] = False  # no space follows a text's last piece
        alone = lists.values.take(pa.array(starts[:-1])).to_pylist()  # no space stands before its first one
        bad[starts[:-1]] &= np.array([x != "" for x in alone], bool)
        whole |= np.add.reduceat(bad, starts[:-1], dtype=np.int64) > 0
        inner = np.repeat(~whole, np.diff(starts))
        inner[starts[:-1]] = False
        asked = np.zeros(len(blank), bool)
        asked[number[inner]] = True
        order = np.full(len(blank), -1)
        order[asked & ~blank], ids, sizes = self._rows(words.dictionary.filter(pa.array(asked & ~blank)))

        # one row of ids for each of these pieces and known ones, then one for each text that is encoded by itself: blank ends, heads, whole texts
        heads = [t if w else x for t, x, w in zip(texts, alone, whole.tolist(), strict=True)]
        ends = [" " + x for x in words.dictionary.filter(pa.array(asked & blank)).to_pylist()]
        place = {x: i for i, x in enumerate(dict.fromkeys(ends + heads), len(sizes))}
        found = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u2") for x in place]
        ids = np.concatenate([ids, *found])
        sizes = np.concatenate([sizes, np.array([len(x) for x in found], np.int32)])
        order[asked & blank] = [place[x] for x in ends]
        row = order[number]
        row[starts[:-1]] = [place[x] for x in heads]
        inner[starts[:-1]] = True
        row = row[inner]
        size = sizes[row]
        end = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        kind = np.int32 if max(end[-1], len(ids)) < 1 << 31 else np.int64
        at = np.repeat(((np.cumsum(sizes, dtype=np.int64) - sizes)[row] - end[:-1]).astype(kind), size)
        at += np.arange(len(at), dtype=kind)
        last = np.concatenate([[0], np.cumsum(np.add.reduceat(inner, starts[:-1], dtype=np.int64))])
        return ids[at], np.diff(end[last])

    def packed(self, text: str) -> bytes:
        """``encode`` of one text as little-endian 16-bit integers."""
        return self.encode([text])[0].tobytes()

    def library_ids(self, text: str) -> list[int]:
        return self.encode([text])[0].tolist()

    def ids(self, text: str) -> list[int]:
        """Ids with special tokens' contents as ordinary text."""
        data = self._whole(text, True) if OTHER.search(text) else b"".join(self._parts(self.find(text)))
        return np.frombuffer(data, "<u2").tolist()


def coder(path: str, pattern: str) -> Coder:
    return resident(("bytes", path, pattern), lambda: Coder(path, pattern))
