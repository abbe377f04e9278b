"""Edit-aware token counts over pre-token segment trees.

A document keeps a segment tree over its pre-tokens: leaves hold character lengths and token counts, inner nodes
their sums. ``build_trees`` stores the leaves beside the text; ``edit_trees`` opens stored trees for later edits and gives them
back for the next ones, so that a text is encoded as a whole only once. An edit finds its leaf by descending over character sums, cuts text
into pre-tokens anew from BACK characters before the edit until a cut falls on an old one behind the edit, encodes
only these, puts each into a leaf of its own (touched leaves first; where they are too few, leaves are dealt anew, without
encoding) and updates the sums above.

Why this is exact: the pattern never looks back, so pre-tokens from a cut on depend on the text behind it
alone, and it looks at most two characters beyond a pre-token's end, so those that end BACK characters before an
edit stay.

Null texts count as empty. Edits of a row (start, end, text) apply one after another to the text as it then is;
positions are code points and are clipped to it; equal edits apply each. Null edits change nothing. Rows with null or repeated ids are rows like
others; no rows give no rows; other columns are ignored. Special tokens' contents count as ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.bpe import Coder, coder
from junctura.llm.common import blocks, documents, map_batches
from junctura.llm.token_store import tokenizer
from junctura.tables import cut

BACK = 3
#: Characters of text whose pre-tokens are counted at once (or one longer text).
BLOCK_CHARS = 1 << 17
EDIT = "array<struct<start:int,end:int,text:string>>"


class Counter:
    """Pre-tokens of text and their token counts."""

    def __init__(self, encode: Coder, pattern: str) -> None:
        self.encode, self.find = encode, regex.compile(pattern)

    def parts(self, text: str) -> tuple[list[int], list[int]]:
        """(characters, tokens) of each pre-token of ``text``."""
        parts = self.find.findall(text)
        return list(map(len, parts)), self.encode.counts(parts)

    def many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``parts`` of each text, a block of texts at a time, so that what the worker does not remember goes to the library together."""
        for _, block in blocks(texts, BLOCK_CHARS):
            cuts = [*map(self.find.findall, block)]
            parts = [*chain.from_iterable(cuts)]
            ends = np.cumsum([*map(len, cuts)])[:-1]
            yield from zip(*(np.split(np.fromiter(x, np.int64, len(parts)), ends) for x in (map(len, parts), self.encode.counts(parts))), strict=True)


def counter(files: tuple[str, str]) -> Counter:
    return Counter(coder(*files), files[1])


def pack(values: list[int] | np.ndarray) -> bytes:
    """A byte with the width, then the values in that many bytes each: one, or four where a value needs them."""
    values = np.asarray(values, np.int64)
    width = 1 if values.max(initial=0) < 256 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class PretokenTree:
    """Sums over pre-tokens in heap order: node 1 is the root, node i has children 2i and 2i + 1, leaf k is node cap + k; a leaf without characters is free."""

    def __init__(self, lengths: list[int], counts: list[int]) -> None:
        self.size = max(1, len(lengths))
        self.cap = 1 << (self.size - 1).bit_length()
        self.chars, self.tokens = self._sums(lengths), self._sums(counts)

    def _sums(self, values: list[int]) -> np.ndarray:
        level = np.zeros(self.cap, np.int64)
        level[: len(values)] = values
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        return np.concatenate([np.zeros(1, np.int64), *reversed(levels)])

    @classmethod
    def of(cls, text: str, counts: Counter) -> PretokenTree:
        return cls(*counts.parts(text))

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of the leaves that are not free."""
        chars, tokens = self.chars[self.cap :], self.tokens[self.cap :]
        return chars[chars > 0], tokens[chars > 0]

    def dump(self) -> tuple[bytes, bytes]:
        """``leaves``, packed."""
        chars, tokens = self.leaves()
        return pack(chars), pack(tokens)

    @classmethod
    def load(cls, chars: bytes, tokens: bytes) -> PretokenTree:
        return cls(unpack(chars), unpack(tokens))

    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) that holds character ``place``, the last one with characters if beyond."""
        place = max(0, min(place, self.chars[1] - 1))
        i, first = 1, 0
        while i < self.cap:
            i *= 2
            if place - first >= self.chars[i] and self.chars[i + 1]:
                first += self.chars[i]
                i += 1
        return i - self.cap, first

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.cap
        up, more = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += up
            self.tokens[i] += more
            i //= 2

    def edit(self, text: str, start: int, end: int, new: str, counts: Counter) -> tuple[str, int]:
        """(the text after replacing ``start``:``end`` by ``new``, pre-tokens encoded); the tree then describes it."""
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        after = text[:start] + new + text[end:]
        shift = len(after) - len(text)
        leaf, begin = self.leaf_at(start - BACK)
        last, old = leaf, begin + self.chars[leaf + self.cap]  # the old text ends at ``old`` after leaf ``last``
        parts, at = [], begin
        for m in counts.find.finditer(after, begin):
            while last + 1 < self.size and (old < end or old + shift < at):
                last += 1
                old += self.chars[last + self.cap]
            if old >= end and old + shift == at >= start + len(new) and parts:
                break
            parts.append(m[0])
            at = m.end()
        else:
            last = self.size - 1
        self._replace(leaf, last, [len(x) for x in parts], counts.encode.counts(parts))
        return after, len(parts)

    def _replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Leaves ``first`` to ``last`` become these, one a pre-token."""
        if len(chars) <= last - first + 1:
            for k in range(first, last + 1):
                i = k - first
                c, t = (chars[i], tokens[i]) if i < len(chars) else (0, 0)
                if c or self.chars[k + self.cap]:
                    self._set(k, c, t)
            return
        a, b = self.cap + first, self.cap + last + 1
        held = np.concatenate([self.chars[self.cap : a], chars, self.chars[b : self.cap + self.size]]), np.concatenate([self.tokens[self.cap : a], tokens, self.tokens[b : self.cap + self.size]])
        used = held[0] > 0
        self.__init__(held[0][used], held[1][used])


LEAVES = "doc_id long, text string, chars binary, tokens binary"


def _built(batch: pa.RecordBatch, files: tuple[str, str]) -> dict:
    counts = counter(files)
    texts = pc.fill_null(batch.column(1), "")
    leaves = [(pack(c), pack(n)) for c, n in counts.many(texts.to_pylist())]
    chars, tokens = zip(*leaves, strict=True)
    return {"doc_id": batch.column(0), "text": texts, "chars": chars, "tokens": tokens}


def build_trees(docs: DataFrame, files: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, chars, tokens): each text (null: empty) with the leaves of its tree (see ``pack``), to be stored."""
    ready = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(ready, ["id", "text"], lambda batch: _built(batch, files), LEAVES)


def edit_trees(trees: DataFrame, files: tuple[str, str], edits_col: str = "edits") -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, after, encoded, text, chars, tokens) of stored trees (see ``build_trees``) with a column of edits.

    Counts before, and after each edit, with the pre-tokens each encoded; then the text and leaves after all edits.
    ``edits``: array<struct<start, end, text>>.
    """

    def make(batch: pa.RecordBatch) -> dict:
        counts = counter(files)
        names = ("n_tokens", "n_pretokens", "after", "encoded", "text", "chars", "tokens")
        out = []
        for text, chars, tokens, edits in zip(*batch.columns[1:], strict=True):
            now, tree = text.as_py(), PretokenTree.load(chars.as_py(), tokens.as_py())
            n, parts = tree.total(), len(unpack(chars.as_py()))
            after, encoded = [], []
            for e in edits.as_py() or []:
                if e is not None:
                    now, k = tree.edit(now, e["start"] or 0, e["end"] or 0, e["text"] or "", counts)
                    encoded.append(k)
                    after.append(tree.total())
            out.append((n, parts, after, encoded, now, *tree.dump()))
        return {"doc_id": batch.column(0)} | dict(zip(names, zip(*out, strict=True), strict=True))

    ready = trees.select("doc_id", "text", "chars", "tokens", F.col(edits_col).cast(EDIT).alias("edits"))
    return map_batches(ready, ready.columns, make, "doc_id long, n_tokens long, n_pretokens long, after array<bigint>, encoded array<bigint>, text string, chars binary, tokens binary")


def edited_counts(rows: DataFrame, files: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, after, encoded, text) of rows without a stored tree: it is built and edited at once."""
    ready = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(edits_col).cast(EDIT).alias("edits"))
    built = map_batches(ready, ready.columns, lambda batch: _built(batch, files) | {"edits": batch.column(2)}, f"{LEAVES}, edits {EDIT}")
    return edit_trees(built, files).drop("chars", "tokens")


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole document before and after three edits: an insertion at a third, a deletion at the half, a replacement at two thirds of its length.

    The trees are stored first; the edits open them.
    """
    trees = cut(build_trees(documents(spark, sf_dir), tokenizer()), "trees")
    n = F.length("text")
    edit = lambda at, size, text: F.struct(F.floor(at).cast("int").alias("start"), (F.floor(at) + size).cast("int").alias("end"), F.lit(text).alias("text"))
    found = edit_trees(trees.withColumn("edits", F.array(edit(n / 3, 0, " [note 1]\n"), edit(n / 2, 5, ""), edit(n * 2 / 3, 3, "é's  "))), tokenizer())
    total = F.aggregate("encoded", F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "n_tokens", "n_pretokens", *[F.get("after", F.lit(k)).alias(f"n_after_{k + 1}") for k in range(3)], total.alias("n_encoded"), F.sha2("text", 256).alias("text_sha256"))
