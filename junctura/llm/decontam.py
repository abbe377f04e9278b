"""Benchmark decontamination: find documents that hold a benchmark item within an edit distance.

Items and documents are sequences of words (ASCII letters, digits and non-ASCII; A-Z as a-z; punctuation and
spaces separate). A document holds an item when some run of its words is within ``max_edits`` (a share of
the item's words, 0.2 by default) of the whole item in word edit distance.

Candidates come from a CGK random walk: the walk reads a word, writes it, and steps on or stays by a random
bit of that word and step, so that a bounded edit distance becomes a bounded Hamming distance between walks. LSH keys take
some of the written positions; repetitions use new walks. Each candidate is then verified by the exact
semi-global edit distance (bit-parallel) between the whole item and the words around it, which also gives its place; before, those go whose place has too few
of the item's words to hold it, by a table of marks, for all candidates at once.

* Items of LONG words or more: walks of STEPS steps start at every word of an item and at every fourth word of a document; keys take
  SAMPLE of the steps, in REPS repetitions.
* Shorter items have few words, so their keys take the whole of short walks that start at every word of both sides: with k edits allowed some
  s = (n - k) / (k + 1) words, rounded up, stand unchanged in a row, and a walk of s steps reads no more, so no occurrence is lost. Of
  SHORT_REPS walks an item uses, at each of its words, the one that reads the most words there: it is the most telling.

``benchmark`` is a query set: it is cut into blocks of bounded bytes, each indexed on the driver and sent with
the task closure, and every block meets all documents. Documents are never shuffled.

Null or wordless texts hold nothing; items without words are never found; null ids, of items too, are passed on as they are, and
rows and items that repeat are found each. No documents or no items give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import blocks, documents, map_batches, map_rows, texts_of
from junctura.llm.words import U64, mix, splitmix, word_hashes

MAX_EDITS = 0.2
LONG, STEPS, STRIDE, SAMPLE, REPS = 20, 16, 4, 4, 10
SHORT_STEPS, SHORT_REPS = 4, 8
#: Bytes of texts worked on at once, and of an indexed block of items: an index takes about 25 bytes for each.
BLOCK_BYTES, ITEM_BYTES = 1 << 21, 2 << 20
PAD = 512


class Keys:
    """Sorted LSH keys, and for each the item and the word of it that it stands for."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.offset = keys[order], np.asarray(item, np.int32)[order], np.asarray(offset, np.int32)[order]
        # by a key's high bits, whether any key has them
        self.shift = U64(64 - min(20, max(10, len(keys).bit_length() + 4)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(self.keys >> self.shift).astype(np.int64)] = True

    def meet(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ``keys``, entries) of all equal pairs."""
        near = np.flatnonzero(self.bits[(keys >> self.shift).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, keys[near], "left"), np.searchsorted(self.keys, keys[near], "right")
        n = hi - lo
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
        return np.repeat(near, n), entry


@dataclass
class Index:
    """Ids and words of the items; keys of the long items' walks by repetition; keys of the short ones' by repetition and steps; marks of each item's words."""

    ids: list
    words: list[np.ndarray]
    long_: list[Keys]
    short: dict[tuple[int, int], Keys]
    max_edits: float

    def __post_init__(self) -> None:
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.salt = splitmix(len(self.words), 7000)
        self.shift = U64(64 - min(24, max(10, int(self.size.sum()).bit_length() + 4)))
        self.marks = np.zeros(1 << (64 - int(self.shift)), bool)
        for salt, w in zip(self.salt, self.words, strict=True):
            self.marks[self._mark(salt, w)] = True

    def _mark(self, salt: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (mix(words ^ salt) >> self.shift).astype(np.int64)

    def plausible(self, text: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, edits: np.ndarray) -> np.ndarray:
        """Which places ``lo``:``hi`` of ``text`` can hold their items: within k edits, n - k of a place's words are words of the item. Marks may only tell too many."""
        left, have = np.arange(len(item)), np.zeros(len(item), np.int64)
        for j in range(int((hi - lo).max(initial=0))):
            left = left[lo[left] + j < hi[left]]
            have[left] += self.marks[self._mark(self.salt[item[left]], text[lo[left] + j])]
        return have >= self.size[item] - edits[item]


def walk_keys(words: np.ndarray, starts: np.ndarray, steps: int, rep: int, samples: set[int]) -> np.ndarray:
    """LSH keys of CGK walks from ``starts``; ``words`` must go on for ``steps`` words after the last start."""
    at, key = starts.copy(), np.full(len(starts), rep + 1, U64)
    turn = splitmix(steps, 1000 + rep) | U64(1)
    for j in range(max(samples) + 1):
        word = words[at]
        if j in samples:
            key = (key ^ word) * U64(0x9E3779B97F4A7C15)
            key ^= key >> U64(32)
        at += ((word * turn[j]) >> U64(63)).view(np.int64)
    return mix(key)


def _samples(steps: int, size: int, rep: int) -> set[int]:
    """One step in each of ``size`` equal parts, never the last of a part: neighbours often still read the same word."""
    if steps < 2 * size:
        return set(range(steps))
    room = steps // size
    return {j * room + int(r % U64(max(1, room - 1))) for j, r in enumerate(splitmix(size, 5000 + 97 * rep))}


def short_walks(words: np.ndarray, starts: np.ndarray, rep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, words moved on) of walks from ``starts`` after 1, 2, ... SHORT_STEPS steps."""
    at, key = starts.copy(), np.full(len(starts), rep + 1, U64)
    for turn in splitmix(SHORT_STEPS, 3000 + rep) | U64(1):
        word = words[at]
        key = (key ^ word) * U64(0x9E3779B97F4A7C15)
        key ^= key >> U64(32)
        yield mix(key), at - starts
        at = at + ((word * turn) >> U64(63)).view(np.int64)


def _long_keys(runs: list[np.ndarray], chosen: list[int]) -> list[Keys]:
    padded = [np.concatenate([runs[i], splitmix(STEPS + 1, 9000 + i)]) for i in chosen]
    base = np.cumsum([0, *(len(p) for p in padded)])[:-1]
    text = np.concatenate(padded)
    tries = [max(1, len(runs[i]) - STEPS // 2 + 1) for i in chosen]
    starts = np.concatenate([b + np.arange(n) for b, n in zip(base, tries, strict=True)])
    item, offset = np.repeat(chosen, tries), np.concatenate([np.arange(n) for n in tries])
    return [Keys(walk_keys(text, starts, STEPS, rep, _samples(STEPS, SAMPLE, rep)), item, offset) for rep in range(REPS)]


def _short_keys(runs: list[np.ndarray], chosen: list[int], max_edits: float) -> dict[tuple[int, int], Keys]:
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for i in chosen:
        n, k = len(runs[i]), int(max_edits * len(runs[i]))
        steps = min(SHORT_STEPS, max(1, -(-(n - k) // (k + 1))))
        starts = np.arange(n - steps + 1)
        text = np.concatenate([runs[i], splitmix(SHORT_STEPS, 9000 + i)])
        walks = [list(short_walks(text, starts, rep))[steps - 1] for rep in range(SHORT_REPS)]
        best = np.argmax([moved for _, moved in walks], axis=0)
        for o in starts.tolist():
            rep = int(best[o])
            found.setdefault((rep, steps), []).append((int(walks[rep][0][o]), i, o))
    return {at: Keys(*(np.array(x, t) for x, t in zip(zip(*rows, strict=True), (U64, np.int32, np.int32), strict=True))) for at, rows in found.items()}


def build_index(items: list[tuple[object, str]], max_edits: float = MAX_EDITS) -> Index:
    hashed, first = word_hashes([(t or "").encode() for _, t in items], letters_only=True)
    runs = [hashed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    long_ = [i for i, w in enumerate(runs) if len(w) >= LONG]
    short = [i for i, w in enumerate(runs) if 0 < len(w) < LONG]
    return Index([i for i, _ in items], runs, _long_keys(runs, long_) if long_ else [], _short_keys(runs, short, max_edits), max_edits)


def _columns(item: list[int], text: Iterable[int], anchored: bool) -> Iterator[int]:
    """Edit distance of ``item`` and the words of ``text`` up to each word: from the first one if ``anchored``, else from the best one."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    up, down, score = full, 0, m
    for w in text:
        eq = places.get(w, 0)
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(across | up) & full), up & across
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1 | anchored, minus << 1
        up, down = (minus | ~(eq | down | plus)) & full, plus & (eq | down) & full
        yield score


def edit_distance_within(item: list[int], text: list[int]) -> int:
    """Least word edit distance between ``item`` and any run of ``text`` (bit-parallel, one column a word)."""
    return min(_columns(item, text, False), default=len(item)) if text else len(item)


def locate(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(distance, first word) of the first best place of ``item`` in ``text``, if that is within ``most``."""
    best, end = len(item), 0
    for j, score in enumerate(_columns(item, text, False), 1):
        if score < best:
            best, end = score, j
    if best > most:
        return None
    back = _columns(item[::-1], reversed(text[:end]), True)
    return best, end - next((j for j, score in enumerate(back, 1) if score == best), 0)


def find_items(index: Index, texts: list[bytes], max_edits: float = MAX_EDITS) -> list[list[tuple[int, int, int]]]:
    """For each text the (number of the item, distance, first word of the place) of the items it holds, the best place of each."""
    if max_edits > index.max_edits:
        raise ValueError("the index is built for fewer edits")
    words, first = word_hashes(texts, letters_only=True)
    count = np.diff(first)
    doc_of = np.repeat(np.arange(len(texts)), count)
    within = np.arange(len(words)) - np.repeat(first[:-1], count)
    padded = np.concatenate([words, splitmix(PAD, 31337)])
    edits = (max_edits * index.size).astype(np.int64)
    seen, held_rows = [np.zeros((0, 3), np.int64)], 0

    def around(doc: np.ndarray, item: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words in which an item that begins about there would stand."""
        k = edits[item]
        return np.maximum(first[doc], begin - 2 * k - 1), np.minimum(first[doc + 1], begin + index.size[item] + 2 * k + 1)

    def note(starts: np.ndarray, keys: np.ndarray, held: Keys) -> None:
        for part in np.array_split(np.arange(len(keys)), max(1, len(keys) >> 13)):
            number, entry = held.meet(keys[part])
            if len(number):
                p, item = starts[part[number]], held.item[entry].astype(np.int64)
                order = np.lexsort((at := p - held.offset[entry], item))
                rows = np.stack([doc_of[p], item, at], axis=1)[order]
                seen.append(rows[np.concatenate([[True], (np.diff(rows, axis=0) != 0).any(axis=1)])])
        if sum(map(len, seen)) > 2 * held_rows + (1 << 18):
            shrink()

    def shrink() -> None:
        """Candidates once each, those alone that can hold their items."""
        nonlocal seen, held_rows
        rows = np.concatenate(seen)
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.concatenate([[True], (np.diff(rows, axis=0) != 0).any(axis=1)])[: len(rows)]]
        seen = [rows[index.plausible(words, rows[:, 1], *around(*rows.T), edits)]]
        held_rows = len(seen[0])

    strided = np.flatnonzero(within % STRIDE == 0)
    for rep, held in enumerate(index.long_):
        for at in range(0, len(strided), 1 << 15):
            part = strided[at : at + (1 << 15)]
            note(part, walk_keys(padded, part, STEPS, rep, _samples(STEPS, SAMPLE, rep)), held)
    for rep in sorted({rep for rep, _ in index.short}):
        for at in range(0, len(words), 1 << 15):
            part = np.arange(at, min(len(words), at + (1 << 15)))
            for steps, (keys, _) in enumerate(short_walks(padded, part, rep), 1):
                if (rep, steps) in index.short:
                    note(part, keys, index.short[rep, steps])
    found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    shrink()
    every = seen[0]
    for d, i, lo, hi in zip(*every[:, :2].T.tolist(), *(x.tolist() for x in around(*every.T)), strict=True):
        place = locate(index.words[i].tolist(), words[lo:hi].tolist(), int(edits[i]))
        if place:
            x, w = place[0], place[1] + lo - int(first[d])
            found[d][i] = min(found[d].get(i, (x, w)), (x, w))
    return [sorted((i, x, w) for i, (x, w) in f.items()) for f in found]


def _indexes(items: DataFrame, id_col: str, text_col: str, max_edits: float):
    """Indexes of ``items`` in blocks of about ITEM_BYTES of text."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    n = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES
    for k in range(n):
        block = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield build_index(sorted(((r.id, r.text) for r in block.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), max_edits)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """(doc_id, item_id, distance, at_word, item_words): one row for each document and item that it holds; other columns are ignored."""
    out = None
    for index in _indexes(items, item_id, item_text, max_edits):

        def make(batch: pa.RecordBatch, index: Index = index) -> dict:
            rows: list[tuple] = []
            for start, part in blocks(texts_of(batch.column(1)), BLOCK_BYTES):
                for d, held in enumerate(find_items(index, part, max_edits)):
                    rows += [(batch.column(0)[start + d].as_py(), index.ids[i], x, w, len(index.words[i])) for i, x, w in held]
            return dict(zip(("doc_id", "item_id", "distance", "at_word", "item_words"), zip(*rows, strict=True) if rows else [[]] * 5, strict=True))

        found = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id", "text"], make, "doc_id long, item_id long, distance long, at_word long, item_words long")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay, nothing is shuffled."""
    for index in _indexes(items, "item_id", "text", max_edits):

        def change(batch: pa.RecordBatch, index: Index = index) -> pa.RecordBatch:
            clean = [not held for _, part in blocks(texts_of(batch.column("text")), BLOCK_BYTES) for held in find_items(index, part, max_edits)]
            return batch.filter(pa.array(clean, pa.bool_()))

        docs = map_rows(docs, change)
    return docs


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go; all others, those without text or id too, stay with all their columns. No rows give no rows, no items remove none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
