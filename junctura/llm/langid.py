"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed: the pieces of a public tokenizer. Each language has its own piece probabilities. The
probability of a word in a language is the sum over all its segmentations into pieces of the product of their
probabilities (forward algorithm); a text's is the product over its words. Piece probabilities are learned
by expectation-maximisation over the same lattice: expected counts from a forward and a backward pass.

Learning takes a bounded sample, FIT_ROWS documents of each language on average, chosen by a hash of the id
(whole texts); the word counts of the sample and the sums of expected counts are Spark aggregations, and only the
piece probabilities (pieces x languages) come to the driver. Prediction runs over every whole text.

Words are runs of characters between Unicode white space, alike in learning and prediction. However long a word is, the sum
runs over all segmentations of the whole word: probabilities are scaled every SCALE characters, and pieces are looked
up in windows.

Texts that are null or hold no letter are ``und`` with score 0, as are all texts when nothing could be learned.
Ties go to the alphabetically first language. Repeated rows, and rows with null or repeated ids, are rows like others (a null id is
not held out, and not learned from); no rows give no rows; other columns are ignored. Labels are learned and scored LANGUAGES at
a time, which bounds the table; more of them take turns over all rows, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import blocks, documents, map_rows, resident, with_column
from junctura.llm.words import U64, mix, splitmix
from junctura.tables import cut

MODEL = "piece_bpe_32k.model"
FIT_ROWS, ROUNDS, SMOOTH = 1500, 3, 0.02
#: Labels that are learned and scored at once, more of them in turn; probability of a character that no piece covers, alike in all languages.
LANGUAGES, UNKNOWN = 200, 1e-6
#: Characters between two scalings (a character costs a factor of UNKNOWN at worst) and in a window of piece look-ups.
SCALE, WINDOW = 16, 2048
#: What separates words (fixed values: the white space of Unicode and the four information separators), as a Java regex class.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
MARK = "▁"
BLOCK_BYTES, MEMO_ROWS = 1 << 21, 150_000
LETTER = regex.compile(r"\p{L}")


class Lattice:
    """Finds all pieces in words by rolling hashes over a table of the vocabulary. Piece 0 is none, the last one is unknown."""

    SLOTS = 20

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.size = len(pieces) + 2
        self.longest = max(map(len, pieces))
        self.keys = np.zeros(self.size, U64)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces, 1):
            by_length.setdefault(len(p), []).append(i)
        for n, ids in by_length.items():
            codes = np.array([pieces[i - 1] for i in ids], f"<U{n}").view(np.uint32).reshape(len(ids), n)
            hashed = np.zeros(len(ids), U64)
            for k in range(n):
                hashed = hashed * U64(0x9E3779B97F4A7C15) + self._values(codes[:, k])
            self.keys[ids] = mix(hashed + U64(n))
        #: A piece is in its first slot or, where another took it, in its second; few need the third table.
        self.tables = []
        left = np.arange(1, len(pieces) + 1)
        for t in range(4):
            table = np.zeros(1 << self.SLOTS, np.int32)
            slot = self._slot(self.keys[left], t)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
            if not len(left):
                break
        if len(left):
            raise ValueError("vocabulary table is full")

    @staticmethod
    def _values(codes: np.ndarray) -> np.ndarray:
        return mix(codes.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(1))

    def _slot(self, keys: np.ndarray, t: int) -> np.ndarray:
        return ((keys >> U64(t * 11)) & U64((1 << self.SLOTS) - 1)).astype(np.int64)

    def pieces_of(self, codes: np.ndarray) -> list[np.ndarray]:
        """For k = 1, 2, ...: the piece (word, start) of k characters, 0 for none. codes: (word, character)."""
        n = codes.shape[1]
        values = self._values(codes)
        hashed = np.zeros_like(values)
        out = []
        for k in range(1, min(n, self.longest) + 1):
            hashed = hashed[:, : n - k + 1] * U64(0x9E3779B97F4A7C15) + values[:, k - 1 :]
            keys = mix(hashed + U64(k))
            found = np.zeros(keys.shape, np.int32)
            for t, table in enumerate(self.tables):
                piece = table[self._slot(keys, t)]
                np.copyto(found, piece, where=self.keys[piece] == keys)
            if k == 1:
                found[found == 0] = self.size - 1
            out.append(found)
        return out

    def forward(self, codes: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(t, alpha, log scale) for t = 0, 1, ...: alpha * exp(scale) is the (word, language) probability of the first t characters."""
        m, n = codes.shape
        scale = np.zeros((m, p.shape[1]))
        past = [np.ones((m, p.shape[1]))]  # alpha of the last characters, under the present scale
        yield 0, past[0], scale
        for begin in range(0, n, WINDOW):
            from_ = max(0, begin - self.longest + 1)
            pieces = self.pieces_of(codes[:, from_ : begin + WINDOW])
            for t in range(begin + 1, min(n, begin + WINDOW) + 1):
                alpha = sum(past[-k] * p[pieces[k - 1][:, t - k - from_]] for k in range(1, min(len(past), len(pieces)) + 1))
                past = [*past[1 - self.longest :], alpha]
                if t % SCALE == 0:
                    past = [x / alpha for x in past]
                    scale, alpha = scale + np.log(alpha), past[-1]
                yield t, alpha, scale


def lattice(path: str) -> Lattice:
    return resident(("language", path), lambda: Lattice(path))


def batches_of(words: list[str], cells: int = 1 << 18) -> Iterator[list[int]]:
    """Numbers of words in batches of one length, longer ones of lengths up to twice the shortest, each of about ``cells`` characters."""
    size = np.array([len(w) for w in words])
    kind = np.where(size < 32, size, 32 + np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    order = np.lexsort((size, kind))
    at = 0
    while at < len(order):
        longest = 0
        first = at
        while at < len(order) and kind[order[at]] == kind[order[first]] and at - first < 4096:
            longest = max(longest, int(size[order[at]]))
            if at > first and longest * (at + 1 - first) > cells:
                break
            at += 1
        yield order[first:at].tolist()


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(character codes (word, character), lengths); shorter words end in zeros."""
    size = np.array([len(w) for w in words])
    n = int(size.max())
    return np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n), size


def log_scores(words: list[str], table: Lattice, p: np.ndarray) -> np.ndarray:
    """(word, language) log probability of each word."""
    whole = [MARK + w for w in words]
    out = np.zeros((len(words), p.shape[1]))
    for ids in batches_of(whole):
        codes, size = codes_of([whole[i] for i in ids])
        ids = np.array(ids)
        ends = set(size.tolist())
        for t, alpha, scale in table.forward(codes, p):
            if t in ends:
                here = size == t
                out[ids[here]] = np.log(alpha[here]) + scale[here]
    return out


def expected_counts(words: list[str], weight: np.ndarray, table: Lattice, p: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all segmentations of ``words`` in one language.

    A backward pass over windows meets the stored forward values: a piece from t to t + k has the share
    alpha[t] * p * beta[t + k] of the whole word's probability.
    """
    whole = [MARK + w for w in words]
    total = np.zeros(table.size)
    for ids in batches_of(whole):
        codes, size = codes_of([whole[i] for i in ids])
        m, n = codes.shape
        alpha, scale, at_end = np.zeros((n + 1, m)), np.zeros((n // SCALE + 1, m)), np.zeros(m)
        for t, a, s in table.forward(codes, p[:, None]):
            alpha[t], scale[t // SCALE] = a[:, 0], s[:, 0]
            here = size == t
            at_end[here] = np.log(a[here, 0]) + s[here, 0]
        share = np.asarray(weight, float)[ids]
        later = [np.zeros(m) for _ in range(table.longest)]  # beta of t + 1, t + 2, ..., under the present scale
        back = np.zeros(m)
        for begin in range((n - 1) // WINDOW * WINDOW, -1, -WINDOW):
            pieces = table.pieces_of(codes[:, begin : begin + WINDOW + table.longest - 1])
            for t in range(min(n, begin + WINDOW) - 1, begin - 1, -1):
                later = [np.where(size == t + 1, 1.0, later[0]), *later[1:]]
                back = np.where(size == t + 1, 0.0, back)
                reach = min(n - t, len(pieces))
                parts = [later[k - 1] * p[pieces[k - 1][:, t - begin]] for k in range(1, reach + 1)]
                beta = sum(parts)
                with np.errstate(under="ignore"):
                    known = alpha[t] * np.exp(np.where(t < size, scale[t // SCALE] + back - at_end, -np.inf)) * share
                for k, x in enumerate(parts, 1):
                    total += np.bincount(pieces[k - 1][:, t - begin], known * x, table.size)
                later = [beta, *later[:-1]]
                if t % SCALE == 0:
                    by = np.where(beta > 0, beta, 1.0)
                    later = [x / by for x in later]
                    back = back + np.log(by)
    return total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.filter("text is not null and lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))


def labels(docs: DataFrame) -> dict[str, int]:
    """Documents of each label that can be learned."""
    return {r.lang: r["count"] for r in _labelled(docs).groupBy("lang").count().collect()}


def fit(docs: DataFrame, path: str, rows: int = FIT_ROWS, rounds: int = ROUNDS, count: dict[str, int] | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, (piece, language) probabilities) from about ``rows`` documents of each language: of all, or of those in ``count``."""
    known = _labelled(docs)
    count = labels(docs) if count is None else count
    langs = sorted(count)
    table = lattice(path)
    if not langs:
        return [], np.zeros((table.size, 0))
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, rows / count[g])))])[F.col("lang")]
    sample = known.filter(F.col("lang").isin(langs)).filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 20)) < share * (1 << 20))
    words = sample.select("lang", F.explode(F.split("text", SPACES)).alias("word")).filter("word <> ''")
    words = cut(words.groupBy("lang", "word").agg(F.count("*").alias("n")).repartition(16, "lang", "word"), "fit")
    p = np.full((table.size, len(langs)), 1 / table.size)
    for _ in range(rounds):
        p[0], p[-1] = 0, UNKNOWN

        def count_pieces(frames, p=p):
            table = lattice(path)
            for f in frames:
                for lang, part in f.groupby("lang"):
                    c = expected_counts(part["word"].tolist(), part["n"].to_numpy(), table, p[:, langs.index(lang)])
                    at = np.flatnonzero(c)
                    yield pd.DataFrame({"lang": lang, "piece": at, "c": c[at]})

        sums = words.mapInPandas(count_pieces, "lang string, piece long, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toPandas()
        c = np.zeros_like(p)
        c[sums["piece"], sums["lang"].map(langs.index)] = sums["c"]
        c[0] = c[-1] = 0
        p = (c + SMOOTH) / (c.sum(axis=0) + SMOOTH * table.size)
    p[0], p[-1] = 0, UNKNOWN
    return langs, p


class Scorer:
    """Keeps word scores between batches of a Python worker; starts anew when the memo is full."""

    def __init__(self, table: Lattice, p: np.ndarray) -> None:
        self.table, self.p = table, p
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, p.shape[1]))

    def texts(self, texts: list[str]) -> np.ndarray:
        """(text, language) log probabilities."""
        words = [t.split() for t in texts]
        new = sorted(set().union(*words) - self.row.keys())
        if len(self.row) + len(new) > MEMO_ROWS:
            self.row, self.scores = {}, self.scores[:0]
            new = sorted(set().union(*words))
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, log_scores(new, self.table, self.p)])
        out = np.zeros((len(texts), self.p.shape[1]))
        for i, w in enumerate(words):
            if w:
                out[i] = self.scores[[self.row[x] for x in w]].sum(axis=0)
        return out


def scorer(path: str, p: np.ndarray) -> Scorer:
    """The scorer of a table of probabilities, held with the lattice."""
    key = mix(splitmix(p.size, 5) ^ p.reshape(-1).view(U64)).sum(dtype=U64)
    table = lattice(path)
    if getattr(table, "scorer", None) is None or table.scorer[0] != key:
        table.scorer = (key, Scorer(table, p))
    return table.scorer[1]


def best_labels(texts: list[str | None], path: str, langs: list[str], p: np.ndarray) -> list[tuple[str, float, float] | None]:
    """(most probable of ``langs``, its log probability, that of all together as a multiple of it) of each text; None for one without letters."""
    out: list[tuple[str, float, float] | None] = [None] * len(texts)
    if not langs:
        return out
    score = scorer(path, p)
    some = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    for first, part in blocks((texts[i].encode() for i in some), BLOCK_BYTES):
        logs = score.texts([texts[i] for i in some[first : first + len(part)]])
        best, most = logs.argmax(axis=1), logs.max(axis=1)
        total = np.exp(logs - most[:, None]).sum(axis=1)
        for k, (b, m, t) in enumerate(zip(best.tolist(), most.tolist(), total.tolist(), strict=True)):
            out[some[first + k]] = (langs[b], m, t)
    return out


def classify(texts: list[str | None], path: str, langs: list[str], p: np.ndarray) -> list[tuple[str, float]]:
    """(language, its posterior probability) of each text; ``und`` and 0 for one without letters."""
    return [(f[0], 1 / f[2]) if f else ("und", 0.0) for f in best_labels(texts, path, langs, p)]


STATE = ["_lang", "_best", "_total"]


def _scored(rows: DataFrame, langs: list[str], p: np.ndarray, path: str) -> DataFrame:
    """``rows`` (text, _lang, _best, _total and others) after the labels ``langs``: the best label so far (of equal ones the first), its log probability, that of all as a multiple of it."""

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        now = [batch.column(c).to_pylist() for c in STATE]
        for i, found in enumerate(best_labels(batch.column("text").to_pylist(), path, langs, p)):
            if found:
                label, best, total = found
                if now[0][i] is None:
                    now[0][i], now[1][i], now[2][i] = label, best, total
                elif best > now[1][i]:
                    now[0][i], now[1][i], now[2][i] = label, best, total + now[2][i] * math.exp(now[1][i] - best)
                else:
                    now[2][i] += total * math.exp(best - now[1][i])
        for c, values in zip(STATE, now, strict=True):
            batch = with_column(batch, c, pa.array(values, batch.schema.field(c).type))
        return batch

    return map_rows(rows, change)


def _begun(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in zip(STATE, ("string", "double", "double"), strict=True)})


def with_language(rows: DataFrame, docs: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """(``rows`` with _lang, _best and _total over all labels of ``docs``, whether there are any). More than LANGUAGES labels take turns, each over all rows."""
    count = labels(docs)
    names = sorted(count)
    out = _begun(rows)
    for k in range(0, len(names), LANGUAGES):
        if k:
            out = cut(out, "language")
        out = _scored(out, *fit(docs, path, count={g: count[g] for g in names[k : k + LANGUAGES]}), path)
    return out, bool(names)


def _ready(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))


def _named(scored: DataFrame) -> DataFrame:
    score = F.when(F.col("_lang").isNull(), 0.0).otherwise(1 / F.col("_total"))
    return scored.select("doc_id", "held_out", F.coalesce("_lang", F.lit("und")).alias("lang_pred"), score.alias("score"))


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, path: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by a fitted table; only the text decides. The score is the label's posterior probability."""
    return _named(_scored(_begun(_ready(docs)), langs, p, path))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _named(with_language(_ready(docs), docs, public_tokenizers.path(MODEL))[0])


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; ``und`` ones, null or without letters, go. Columns are kept as they are.

    Where no row is labelled nothing can be learned and no document be told apart: all with a letter stay.
    """
    scored, learned = with_language(docs, docs, public_tokenizers.path(MODEL))
    return scored.filter(F.col("_lang").isNotNull() if learned else F.col("text").rlike(r"\p{L}")).drop(*STATE)
