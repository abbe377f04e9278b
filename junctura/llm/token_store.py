"""Token ids of a corpus in shards, each one wavelet matrix file.

Shards are ranges of documents of SHARD_BYTES of text at most (or one longer document), so that concatenating them
in order gives all ids in ascending document order. Rows are dealt to ranges of (id, first PREFIX characters) whose
borders Spark samples from the data, and sorted there, on disk if need be; each range is then cut into shards by
size, so that neither crowded ids nor repeated or null ones make a shard larger. A shard file is one row of a Parquet table
(shard, first_id, n_docs, n_tokens, data) in a shared folder: writers commit through Spark, so that lost executors
leave no half files. Reading needs only that table; offsets of shards are running sums within ranges of them.
A document's id of -2^63 reads back as null (it marks a null id in the file).

Null and empty texts hold just the end id; rows without a document id come first, in one order by text;
rows that repeat an id stand next to each other, ordered by text. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.bpe import coder
from junctura.llm.common import documents
from junctura.llm.wavelet import WaveletMatrix
from junctura.operators.order import running
from junctura.tables import cut

END = 0
NO_ID = -(1 << 63)
SHARD_BYTES = 16 << 20
#: Shards in a range, and characters of a text that part ranges of one id.
RANGE_SHARDS, PREFIX = 2, 64
#: What a document takes beside its text.
ROW_BYTES = 64
SHARD_SCHEMA = "shard long, first_id long, n_docs long, n_tokens long, data binary"


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the default tokenizer."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def deal(rows: DataFrame) -> DataFrame:
    """(part, id, text) of ``rows`` (id, text): parts are ranges in the order of (id, text), each one sorted."""
    total = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES)).first()[0] or 0
    n = 1 + total // (RANGE_SHARDS * SHARD_BYTES)
    # the order of prefixes is the order of texts as far as it goes: rows of one prefix stay in one range
    ranges = rows.repartitionByRange(n, F.col("id"), F.substring("text", 1, PREFIX)).sortWithinPartitions("id", "text")
    return ranges.select(F.spark_partition_id().cast("long").alias("part"), "id", "text")


def write_shards(docs: DataFrame, files: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard table of ``docs``, written and read back."""
    dealt = deal(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    most = SHARD_BYTES

    def build(batches):
        encode = coder(*files).encode
        shard, size, ids, texts = None, 0, [], []

        def done():
            coded, sizes = encode(texts)
            starts = np.concatenate([[0], np.cumsum(sizes + 1)])
            tokens = np.full(starts[-1], END, "<u2")
            tokens[np.arange(len(coded)) + np.repeat(np.arange(len(sizes)), sizes)] = coded
            data = WaveletMatrix.build(tokens, np.array([NO_ID if i is None else i for i in ids], np.int64), starts).dump()
            return pa.RecordBatch.from_pydict({"shard": [shard], "first_id": [ids[0]], "n_docs": [len(ids)], "n_tokens": [len(tokens)], "data": [data]}, schema=pa.schema([("shard", pa.int64()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())]))

        for b in batches:
            for part, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py() or ""
                own = len(text.encode()) + ROW_BYTES
                if shard is None:
                    shard = part << 32
                elif part != shard >> 32 or size + own > most:
                    yield done()
                    shard, size, ids, texts = shard + 1 if part == shard >> 32 else part << 32, 0, [], []
                size += own
                ids.append(key)
                texts.append(text)
        if ids:
            yield done()

    return cut(dealt.mapInArrow(build, SHARD_SCHEMA), "shards")


def _offsets(shards: DataFrame) -> DataFrame:
    """(shard, before): ids of all shards before, by running sums within ranges of shards."""
    return running(shards.select("shard", "n_tokens"), ["shard"], "_rank", {"n_tokens": "before"}).select("shard", "before")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; only these small rows meet the shards' offsets."""

    def read(batches):
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                store = WaveletMatrix.load(data.as_buffer())
                tokens = store.tokens().astype("<u4", copy=False)
                crc = [zlib.crc32(tokens[x:y]) for _, x, y in store.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(crc), shard)), pa.array(store.ids, mask=store.ids == NO_ID), pa.array(store.starts[:-1]), pa.array(np.diff(store.starts)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = shards.select("shard", "data").mapInArrow(read, "shard long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(_offsets(shards), "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, count) of each of ``tokens`` in the whole corpus, by rank in each file; ids are not decoded. Repeated tokens count once."""

    def count(batches):
        for b in batches:
            for data in b.column(0):
                store = WaveletMatrix.load(data.as_buffer())
                yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "count": pa.array([store.rank(t, store.n) for t in tokens], pa.int64())})

    tokens = sorted(set(tokens))
    return shards.select("data").mapInArrow(count, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))


def token_places(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, doc_id, place, at): every occurrence of ``tokens``, by select; place counts from the document's start, at from the corpus'."""

    def find(batches):
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                store = WaveletMatrix.load(data.as_buffer())
                for t in tokens:
                    places = store.places(t)
                    doc = np.searchsorted(store.starts, places, "right") - 1
                    key = store.ids[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), shard)), pa.array(np.full(len(places), t)), pa.array(key, mask=key == NO_ID), pa.array(places - store.starts[doc]), pa.array(places)], names=["shard", "token", "doc_id", "place", "within"])

    tokens = sorted(set(tokens))
    rows = shards.select("shard", "data").mapInArrow(find, "shard long, token long, doc_id long, place long, within long")
    return rows.join(_offsets(shards), "shard").select("token", "doc_id", "place", (F.col("before") + F.col("within")).alias("at"))


def tokens_at(shards: DataFrame, places: list[int]) -> DataFrame:
    """(at, token): ids at these places of the corpus, by access; places beyond it have no row."""

    def look(batches):
        for b in batches:
            for data, before, n in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                store = None
                for at in (x for x in places if before <= x < before + n):
                    store = store or WaveletMatrix.load(data.as_buffer())
                    yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "token": pa.array([store.access(at - before)], pa.int64())})

    places = sorted(set(places))
    held = F.exists(F.array(*[F.lit(x).cast("long") for x in places]), lambda x: (x >= F.col("before")) & (x < F.col("before") + F.col("n")))
    where = _offsets(shards).join(shards.select("shard", F.col("n_tokens").alias("n")), "shard").filter(held)
    return shards.select("shard", "data").join(where, "shard").select("data", "before", "n").mapInArrow(look, "at long, token long")


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(documents(spark, sf_dir), tokenizer()))
