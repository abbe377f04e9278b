"""SentencePiece encoding and decoding of a text column (see ``pieces`` for the method).

Each row by itself, without a shuffle: null and empty texts have no ids and decode to an empty text; very long texts are encoded whole; rows with
null or repeated ids and repeated rows are rows like others; no rows give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import documents, map_batches
from junctura.llm.pieces import piece_model

MODEL = "piece_bpe_32k.model"


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids of each whole text, without begin or end ids; null and empty texts have none."""

    def make(batch: pa.RecordBatch) -> dict:
        model = piece_model(path)
        flat = [model.encode(t.as_py() or "") for t in batch.column(1)]
        return {"id": batch.column(0), "ids": flat}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id", "text"], make, "id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) from (id, ids)."""

    def make(batch: pa.RecordBatch) -> dict:
        model = piece_model(path)
        return {"id": batch.column(0), "text": [model.decode(x.as_py() or []) for x in batch.column(1)]}

    return map_batches(encoded.select("id", "ids"), ["id", "ids"], make, "id long, text string")


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so that ids never leave the task."""

    def make(batch: pa.RecordBatch) -> dict:
        model = piece_model(path)
        digits = model.digits
        count, ids_sha, text_sha = [], [], []
        for t in batch.column(1):
            ids = model.encode(t.as_py() or "")
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": count, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    ready = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(ready, ["id", "text"], make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), public_tokenizers.path(MODEL))


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's pieces, one row a row of ``docs`` (null or repeated ids too); no rows give no rows."""
    return piece_digests(docs, public_tokenizers.path(MODEL))
