"""A cleaning pipeline over ``documents``: language, near-duplicates, benchmark items, secrets, pieces.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the
columns of ``documents``. Documents without a learned language go, one document of each near-duplicate
group stays, documents that hold a benchmark item go, secrets in the remaining texts are replaced, and the
last stage encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from junctura.llm.common import documents
from junctura.llm.decontam import stage_decontam
from junctura.llm.dedup import stage_dedup
from junctura.llm.langid import stage_language
from junctura.llm.secret_scan import stage_secrets
from junctura.llm.sp_encode import stage_pieces
from junctura.tables import cut

STAGES = [
    ("language", stage_language),
    ("near-duplicates", stage_dedup),
    ("benchmark items", stage_decontam),
    ("secrets", stage_secrets),
    ("pieces", stage_pieces),
]

#: The language model and the piece encoder are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: (doc_id, n_tokens, ids_sha256, decoded_sha256) of each document that stays.

    Null texts and those without a letter go with the language stage; rows without an id are compared with no other and stay; rows that repeat an
    id stay or go together; of equal texts under several ids the smallest id stays; very long texts are taken whole; no documents give no rows; other columns are
    carried along and then left behind.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
