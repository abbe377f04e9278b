"""Helpers that the text operators share: walk Arrow batches in bounded slices, hold one model in a worker."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from typing import AnyStr, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_HELD: dict[tuple, object] = {}
#: Bytes of text and other values of an Arrow batch that are worked on at once.
SLICE_BYTES = 8 << 20


def resident(key: tuple, make: Callable[[], T]) -> T:
    """The model or memo of ``key``, made once in a Python worker.

    Spark uses workers again for later stages: what another stage left there is let go first, so that a
    worker holds one model at a time however many stages it serves.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def blocks(texts: Iterable[AnyStr], most: int) -> Iterator[tuple[int, list[AnyStr]]]:
    """(index of the first text, texts) in runs of about ``most`` bytes, or characters; a longer text is a run by itself."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text of a string column, one at a time; null counts as empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` bytes; a larger row is a run by itself."""
    size = np.full(batch.num_rows, 64, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        after = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, after - at)
        at = after


def map_batches(df: DataFrame, columns: list[str], make: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """``df[columns]`` through ``make``, which gets slices of Arrow batches and returns new columns by name, in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = make(part)
                yield pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def map_rows(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``df`` with slices of its Arrow batches changed or filtered by ``change``, which keeps the columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield change(part)

    return df.mapInArrow(run, df.schema)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with the values of column ``name`` replaced."""
    at = batch.schema.get_field_index(name)
    return pa.RecordBatch.from_arrays([values if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)
