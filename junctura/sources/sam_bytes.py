"""Lines of text files with their byte positions, and the lines at given positions.

``read`` is a data source whose partitions are byte ranges of the files: a range holds the lines that begin in it, so that each
line is in one range, however ranges fall. ``fetch`` goes the other way: it sorts the wanted positions, deals them out by ranges of
(file, position) and reads those bytes alone, near ones at once.

Files are numbered by their sorted paths. Only ``\\n`` ends a line; a last line may lack it. Names that begin with ``_`` or ``.`` are passed
over, as Spark does. Paths with a scheme are opened by Arrow's file systems (s3, gs, hdfs and others), others as local or mounted files;
driver and executors must reach the same files. Empty files have no lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

LINE = "file int, position long, line_len int, value string"
ARROW = pa.schema([("file", pa.int32()), ("position", pa.int64()), ("line_len", pa.int32()), ("value", pa.string())])
#: Bytes of a range (a task's share of a file), and of one read within it.
RANGE, CHUNK = 128 << 20, 8 << 20
#: Wanted lines at most so far apart are read at once.
GAP = 64 << 10


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder, by path."""
    system, at = _system(path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = system.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(name[:1] in "_." for name in p[len(at) :].split("/") if name)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in below if f.type == fs.FileType.File and not hidden(f.path))


def lines_of(handle: pa.NativeFile, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(positions, values) of the lines that begin in [start, end), in runs of about ``chunk`` bytes; no more than that and one line is held."""
    base = start
    if start:
        base -= 1  # a line begins at ``start`` if the byte before ends one
        while True:
            data = handle.read_at(chunk, base)
            at = data.find(b"\n")
            if at >= 0:
                base += at + 1
                break
            if len(data) < chunk:
                return
            base += len(data)
    pieces, held, at = [], 0, base
    while base < end:
        data = handle.read_at(chunk, at)
        at += len(data)
        last = len(data) < chunk
        cut = data.rfind(b"\n") + 1
        if not cut and not last:
            pieces.append(data)
            held += len(data)
            continue
        whole = b"".join([*pieces, data[:cut]])
        tail = data[cut:]
        if last and (tail or (pieces and not cut)):
            whole, tail = whole + tail + b"\n", b""
        if whole:
            starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(whole, np.uint8) == 10) + 1]).astype(np.int32)
            n = int(np.searchsorted(starts[:-1] + np.int64(base), end))
            values = pa.StringArray.from_buffers(n, pa.py_buffer(starts[: n + 1]), pa.py_buffer(whole))
            yield starts[:n] + np.int64(base), pc.ascii_rtrim(values, "\n")
        base += len(whole)
        pieces, held = [tail] if tail else [], len(tail)
        if last:
            return


@dataclass
class Range(InputPartition):
    path: str
    file: int
    start: int
    end: int


class LineReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return [Range(p, k, at, min(at + self.size, n)) for k, (p, n) in enumerate(files(self.path)) for at in range(0, n, self.size)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.end:
            return
        system, at = _system(partition.path)
        with system.open_input_file(at) as handle:
            for positions, values in lines_of(handle, partition.start, partition.end):
                size = pc.add(pc.binary_length(values), 1).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), partition.file, np.int32)), pa.array(positions), size, values], schema=ARROW)


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "positioned_lines"

    def schema(self) -> str:
        return LINE

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("range", RANGE)))


def read(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, position, line_len, value) of all lines; ``line_len`` counts the line's end."""
    spark.dataSource.register(Lines)
    return spark.read.format(Lines.name()).option("range", str(size)).load(path)


def _fetched(handle: pa.NativeFile, positions: np.ndarray, lengths: np.ndarray) -> Iterator[str]:
    """Text at each (position, length), which come in order."""
    first = 0
    while first < len(positions):
        after = first + 1
        while after < len(positions) and positions[after] - (positions[after - 1] + lengths[after - 1]) <= GAP and positions[after] + lengths[after] - positions[first] <= CHUNK:
            after += 1
        begin = int(positions[first])
        data = handle.read_at(int(positions[after - 1] + lengths[after - 1]) - begin, begin)
        for p, n in zip(positions[first:after].tolist(), lengths[first:after].tolist(), strict=True):
            yield data[p - begin : p - begin + n].decode("utf-8", "replace")
        first = after


def fetch(wanted: DataFrame, path: str, value: str = "value") -> DataFrame:
    """``wanted`` (file, position, line_len and any other columns) with the lines at those places, read from ``path`` by ranges; nothing else of it is read."""
    names = [p for p, _ in files(path)]
    schema = StructType([*wanted.schema.fields, StructField(value, StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, now = None, None
        for batch in batches:
            file = batch.column("file").to_numpy()
            position, length = batch.column("position").to_numpy(), batch.column("line_len").to_numpy() - 1
            texts: list[str] = []
            for part in np.split(np.arange(len(file)), np.flatnonzero(np.diff(file)) + 1):
                if not len(part):
                    continue
                if file[part[0]] != now:
                    now = file[part[0]]
                    system, at = _system(names[now])
                    handle = system.open_input_file(at)
                texts += _fetched(handle, position[part], length[part])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=arrow)

    return wanted.repartitionByRange("file", "position").sortWithinPartitions("file", "position").mapInArrow(run, schema)
