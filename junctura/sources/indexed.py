"""The reads file of a job and its index: which bytes lie in which part.

The report's byte ranges count through the parts of a written text folder, joined by name. The index of a folder is one row a part
(first byte, bytes), from the folder's listing; a cluster's range is cut at the parts' borders, and the pieces are read by place.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.sources import sam_bytes


def _placed(found: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for name, size in sorted(found):
        out.append((name, at, size))
        at += size
    return out


def parts(folder: str) -> list[tuple[str, int, int]]:
    """(part, first byte, bytes) of a written text folder, by name."""
    return _placed(sam_bytes.files(folder))


def write_index(spark: SparkSession, folder: str, out: str) -> None:
    """The index as a small text table (part's name, first byte, bytes), tab-separated; the folder is listed by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    rows = _placed([(f.getPath().getName(), f.getLen()) for f in listed if f.getPath().getName()[:1] not in "_."])
    listed = spark.createDataFrame(rows, "part string, first_byte long, bytes long").repartitionByRange(1, "first_byte")
    listed.select(F.concat_ws("\t", "part", F.col("first_byte").cast("string"), F.col("bytes").cast("string")).alias("value")).write.mode("overwrite").text(out)


def cluster_bytes(clusters: DataFrame, folder: str) -> DataFrame:
    """(cluster_rank, piece, value): text at each cluster's (offset_start, offset_length) in ``folder``, in pieces by part; pieces in order are its lines."""
    listed = parts(folder)
    ends = [at + n for _, at, n in listed]
    schema = "cluster_rank long, piece int, file int, position long, line_len int"

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for rank, start, n in zip(f["cluster_rank"], f["offset_start"], f["offset_length"], strict=True):
                k, piece, stop = bisect.bisect_right(ends, start), 0, start + n
                while start < stop and k < len(listed):
                    upto = min(stop, ends[k])
                    while start < upto:  # pieces of 64 MB
                        step = min(upto - start, 1 << 26)
                        rows.append((rank, piece, k, start - listed[k][1], step + 1))
                        piece, start = piece + 1, start + step
                    k += 1
            yield pd.DataFrame(rows, columns=["cluster_rank", "piece", "file", "position", "line_len"])

    pieces = clusters.select(F.col("cluster_rank").cast("long").alias("cluster_rank"), "offset_start", "offset_length").mapInPandas(run, schema)
    return sam_bytes.fetch(pieces, folder).select("cluster_rank", "piece", "value")
