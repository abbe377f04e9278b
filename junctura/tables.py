"""Written tables: cut lineage where a plan is read again, and label graph components over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether shuffle files go at the end of a query, and not when the driver next collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a written table that ``cut_in_parts`` takes at once, and the most parts.
PART_BYTES, PARTS = 32 << 20, 8
_WRITTEN: list[str] = []
_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where none is named, a session on this machine alone gets a temporary one; a cluster is refused, since
    its executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-junctura-"))
    return spark.conf.get("spark.checkpoint.dir")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; ``clear`` removes it."""
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, short lineage, survives lost executors.

    Joins then know the table's size in bytes, so Spark itself broadcasts it only below its threshold. Shuffle files of the write are
    removed at its end, so that what a chain of tables holds on disk is one step's, not the sum of all.
    """
    path = new_folder(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATH_OF[table] = path
    return table


def cut_in_parts(table: DataFrame, by: list[str], step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``cut(step(table), name)`` for a ``step`` that treats rows with different ``by`` apart, over one part of these after another.

    ``table`` is one that ``cut`` gave. All of it is done; it is read once a part, and the shuffle files on disk are those of one part.
    """
    parts = parts_of(table.sparkSession, _PATH_OF[table])
    # not the hash that shuffles deal by: a part has rows for all of their tasks
    return cut_each((step(table.filter(F.pmod(F.xxhash64(*by), F.lit(parts)) == k) if parts > 1 else table) for k in range(parts)), name)


def parts_of(spark: SparkSession, path: str) -> int:
    """Parts that the files at ``path`` are worth."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(1, min(PARTS, -(-size // PART_BYTES)))


def cut_each(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """Their rows as one written table, each computed when its turn comes. One frame at least."""
    path = None
    for df in frames:
        path = path or new_folder(df.sparkSession, name)
        with shuffles_go(df.sparkSession):
            df.write.mode("append").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATH_OF[table] = path
    return table


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; the session's own setting comes back."""
    was = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, was)


def drop(table: DataFrame) -> None:
    """Removes a table that ``cut`` gave, once nothing reads it any more: the tables of rounds before the last."""
    remove(table.sparkSession, _PATH_OF.pop(table))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``new_folder`` named."""
    _WRITTEN.remove(path)
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this process wrote; what was made from them must have been read or written by then."""
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b): root is the smallest id reachable.

    Labels travel over links and over labels (pointer jumping), so that chains halve in each round. Every
    round is two joins and a written table; nothing gathers a component in one place. Repeated edges and loops do
    no harm, no edges give no rows, and edges with a null end are passed over.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u is not null and v is not null")
    both = cut(ends.union(ends.select("v", "u")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "root"), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = lower.select(F.col("id").alias("at"), F.col("root").alias("next"))
        moved = cut(lower.join(jump, lower.root == jump["at"], "left").select("id", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        labels = moved.select("id", "root")
        if moved.filter("root <> was").isEmpty():
            return labels
