"""Centroid clustering by Lloyd rounds with Yinyang bounds, exact over integers.

Centroids are put into groups once. Each vector keeps its centroid, an upper bound of the distance to it, and one lower bound a group:
of the distances to the group's other centroids. Centroids' moves loosen the bounds; a vector whose upper bound lies below all
lower ones stays where it is (global filter); else its own distance is made exact and it is tried again; then only groups whose lower bound does not rule them
out are looked at (group filter), and within them only centroids that the bound before their own moves does not rule out (local filter).
Those are scanned by exact integer distances; ties go to the smaller number, so bounds only rule out what is strictly farther (by SLACK).

Vectors are packed once, BLOCK of them a row. A round is one pass over the table of the round before: no shuffle but of the blocks' sums, one
small row a centroid; it writes vectors and bounds anew, so that a lost executor costs a task, and the older table goes when the newer one is there.
A hot vector or cluster is no key of anything.

Vectors that are null, have another length than ``dim``, or a null or non-finite component take no part; nor do those with a component of 2^27 or more
in integer form, whose squared distances need not fit a long. Null and repeated ids are rows like others; a null id is no seed; fewer vectors than
centroids give fewer centroids. Empty centroids stay where they are. No vectors give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from junctura.tables import cut, drop

BLOCK = 4096
#: Centroids of a group, on average.
GROUP = 4
#: Bounds are floats of exact squares; they may be wrong by less than this share.
SLACK = 1e-9
STATE = "ids binary, known binary, v binary, own binary, upper binary, lower binary, sums array<long>, counts array<long>"


def integers(vector: Column, dim: int) -> Column:
    """floor(1024 * x) of each component as int; null for a vector that takes no part."""
    sound = vector.isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 2.0**17))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("int")))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, centroid) as int64; by products in float64 where those hold all sums exactly."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * largest * largest * max(x.shape[1], 1) < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def grouped(centroids: np.ndarray, size: int = GROUP) -> np.ndarray:
    """Group of each centroid: five rounds over the centroids themselves, once."""
    t = max(1, -(-len(centroids) // size))
    middle = centroids[np.linspace(0, len(centroids) - 1, t).astype(int)].astype(np.float64)
    for _ in range(5):
        near = ((centroids[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.stack([centroids[near == g].mean(axis=0) if (near == g).any() else middle[g] for g in range(t)])
    return np.unique(near, return_inverse=True)[1]


class Bounds:
    """Centroids and bounds of a block's vectors. ``scanned``: exact distances computed."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        self.own, self.upper, self.lower, self.scanned = own, upper, lower, 0

    @classmethod
    def begin(cls, x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> Bounds:
        d = squares(x, centroids)
        own = d.argmin(axis=1)
        upper = np.sqrt(d[np.arange(len(x)), own].astype(np.float64))
        rest = np.sqrt(d.astype(np.float64))
        rest[np.arange(len(x)), own] = np.inf
        lower = np.stack([rest[:, group == g].min(axis=1, initial=np.inf) for g in range(group.max(initial=-1) + 1)], axis=1)
        out = cls(own.astype(np.int32), upper, lower)
        out.scanned = d.size
        return out

    def update(self, x: np.ndarray, old: np.ndarray, new: np.ndarray, group: np.ndarray) -> None:
        """Centroids moved from ``old`` to ``new``: bounds, and nearest centroids, by the three filters."""
        move = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        n_groups = self.lower.shape[1]
        drift = np.array([move[group == g].max(initial=0) for g in range(n_groups)])
        before = self.lower
        self.upper = self.upper + move[self.own]
        self.lower = np.maximum(self.lower - drift[None], 0)
        at = np.flatnonzero(self.upper * (1 + SLACK) >= self.lower.min(axis=1) * (1 - SLACK))  # global filter
        if not len(at):
            return
        exact = np.zeros(len(x), np.int64)
        for c in np.unique(self.own[at]):
            some = at[self.own[at] == c]
            exact[some] = squares(x[some], new[c : c + 1])[:, 0]
        self.scanned += len(at)
        self.upper[at] = np.sqrt(exact[at].astype(np.float64))
        at = at[self.upper[at] * (1 + SLACK) >= self.lower[at].min(axis=1) * (1 - SLACK)]
        best, own = exact.copy(), self.own.copy()
        for g in range(n_groups):
            look = at[np.sqrt(best[at].astype(np.float64)) * (1 + SLACK) >= self.lower[at, g] * (1 - SLACK)]  # group filter
            if not len(look):
                continue
            # the least of what is scanned, and what the local filter passed over, bounds the group's other centroids
            second = np.full(len(look), np.inf)
            members = np.flatnonzero(group == g)
            for c in members:
                mine = self.own[look] == c
                gone = mine & (own[look] != c)  # it has lost its place to another group's
                second[gone] = np.minimum(second[gone], np.sqrt(exact[look[gone]].astype(np.float64)))
                far = before[look, g] - move[c]
                skip = ~mine & (far * (1 - SLACK) > np.sqrt(best[look].astype(np.float64)) * (1 + SLACK))  # local filter
                second = np.where(skip, np.minimum(second, far), second)
                some = np.flatnonzero(~skip & ~mine)
                if not len(some):
                    continue
                d = squares(x[look[some]], new[c : c + 1])[:, 0]
                self.scanned += len(some)
                rows = look[some]
                wins = (d < best[rows]) | ((d == best[rows]) & (c < own[rows]))
                # the one that loses its place bounds its own group from below
                lost, lost_at = own[rows[wins]], np.sqrt(best[rows[wins]].astype(np.float64))
                same = group[lost] == g
                second[some[wins][same]] = np.minimum(second[some[wins][same]], lost_at[same])
                other = rows[wins][~same]
                self.lower[other, group[lost[~same]]] = np.minimum(self.lower[other, group[lost[~same]]], lost_at[~same])
                second[some[~wins]] = np.minimum(second[some[~wins]], np.sqrt(d[~wins].astype(np.float64)))
                best[rows[wins]], own[rows[wins]] = d[wins], c
            self.lower[look, g] = second
        self.own = own
        self.upper[at] = np.sqrt(best[at].astype(np.float64))


def _map(df: DataFrame, change, schema: str) -> DataFrame:
    """Rows of blocks, one at a time."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield change(batch.slice(i, 1).to_pylist()[0], arrow)

    return df.mapInArrow(run, schema)


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ids, known, v): blocks of rows (id, v), in the order and partitions in which they come."""
    schema = "ids binary, known binary, v binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, known = table.column("id").fill_null(0).to_numpy(), table.column("id").is_valid().to_numpy()
            v = table.column("v").combine_chunks().flatten().to_numpy()
            return pa.RecordBatch.from_pylist([{"ids": ids.astype(np.int64).tobytes(), "known": known.astype(np.bool_).tobytes(), "v": v.astype(np.int32).tobytes()}], schema=arrow)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == block:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return rows.select("id", "v").mapInArrow(run, schema)


def _vectors(row: dict, dim: int) -> np.ndarray:
    return np.frombuffer(row["v"], np.int32).reshape(-1, dim).astype(np.int64)


def _bounds(row: dict) -> Bounds:
    own = np.frombuffer(row["own"], np.int32)
    return Bounds(own.copy(), np.frombuffer(row["upper"], np.float64).copy(), np.frombuffer(row["lower"], np.float64).reshape(len(own), -1).copy())


def _assigned(table: DataFrame, dim: int, old: np.ndarray | None, new: np.ndarray, group: np.ndarray) -> DataFrame:
    """STATE of each block after assignment to ``new`` (from the state at ``old``, or from nothing), with the sums and counts of its clusters."""

    def change(row: dict, arrow: pa.Schema) -> pa.RecordBatch:
        x = _vectors(row, dim)
        if old is None:
            bounds = Bounds.begin(x, new, group)
        else:
            bounds = _bounds(row)
            bounds.update(x, old, new, group)
        sums = np.stack([x[bounds.own == c].sum(axis=0) for c in range(len(new))])
        counts = np.bincount(bounds.own, minlength=len(new))
        state = {"own": bounds.own.tobytes(), "upper": bounds.upper.tobytes(), "lower": bounds.lower.tobytes(), "sums": sums.ravel().tolist(), "counts": counts.tolist()}
        return pa.RecordBatch.from_pylist([{"ids": row["ids"], "known": row["known"], "v": row["v"], **state}], schema=arrow)

    return _map(table, change, STATE)


def _total(table: DataFrame, column: str, n: int) -> np.ndarray:
    """Sums of the arrays of all blocks, place by place: ``n`` numbers, as many as the centroids have components."""
    rows = table.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = [0] * n
    for r in rows:
        out[r.k] = int(r.x)
    return out


def cluster(vectors: DataFrame, seeds: np.ndarray, rounds: int, id_col: str = "vec_id", vector_col: str = "v", block: int = BLOCK, group_size: int = GROUP) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), final centroids) of integer vectors with as many components as ``seeds``: ``rounds`` times assign and average, then assign."""
    k, dim = seeds.shape
    group, centroids, old = grouped(seeds, group_size), seeds.astype(np.int64), None
    table = cut(packed(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), block), "blocks")
    for number in range(rounds + 1):
        after = cut(_assigned(table, dim, old, centroids, group), "bounds")
        drop(table)
        table, old = after, centroids
        if number < rounds:
            counts, sums = _total(table, "counts", k), _total(table, "sums", k * dim)
            centroids = np.array([[s // counts[c] for s in sums[c * dim : c * dim + dim]] if counts[c] else old[c].tolist() for c in range(k)], np.int64)
    last = centroids

    def unpack(row: dict, arrow: pa.Schema) -> pa.RecordBatch:
        x, own = _vectors(row, dim), np.frombuffer(row["own"], np.int32)
        distance = np.zeros(len(x), np.int64)
        for c in np.unique(own):
            distance[own == c] = squares(x[own == c], last[c : c + 1])[:, 0]
        ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], np.bool_))
        return pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(distance)], schema=arrow)

    return _map(table.select("ids", "known", "v", "own"), unpack, "id long, cluster int, distance long"), last


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8, 10)


def clustered(embeddings: DataFrame, k: int, rounds: int, dim: int = 64, block: int = BLOCK, group_size: int = GROUP) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of (vec_id, embedding); seeds are the k least sha256 of ``3:<vec_id>``, equal ones by vector.

    An inertia that does not fit a long is null.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), dim).alias("v")).filter("v is not null")
    first = rows.filter("vec_id is not null").orderBy(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return embeddings.sparkSession.createDataFrame([], schema)
    found, centroids = cluster(rows, np.array([r.v for r in first], np.int64), rounds, "vec_id", "v", block, group_size)
    found = cut(found, "clusters")
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(sums.values())
    fits = lambda x: x if x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, fits(d), fits(total), digest[c]) for c, d in sums.items()]  # one row a centroid
    about = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.withColumnRenamed("id", "vec_id").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


ORACLE = """
WITH RECURSIVE vecs AS MATERIALIZED (
  SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), cents AS (
  SELECT 0 AS r, CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INT) AS c, v FROM (SELECT * FROM vecs WHERE vec_id IS NOT NULL ORDER BY sha256('3:' || vec_id), v LIMIT 8)
  UNION ALL
  SELECT r + 1, c, coalesce(mean, v) FROM (
    WITH now AS (SELECT r, c, v FROM cents WHERE r < 10),
    far AS (SELECT u, x.v, c, row_number() OVER (PARTITION BY u ORDER BY list_sum(list_transform(list_zip(x.v, now.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c) AS k FROM vecs x, now),
    parts AS (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM far WHERE k = 1),
    sums AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM parts GROUP BY c, i),
    means AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean FROM sums GROUP BY c)
    SELECT now.r, now.c, now.v, mean FROM now LEFT JOIN means ON now.c = means.c
  )
), last AS (SELECT c, v FROM cents WHERE r = 10),
far AS (SELECT u, vec_id, c, CAST(list_sum(list_transform(list_zip(x.v, last.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM vecs x, last),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d, c) AS k FROM far) WHERE k = 1)
SELECT vec_id, own.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY own.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(last.v, ',')) AS centroid_sha256
FROM own JOIN last ON own.c = last.c
"""
