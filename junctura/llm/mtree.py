"""Exact top-k by inner product over an M-tree: paged metric nodes, searched best first.

Inner products become distances: with M the largest norm, x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0), so that
|q - x|^2 = |q|^2 + M^2 - 2 q.x, and the highest score is the smallest distance. All scores are integers and exact; distances
only decide what can be passed over, with a margin (SLACK) far above their rounding.

The tree has three levels below its root. Branches: each of PIVOTS routing vectors (those with the smallest hashes, so no
sample is drawn anew by a lost executor) and the vectors nearest to it. Slices: a branch of more than SLICE vectors is dealt by hash to as many slices
as it needs, so that a hot branch is not one task; one slice is one group of bounded size. Pages: within a slice, leaves of about PAGE vectors, each one row of a
written table with its routing vector, covering radius and distance to its parent, and its entries with theirs.

A search takes blocks of queries that are near each other. It first goes to each query's own slice, which gives it a k-th best score, then to
the slices whose branch's bound (distance less radius) that score does not rule out. Within a slice, a page is passed over without any computation where
the stored distance to its parent, the page's radius and the query's distance to the parent rule it out (triangle inequality), then by its own distance and
radius; entries likewise by theirs. Each query's best pages come first, the rest in order of their bounds.

Rows with a null vector, or one with a null or non-finite component, take no part; nor do vectors whose integer form has a squared norm of 2^62 or more,
whose scores need not fit a long. Shorter vectors count as padded with zeros. Equal vectors are one entry with its k + 1 smallest ids, which
are all that can be among k best with ties to smaller ids; repeated rows are rows of their own (each a candidate of the others);
null ids come after all others and are never queries. No rows, or no queries, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.tables import cut

PIVOTS, SLICE, PAGE = 64, 65_536, 256
#: Queries of a block; a slice's pages serve blocks of this many at once.
BLOCK = 512
#: Queries that one task of a slice takes: pages are repeated once for each such group.
GROUP = 1 << 17
#: Distances may be wrong by less than this share of the largest norm.
SLACK = 1e-6
#: Best pages that each query visits by itself before pages are taken in turn.
FIRST = 2
NO_ID = (1 << 63) - 1
NONE = -(1 << 63)
QUERY = "uid long, query_id long, branch int, slice int, v binary"
FOUND = "uid long, query_id long, branch int, slice int, v binary, scores array<long>, ids array<long>"


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of each component as int, null for a vector that takes no part."""
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 2.0**21))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("int"))
    norm = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(sound & (F.when(sound, norm) < 2.0**62), F.when(sound, whole))


class Space:
    """Distances of a set of vectors with largest squared norm ``top`` (an integer) and ``dim`` components."""

    def __init__(self, top: int, dim: int) -> None:
        self.top, self.dim = top, max(dim, 1)
        self.slack = SLACK * max(top, 1) ** 0.5
        #: float64 holds all sums of such products exactly, and multiplies faster
        self.kind = np.float64 if top < 2**53 else np.int64

    def unpack(self, packed: bytes | list[bytes]) -> np.ndarray:
        data = packed if isinstance(packed, bytes) else b"".join(packed)
        return np.frombuffer(data, np.int32).reshape(-1, self.dim).astype(self.kind)

    def pack(self, vectors: list) -> list[bytes]:
        """Bytes of each vector, padded with zeros."""
        out = np.zeros((len(vectors), self.dim), np.int32)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return [r.tobytes() for r in out]

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of stored vectors."""
        na, nb = self.norms(a), self.norms(b)
        up = np.sqrt(np.maximum(self.top - na, 0))[:, None] - np.sqrt(np.maximum(self.top - nb, 0))[None]
        return np.sqrt(np.maximum(na[:, None] + nb[None] - 2.0 * self.scores(a, b) + up * up, 0))

    def from_queries(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.distance(self.norms(q)[:, None], self.scores(q, x))

    def distance(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norms + float(self.top) - 2.0 * scores, 0))

    @staticmethod
    def norms(x: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1).astype(np.float64)

    @staticmethod
    def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a @ b.T


def leaves(x: np.ndarray, space: Space, size: int) -> list[np.ndarray]:
    """Row numbers of leaves of at most ``size`` rows: rows go to the nearest of some of them, again within parts that are too large; distinct rows that no routing row parts are cut in order."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        k = min(64, -(-2 * len(rows) // size))
        near = space.between(x[rows], x[rows[np.linspace(0, len(rows) - 1, k).astype(int)]]).argmin(axis=1)
        parts = [rows[near == j] for j in range(k)]
        parts = [p for p in parts if len(p)]
        todo += parts if len(parts) > 1 else np.array_split(rows, -(-len(rows) // size))
    return done


def build_pages(key: tuple, rows: pd.DataFrame, space: Space, parent: np.ndarray, size: int) -> pd.DataFrame:
    """Pages of one slice. ``parent``: its branch's routing vector."""
    x = space.unpack(rows["v"].tolist())
    ids = rows["ids"].tolist()
    out = []
    for number, at in enumerate(leaves(x, space, size)):
        own = x[at]
        centre = own[space.between(own, own.mean(axis=0, keepdims=True).astype(own.dtype)).argmin()][None]
        to_centre = space.between(own, centre)[:, 0]
        order = np.argsort(to_centre, kind="stable")
        listed = [np.asarray(ids[i], np.int64) for i in at[order]]
        out.append(
            {
                "branch": key[0], "slice": key[1], "page": number, "centre": centre.astype(np.int32).tobytes(), "radius": float(to_centre.max()), "to_parent": float(space.between(centre, parent)[0, 0]),
                "entries": own[order].astype(np.int32).tobytes(), "to_centre": to_centre[order].tobytes(), "n_ids": np.array([len(i) for i in listed], np.int32).tobytes(), "ids": np.concatenate(listed).tobytes(),
            }
        )
    return pd.DataFrame(out, columns=PAGE_COLUMNS)


PAGE_COLUMNS = ["branch", "slice", "page", "centre", "radius", "to_parent", "entries", "to_centre", "n_ids", "ids"]
PAGES = "branch int, slice int, page int, centre binary, radius double, to_parent double, entries binary, to_centre binary, n_ids binary, ids binary"


class Best:
    """The k best (score, id) of each query of a block, best first; absent ones have the least score."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.scores, self.ids, self.floor = k, np.full((n, k), NONE, np.int64), np.full((n, k), NO_ID, np.int64), floor

    def limit(self) -> np.ndarray:
        """A score below this cannot enter (one that equals it can, by its id)."""
        return np.maximum(self.scores[:, -1], self.floor)

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (query, score, id), any number of each query."""
        at = np.unique(q)
        q = np.concatenate([np.repeat(at, self.k), q])
        s = np.concatenate([self.scores[at].ravel(), scores])
        i = np.concatenate([self.ids[at].ravel(), ids])
        order = np.lexsort((i, ~s, q))  # ~s turns the order of all longs round
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, at)
        take = (first[:, None] + np.arange(self.k)).ravel()
        self.scores[at], self.ids[at] = s[take].reshape(-1, self.k), i[take].reshape(-1, self.k)


class Slice:
    """The pages of a slice, ready to be searched. ``visited`` and ``computed`` count pages and scores."""

    def __init__(self, space: Space, parent: np.ndarray) -> None:
        self.space, self.parent, self.pages, self.visited, self.computed = space, parent, [], 0, 0
        self.centres = self.radius = self.to_parent = None

    def add(self, page: dict) -> None:
        n_ids = np.frombuffer(page["n_ids"], np.int32)
        self.pages.append((page["centre"], page["radius"], page["to_parent"], self.space.unpack(page["entries"]).astype(np.int32), np.frombuffer(page["to_centre"]), np.concatenate([[0], np.cumsum(n_ids)]), np.frombuffer(page["ids"], np.int64)))

    def search(self, q: np.ndarray, query_ids: np.ndarray, own: bool, k: int, floor: np.ndarray) -> Best:
        """``own``: the queries' own rows are in this slice, and are not among their candidates. ``floor``: scores below it are not asked for."""
        space = self.space
        if self.centres is None:
            self.centres = space.unpack([p[0] for p in self.pages])
            self.radius, self.to_parent = np.array([p[1] for p in self.pages]), np.array([p[2] for p in self.pages])
        best, norms = Best(len(q), k, floor), space.norms(q)

        def reach() -> np.ndarray:
            limit = best.limit()
            return np.where(limit == NONE, np.inf, space.distance(norms, limit.astype(np.float64)) + space.slack)

        up = space.from_queries(q, self.parent)  # one column
        bound = np.abs(up - self.to_parent[None]) - self.radius[None]
        far = np.full(bound.shape, np.inf)
        near = bound <= reach()[:, None]
        some = near.any(axis=0)
        far[:, some] = space.from_queries(q, self.centres[some])
        bound = np.where(near, np.maximum(bound, far - self.radius[None]), np.inf)

        def visit(page: int, who: np.ndarray) -> None:
            _, _, _, entries, to_centre, starts, ids = self.pages[page]
            self.visited += len(who)
            within = reach()[who]
            need = np.abs(far[who, page][:, None] - to_centre[None]) <= within[:, None]
            cols = np.flatnonzero(need.any(axis=0))
            if not len(cols):
                return
            x = entries[cols].astype(space.kind)
            scores = space.scores(q[who], x).astype(np.int64)
            self.computed += scores.size
            i, j = np.nonzero(scores >= best.limit()[who][:, None])
            if not len(i):
                return
            s, n = scores[i, j], np.diff(starts)[cols[j]]
            at = np.repeat(starts[cols[j]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, s, found, entry = np.repeat(i, n), np.repeat(s, n), ids[at], np.repeat(j, n)
            keep = np.ones(len(i), bool)
            if own:
                same = (found == query_ids[who][i]) & (s == norms[who][i]) & (space.norms(x)[entry] == s)
                if same.any():
                    same = np.flatnonzero(same)
                    same = same[(x[entry[same]] == q[who[i[same]]]).all(axis=1)]
                    keep[same[np.unique(i[same], return_index=True)[1]]] = False  # one row of those with this id and vector is the query
            if keep.any():
                best.offer(who[i[keep]], s[keep], found[keep])

        for _ in range(FIRST):
            page = bound.argmin(axis=1)
            least = bound[np.arange(len(q)), page]
            who = np.flatnonzero((least <= reach()) & np.isfinite(least))
            for p in np.unique(page[who]):
                visit(p, who[page[who] == p])
            bound[who, page[who]] = np.inf
        for p in np.argsort(bound.min(axis=0), kind="stable"):
            who = np.flatnonzero((bound[:, p] <= reach()) & np.isfinite(bound[:, p]))
            if len(who):
                visit(p, who)
        return best


def _blocks(queries: DataFrame, make, schema: str) -> DataFrame:
    """Blocks of at most BLOCK queries of one branch and slice, in the order of rows; ``make`` gets their columns and gives rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == BLOCK or (row["branch"], row["slice"]) != (held[0]["branch"], held[0]["slice"])):
                    yield pa.RecordBatch.from_pylist(make(held), schema=arrow)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(make(held), schema=arrow)

    return queries.repartition("branch", "slice").sortWithinPartitions("branch", "slice").mapInArrow(run, schema)


BLOCKS = "branch int, slice int, page int, part int, uids binary, query_ids binary, homes binary, vectors binary, floors binary"


def _block(rows: list[dict], branch: int, k: int) -> dict:
    floors = [r["scores"][-1] if len(r.get("scores") or ()) == k else NONE for r in rows]
    longs = lambda xs: np.array(xs, np.int64).tobytes()
    homes = np.array([(r["branch"], r["slice"]) for r in rows], np.int32).tobytes()
    return {"branch": branch, "slice": None, "page": None, "part": None, "uids": longs([r["uid"] for r in rows]), "query_ids": longs([r["query_id"] for r in rows]), "homes": homes, "vectors": b"".join(r["v"] for r in rows), "floors": longs(floors)}


def _search(pages: DataFrame, blocks: DataFrame, space: Space, pivots: np.ndarray, k: int, groups: int) -> DataFrame:
    """One row a query and slice with at least one candidate. A task streams: a slice's pages first, then the blocks that ask for it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(FOUND))

    def answer(tree: Slice, row: dict, key: tuple) -> Iterator[pa.RecordBatch]:
        q, ids = space.unpack(row["vectors"]), np.frombuffer(row["query_ids"], np.int64)
        own = bool((np.frombuffer(row["homes"], np.int32).reshape(-1, 2) == key).all())
        best = tree.search(q, ids, own, k, np.frombuffer(row["floors"], np.int64))
        n = (best.scores > NONE).sum(axis=1)
        some = np.flatnonzero(n)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n[some])]), pa.int32())
        held = np.arange(k)[None] < n[some][:, None]
        size = len(q[0]) * 4
        home = np.frombuffer(row["homes"], np.int32).reshape(-1, 2)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(m[some][held])) for m in (best.scores, best.ids)]
        columns = [pa.array(np.frombuffer(row["uids"], np.int64)[some]), pa.array(ids[some]), pa.array(home[some, 0]), pa.array(home[some, 1]), pa.array([row["vectors"][i * size : (i + 1) * size] for i in some], pa.binary()), *lists]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                key = (row["branch"], row["slice"], row["part"])
                if key != now:
                    tree, now = Slice(space, pivots[row["branch"]][None]), key
                if row["entries"] is not None:
                    tree.add(row)
                else:
                    yield from answer(tree, row, key[:2])

    extra = ["uids", "query_ids", "homes", "vectors", "floors"]
    nodes = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*PAGE_COLUMNS, "part", *[F.lit(None).cast("binary").alias(c) for c in extra])
    asked = blocks.select("branch", "slice", F.lit(None).cast("int").alias("page"), *[F.lit(None).cast(t).alias(c) for c, t in zip(PAGE_COLUMNS[3:], ["binary", "double", "double", *["binary"] * 4], strict=True)], "part", *extra)
    by = ["branch", "slice", "part"]
    return nodes.union(asked).repartition(*by).sortWithinPartitions(*by, F.asc_nulls_last("page")).mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, slice_size: int = SLICE, page: int = PAGE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row of ``vectors`` for which ``is_query`` holds, with every other row."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), scaled(F.col(vector_col)).alias("v"), (is_query & F.col(id_col).isNotNull()).alias("ask")).filter("v is not null")
    few = Window.partitionBy("v").orderBy("id", F.desc("ask"))
    listed = rows.withColumn("_n", F.row_number().over(few)).filter(F.col("_n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = cut(listed, "vectors")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    top, dim = entries.agg(F.max(norm), F.max(F.size("v"))).first()
    if top is None:
        return spark.createDataFrame([], result)
    space = Space(int(top), int(dim))
    routing = space.unpack(space.pack([r.v for r in entries.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots).collect()]))

    def placed(df: DataFrame, keep: str, columns: list[str]) -> DataFrame:
        """``df`` with its packed vector, the branch of the nearest routing vector, and the distance."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), 4096):
                    part = f.iloc[at : at + 4096].reset_index(drop=True)
                    packed = space.pack(part["v"].tolist())
                    d = space.between(space.unpack(packed), routing) if len(part) else np.zeros((0, 1))
                    near = d.argmin(axis=1)
                    yield part[columns].assign(v=packed, branch=near.astype(np.int32), far=d[np.arange(len(part)), near])

        return df.mapInPandas(run, f"{keep}, v binary, branch int, far double")

    held = cut(placed(entries, "ids array<long>", ["ids"]), "branches")
    branches = {r.branch: (r.n, r.radius) for r in held.groupBy("branch").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    slices = {b: -(-n // slice_size) for b, (n, _) in branches.items()}
    count = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(slices.items()) for x in pair]), F.col("branch"))
    dealt = F.pmod(F.xxhash64("v"), count).cast("int").alias("slice")

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return build_pages(key, f, space, routing[key[0]][None], page)

    pages = cut(held.select("branch", dealt, "v", "ids").groupBy("branch", "slice").applyInPandas(build, PAGES), "pages")
    asking = rows.filter("ask").select("id", "v").withColumn("uid", F.monotonically_increasing_id())
    asked = cut(placed(asking, "uid long, id long", ["uid", "id"]).select("uid", F.col("id").alias("query_id"), "branch", dealt, "v"), "queries")
    n = asked.count()
    groups = max(1, -(-n // GROUP))
    part = F.pmod(F.xxhash64("uids"), F.lit(groups)).cast("int")

    def home(block: list[dict]) -> list[dict]:
        return [_block(block, block[0]["branch"], k) | {"slice": block[0]["slice"]}]

    first = cut(_search(pages, _blocks(asked, home, BLOCKS).withColumn("part", part), space, routing, k, groups), "first")
    # a query alone in its slice has found nothing, and goes on without a limit
    begun = asked.join(first.select("uid", "scores"), "uid", "left")
    order = sorted(branches)
    radius = np.array([branches[b][1] for b in order])

    def others(block: list[dict]) -> list[dict]:
        made = _block(block, 0, k)
        q, floors = space.unpack(made["vectors"]), np.frombuffer(made["floors"], np.int64)
        within = np.where(floors == NONE, np.inf, space.distance(space.norms(q), floors.astype(np.float64)) + space.slack)
        near = space.from_queries(q, routing[order]) - radius[None] <= within[:, None]
        out = []
        for j, b in enumerate(order):
            who = np.flatnonzero(near[:, j])
            if len(who):
                out += [_block([block[i] for i in who], b, k) | {"slice": s} for s in range(slices[b]) if (b, s) != (block[0]["branch"], block[0]["slice"])]
        return out

    second = _search(pages, _blocks(begun, others, BLOCKS).withColumn("part", part), space, routing, k, groups)
    pairs = first.unionByName(second).select("uid", "query_id", F.explode(F.arrays_zip("scores", "ids")).alias("c")).select("uid", "query_id", F.col("c.scores").alias("score"), F.col("c.ids").alias("vec_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), scored AS (
  SELECT q.u, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.u <> c.u
), ranked AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
