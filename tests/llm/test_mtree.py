"""Top-k over the M-tree against all pairs: ties, repeats, nulls, odd lengths, large values, small pages and slices."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, branch int, ids string"
BIG = 2.0**18


def plain(rows, k, every):
    kept = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, v) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j) for b, (j, w) in enumerate(kept) if b != a)
            out += [(i, r, j, -s) for r, (s, _, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def rows(seed=3, n=400, dim=6):
    rng = random.Random(seed)
    some = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(40)]
    out = [(i, [x + rng.uniform(-0.05, 0.05) for x in rng.choice(some)]) for i in range(n)]
    out += [(1000 + i, some[0]) for i in range(60)]  # one vector many times: only ids decide
    out += [(1000, some[0]), (1000, some[0]), (1000, some[1]), (-5, some[2]), (None, some[0]), (None, some[3])]
    out += [(2000, None), (2005, [None] * dim), (2010, [math.nan] * dim), (2015, [math.inf] + [0.0] * (dim - 1)), (2020, []), (2025, [1.0]), (2030, [0.0] * dim)]
    return out


@pytest.mark.parametrize(("pivots", "slice_size", "page"), [(8, 40, 5), (1, 1000, 16), (64, 65_536, 256)])
def test_top_k_against_all_pairs(spark, pivots, slice_size, page):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows()], SCHEMA)
    assert found(mtree.top_k(df, F.col("vec_id") % 5 == 0, pivots=pivots, slice_size=slice_size, page=page)) == plain(rows(), 10, 5)


def test_large_values_stay_exact(spark):
    rng = random.Random(4)
    held = [(i, [rng.choice([BIG, -BIG, BIG / 2, 3.0]) for _ in range(5)]) for i in range(60)] + [(61, [2.0**40, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in held], SCHEMA)
    assert found(mtree.top_k(df, F.col("vec_id") % 5 == 0, pivots=4, slice_size=9, page=3)) == plain(held[:-1], 10, 5)


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, "x"), (3, [1.0, 2.0], 1, "x")], SCHEMA)
    ask = F.col("vec_id") % 5 == 0
    assert found(mtree.top_k(df, ask)) == [(0, 1, 3, 1024 * 1024 * 5)]
    assert found(mtree.top_k(df.filter("vec_id = 0"), ask)) == []
    assert found(mtree.top_k(df.filter("vec_id = 3"), ask)) == []
    assert found(mtree.top_k(df.filter("false"), ask)) == []


def test_bounds_avoid_computations():
    rng = np.random.default_rng(5)
    centres = rng.integers(-800, 800, (20, 8))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-20, 20, (4000, 8))).astype(np.int32)
    space = mtree.Space(int((x.astype(np.int64) ** 2).sum(axis=1).max()), 8)
    import pandas as pd

    frame = pd.DataFrame({"v": [r.tobytes() for r in x], "ids": [[i] for i in range(len(x))]})
    parent = space.unpack(x[0].tobytes())
    tree = mtree.Slice(space, parent)
    pages = mtree.build_pages((0, 0), frame, space, parent, 64)
    assert sum(len(p) // 32 for p in pages["entries"]) == len(x) and all(len(p) <= 64 * 32 for p in pages["entries"])
    for page in pages.to_dict("records"):
        tree.add(page)
    q = space.unpack(x[:20].tobytes())
    best = tree.search(q, np.arange(20), True, 10, np.full(20, mtree.NONE))
    for i in range(20):
        scores = x.astype(np.int64) @ x[i].astype(np.int64)
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:10]
        assert [(-int(s), int(j)) for s, j in zip(best.scores[i], best.ids[i], strict=True)] == want
    assert tree.computed < 0.5 * 20 * len(x)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(con.execute(mtree.ORACLE).fetchall(), key=str)
    assert found(mtree.op11_exact_top_k(spark, "/root/testdata/sf0.001")) == want
