"""Yinyang rounds against plain rounds: ties, hot vectors, odd rows, large values, bounds."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from junctura.llm import yinyang

SCHEMA = "vec_id long, embedding array<double>, cluster int, own string"


def plain(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in seeds]
    if not cents:
        return []
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for r in range(rounds + 1):
        own = [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in kept]
        if r < rounds:
            for c in range(len(cents)):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                if mine:
                    cents[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    d = [far(v, cents[o]) for (_, v), o in zip(kept, own, strict=True)]
    by = {c: sum(x for x, o in zip(d, own, strict=True) if o == c) for c in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, o, x, fits(by[o]), fits(sum(d)), sha[o]) for (i, _), o, x in zip(kept, own, d, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows(scale=1.0, n=150):
    rng = random.Random(9)
    some = [[rng.uniform(-1, 1) * scale for _ in range(3)] for _ in range(7)]
    out = [(i, [x + rng.choice([0, 0, 0.01, 0.3]) * rng.uniform(-1, 1) * scale for x in rng.choice(some)]) for i in range(n)]
    out += [(500 + i, some[0]) for i in range(50)] + [(500, some[0]), (None, some[1]), (None, some[1])]
    return out + [(900, None), (901, [None] * 3), (902, [math.nan] * 3), (903, [math.inf, 0.0, 0.0]), (904, []), (905, [1.0]), (906, [2.0**17, 0.0, 0.0])]


@pytest.mark.parametrize(("k", "rounds", "block", "group", "scale"), [(8, 6, 16, 4, 1.0), (5, 3, 4096, 1, 0.004), (6, 4, 50, 6, 100_000.0), (300, 2, 64, 9, 1.0)])
def test_rounds_against_plain_ones(spark, k, rounds, block, group, scale):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows(scale)], SCHEMA)
    assert found(yinyang.clustered(df, k, rounds, 3, block, group)) == plain(rows(scale), k, rounds, 3)


def test_no_rows_and_no_seeds(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0, 3.0], 1, "x"), (1, None, 1, "x")], SCHEMA)
    assert found(yinyang.clustered(df, 8, 2, 3)) == found(yinyang.clustered(df.filter("false"), 8, 2, 3)) == []


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(2)
    x = (rng.integers(-900, 900, (30, 6))[rng.integers(0, 30, 2000)] + rng.integers(-30, 30, (2000, 6))).astype(np.int64)
    cents = x[:24].copy()
    group = yinyang.grouped(cents)
    b = yinyang.Bounds.begin(x, cents, group)
    scanned = 0
    for _ in range(8):
        new = np.stack([x[b.own == c].sum(axis=0) // max(1, (b.own == c).sum()) if (b.own == c).any() else cents[c] for c in range(24)])
        b.scanned = 0
        b.update(x, cents, new, group)
        cents, scanned = new, scanned + b.scanned
        d = yinyang.squares(x, cents)
        assert (b.own == d.argmin(axis=1)).all()
        real = np.sqrt(d.astype(float))
        at = np.arange(len(x))
        assert (b.upper >= real[at, b.own] * (1 - 1e-9)).all()
        real[at, b.own] = np.inf
        for g in range(group.max() + 1):
            assert (b.lower[:, g] <= real[:, group == g].min(axis=1, initial=np.inf) * (1 + 1e-9)).all()
    assert scanned < 0.5 * 8 * d.size


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(con.execute(yinyang.ORACLE).fetchall(), key=str)
    assert found(yinyang.op12_yinyang_clusters(spark, "/root/testdata/sf0.001")) == want
