"""Queries against their SQL on the smallest tables."""

import functools
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from junctura.plans import oracles
from junctura.plans import queries as plans
from junctura.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = sorted(oracles.ORACLES)


@pytest.fixture(scope="module", autouse=True)
def shared_steps():
    """Steps that most queries begin with give written tables; one of each serves all tests here."""
    patch = pytest.MonkeyPatch()
    for step in (plans.kept, plans.close, plans.gene_bins, plans.summary):
        patch.setattr(plans, step.__name__, functools.cache(step))
    yield
    patch.undo()


def norm(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "part", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == columns
    assert norm(got.select(columns).collect()) == norm([[r[at.index(c)] for c in columns] for r in want.fetchall()])


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_detection_query_has_sql():
    assert set(QUERIES) == set(oracles.ORACLES)


def test_set_cover_agrees_with_the_loop(spark):
    from junctura.plans import queries as q
    from tests.test_operators import sequential_cover

    rows = [tuple(r) for r in q.close(spark, SF).select("g", "m", "coord", "mcoord").collect()]
    want = {}
    for r in sequential_cover(rows, 5):
        want[r[:2]] = want.get(r[:2], 0) + 1
    assert {(r.g, r.m): r.n for r in q.set_cover(spark, SF).collect()} == want


def test_entry_without_a_library_of_the_text_operators():
    """A library that is not installed costs the text queries and a warning; the others stay."""
    code = "import sys, warnings; sys.modules['sentencepiece'] = None; warnings.simplefilter('error'); warnings.filterwarnings('always', message='text operators are left out')\nimport __spark_entry__ as e; print(len(e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(done.stdout) == len(QUERIES)
    assert "left out" in done.stderr or not os.path.isdir(os.path.join(root, "junctura", "llm"))


def test_set_cover_by_rounds_is_the_same(spark):
    from junctura.operators import cover

    close = plans.close(spark, SF)
    rows = lambda df: sorted((r.g, r.m, r.n) for r in df.collect())
    by_rounds = cover.greedy_cover(close, 5, task_reads=0, batch_reads=500)
    assert rows(by_rounds.groupBy("g", "m").agg(F.count("*").alias("n"))) == rows(QUERIES["set_cover"](spark, SF))
