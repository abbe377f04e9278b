"""What queries leave on disk, and that working in parts, tiles and with fewer columns changes no result."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from junctura import tables
from junctura.operators import clusters, proximity
from junctura.plans import detect
from junctura.plans import queries as q
from junctura.plans.counters import Counters
from junctura.sources import fixture as fx

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = tables.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(tables.SHUFFLES_GO) == "false" and table.count() == 7


def test_parts_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART_BYTES", 200)
    table = tables.cut(spark.range(500).selectExpr("id % 41 as k", "id"), "t")
    seen = Counters(0)
    steps = []
    done = tables.cut_in_parts(table, ["k"], lambda part: steps.append(part) or seen.rows(part.groupBy("k").count(), "groups"), "u")
    assert len(steps) == tables.PARTS
    assert rows(done) == rows(table.groupBy("k").count()) and seen.values() == {"groups": 41}


def test_columns_that_nobody_wants_stay_behind(spark, monkeypatch):
    written = {}
    each = tables.cut_each
    monkeypatch.setattr(tables, "cut_each", lambda frames, name: written.setdefault(name, each(frames, name)))
    q.breakpoints(spark, SF)
    assert written["distinct"].columns == ["g", "m", "coord", "mcoord"] == written["close"].columns


def test_fewer_columns_same_duplicates(spark):
    rng = random.Random(5)
    cells = [(*sorted(rng.sample(range(3), 2)), rng.randrange(4), rng.randrange(3), rng.randrange(2), rng.randrange(9)) for _ in range(300)]
    reads = spark.createDataFrame(cells, "g long, m long, coord long, mcoord long, a int, b int")
    every = clusters.dedup_reads(reads, ["a", "b"])
    assert rows(clusters.dedup_reads(reads.drop("a", "b"), [])) == rows(every.drop("a", "b"))
    assert rows(clusters.dedup_reads(reads.drop("b"), ["a"])) == rows(every.drop("b"))


@pytest.mark.parametrize(("tile", "run"), [(2, 1), (3, 20), (16, 50)])
def test_tiles_and_runs_change_nothing(spark, tile, run):
    rng = random.Random(tile)
    cells = [(rng.randrange(4), rng.randrange(-100, 200), rng.randrange(-100, 200), i) for i in range(400)]
    cells += [(9, 5, 5, 1000), (9, 5, 5, 1001), (9, 900, 5, 1002), (9, 908, 5, 1003)]
    near = lambda r, s: r[3] != s[3] and r[0] == s[0] and abs(r[1] - s[1]) + abs(r[2] - s[2]) <= 8
    want = sorted(r for r in cells if any(near(r, s) for s in cells))
    assert 4 < len(want) < len(cells)
    reads = spark.createDataFrame(cells, "k int, x long, y long, i int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        assert rows(proximity.l1_neighbours(reads, ["k"], "x", "y", 8, tile, run)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_proximity_shuffles_once(spark):
    reads = spark.createDataFrame([(1, 2, 3), (1, 3, 3)], "k int, x long, y long")
    plan = proximity.l1_neighbours(reads, ["k"], "x", "y", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_sam_files_a_few_at_a_time(spark, monkeypatch):
    whole = rows(q.sam_positions(spark, SF))
    made = []
    files = fx.sam_files
    monkeypatch.setattr(fx, "sam_files", lambda *a: made.append(files(*a)) or made[-1])
    monkeypatch.setattr(tables, "PART_BYTES", 1)
    assert rows(q.sam_positions(spark, SF)) == whole
    assert len(made) == tables.PARTS and not any(os.path.exists(p.removeprefix("file:")) for p in made)


def test_the_job_in_parts(spark, monkeypatch):
    args = (q.mapped(spark, SF), fx.genes(spark, SF), fx.families(spark, SF), fx.ORDER)
    whole = rows(detect.supported(*args).select(*q.RID, "g", "m", "gene", "mgene", "is_mate", "chr", "mchr"))
    monkeypatch.setattr(tables, "PART_BYTES", 30_000)
    assert rows(detect.supported(*args).select(*q.RID, "g", "m", "gene", "mgene", "is_mate", "chr", "mchr")) == whole
