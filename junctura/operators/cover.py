"""Greedy set cover over clusters that share genes.

Repeatedly the largest cluster (then smallest g, m) with more than ``min_reads`` wins; reads of other clusters that
share one of its genes and have one of its positions, at either end, are removed. Winners keep their reads.

Clusters that share no gene through others do not affect each other, so each connected component is
solved by itself: components of up to TASK_READS reads by the sequential loop, one group each, over five numbers a read. Larger ones are taken apart by
rounds, each of three exact steps:

* every cluster that precedes all its neighbours wins at once;
* what is left falls into components of clusters that share a (gene, position), which is what it takes to lose a read; those that now fit a task are solved there;
* of each component that still does not, the foremost clusters, as many as fit a task, are solved by the loop while what it takes next precedes
  every cluster outside. So a long chain of clusters, each waiting for the one before, costs a round for as many reads as a task holds, not one for each cluster.

Repeated reads count each; reads with a null gene are in no cluster and go; null positions match no position. No reads
give no rows. Columns beside g, m, coord and mcoord are kept as they are, whatever their names (but ``_id`` and ``_component``).
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.operators.order import running
from junctura.tables import components, cut, drop

#: Reads of a component that one task takes: the loop holds about 250 bytes for each.
TASK_READS = 1_000_000


def gene_components(clusters: DataFrame) -> DataFrame:
    """(gene_id, component) over clusters (g, m) as edges."""
    return components(clusters.select(F.col("g").alias("a"), F.col("m").alias("b"))).select(F.col("id").alias("gene_id"), F.col("root").alias("component"))


def greedy(rows: pd.DataFrame, min_reads: int, stop: tuple[int, int, int] | None = None) -> np.ndarray:
    """Row numbers of the winners' reads among ``rows`` (g, m, coord, mcoord), by the sequential loop.

    ``stop``: (-reads, g, m) of a cluster that is not among them; the loop ends where that one would come next.
    """
    ends = rows[["coord", "mcoord"]].to_numpy(np.float64, na_value=np.nan)
    pairs, cluster = np.unique(rows[["g", "m"]].to_numpy(np.int64), axis=0, return_inverse=True)
    cluster = cluster.reshape(-1)
    n = len(rows)
    # codes of (gene, place): four for each read; a null place has none (-1)
    genes = np.unique(pairs, return_inverse=True)[1].reshape(pairs.shape)[cluster]
    places, place = np.unique(ends, return_inverse=True)
    place = np.where(np.isnan(ends), -1, place.reshape(n, 2))
    code = np.stack([np.where(place[:, e] < 0, -1, genes[:, k] * (len(places) + 1) + place[:, e]) for k in (0, 1) for e in (0, 1)], axis=1)
    code = np.unique(code, return_inverse=True)[1].reshape(n, 4) if n else code
    flat = code.reshape(-1)
    null = np.unique(flat[np.tile(place, 2).reshape(-1) < 0])
    order = np.argsort(flat, kind="stable")
    first = np.searchsorted(flat[order], np.arange(int(flat.max(initial=-1)) + 2))
    reader = order // 4
    by_cluster = np.argsort(cluster, kind="stable")
    begin = np.searchsorted(cluster[by_cluster], np.arange(len(pairs) + 1))
    count = np.bincount(cluster, minlength=len(pairs))
    alive = np.ones(n, bool)
    heap = [(-int(c), *p, k) for k, (c, p) in enumerate(zip(count, pairs.tolist(), strict=True))]
    heapq.heapify(heap)
    kept = []
    while heap:
        size, *pair, k = heapq.heappop(heap)
        if count[k] != -size:
            continue  # stale: a newer entry with fewer reads exists
        if -size <= min_reads or (stop and (size, *pair) > stop):
            break
        own = by_cluster[begin[k] : begin[k + 1]]
        own = own[alive[own]]
        kept.append(own)
        alive[own] = False
        count[k] = 0
        taken = np.setdiff1d(code[own], null)
        hit = [reader[first[c] : first[c + 1]] for c in taken.tolist()]
        hit = np.unique(np.concatenate(hit)) if hit else own[:0]
        hit = hit[alive[hit]]
        alive[hit] = False
        lost, by = np.unique(cluster[hit], return_counts=True)
        count[lost] -= by
        for j in lost.tolist():
            heapq.heappush(heap, (-int(count[j]), *pairs[j].tolist(), j))
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


def cover_round(reads: DataFrame, min_reads: int) -> tuple[DataFrame, DataFrame]:
    """(winners (g, m, n), reads left to the others) of one round. ``reads`` is read several times: a table, not a long plan."""
    counts = reads.groupBy("g", "m").agg(F.count("*").alias("n")).filter(F.col("n") > min_reads)
    ends = counts.withColumn("gene_id", F.explode(F.array_distinct(F.array("g", "m"))))
    best = ends.groupBy("gene_id").agg(F.max(F.struct("n", (-F.col("g")).alias("x"), (-F.col("m")).alias("y"))).alias("b"))
    best = best.select("gene_id", (-F.col("b.x")).alias("bg"), (-F.col("b.y")).alias("bm"))
    wins = ends.join(best, "gene_id").groupBy("g", "m", "n").agg(F.min((F.col("bg") == F.col("g")) & (F.col("bm") == F.col("m"))).alias("win"))
    winners = wins.filter("win").select("g", "m", "n")
    return winners, without(reads, winners)


def without(reads: DataFrame, winners: DataFrame) -> DataFrame:
    """``reads`` of clusters that are not among ``winners`` (g, m), less those that the winners remove."""
    taken = reads.join(winners.select("g", "m"), ["g", "m"], "left_semi")
    places = taken.select(F.explode(F.array("g", "m")).alias("gene_id"), "coord", "mcoord").select("gene_id", F.explode(F.array("coord", "mcoord")).alias("place")).distinct()
    left = reads.join(winners.select("g", "m"), ["g", "m"], "left_anti")
    for gene in ("g", "m"):
        for end in ("coord", "mcoord"):
            left = left.join(places.select(F.col("gene_id").alias(gene), F.col("place").alias(end)), [gene, end], "left_anti")
    return left.select(reads.columns)


def overlap_components(reads: DataFrame) -> DataFrame:
    """(g, m, _component): clusters joined where they share a gene and a position at either end. Equal hashes only make components larger, which changes no result."""
    cluster = F.xxhash64(F.lit(0), "g", "m")
    ends = reads.select("g", "m", F.explode(F.array("g", "m")).alias("gene"), F.array("coord", "mcoord").alias("places")).select("g", "m", "gene", F.explode("places").alias("place"))
    links = ends.filter("place is not null").select(cluster.alias("a"), F.xxhash64(F.lit(1), "gene", "place").alias("b")).distinct()
    roots = components(links).select(F.col("id").alias("_a"), F.col("root").alias("_component"))
    named = reads.select("g", "m").distinct().withColumn("_a", cluster)
    return named.join(roots, "_a", "left").select("g", "m", F.coalesce("_component", "_a").alias("_component"))


def solved(reads: DataFrame, min_reads: int) -> DataFrame:
    """_id of the winners' reads, each ``_component`` in one group. Reads may have ``_stop``: see ``greedy``."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        stop = None
        if "_stop" in rows.columns and rows["_stop"].iloc[0] is not None:
            stop = tuple(int(x) for x in rows["_stop"].iloc[0])
        return pd.DataFrame({"_id": rows["_id"].to_numpy()[greedy(rows, min_reads, stop)]})

    return reads.groupBy("_component").applyInPandas(solve, "_id long")


def foremost(reads: DataFrame, batch_reads: int) -> DataFrame:
    """Reads of each component's first clusters, ``batch_reads`` of them (one cluster at least), with ``_stop``, the first cluster after them."""
    counts = reads.groupBy("_component", "g", "m").agg(F.count("*").alias("n"))
    placed = running(counts, [F.desc("n"), "g", "m"], "_rank", {"n": "_before"}, ["_component"])
    within = (F.col("_rank") == 1) | (F.col("_before") + F.col("n") <= batch_reads)
    placed = cut(placed.select("_component", "g", "m", "n", within.alias("_in")), "foremost")
    after = placed.filter("not _in").groupBy("_component").agg(F.min(F.struct((-F.col("n")).alias("n"), "g", "m")).alias("s"))
    stops = after.select("_component", F.array("s.n", "s.g", "s.m").alias("_stop"))
    return reads.join(placed.filter("_in").select("_component", "g", "m"), ["_component", "g", "m"], "left_semi").join(stops, "_component", "left")


def live_reads(reads: DataFrame, min_reads: int) -> DataFrame:
    """Reads of clusters that can still win, as a table."""
    return cut(reads.join(reads.groupBy("g", "m").count().filter(F.col("count") > min_reads).select("g", "m"), ["g", "m"], "left_semi").select(reads.columns), "cover")


def split(reads: DataFrame, task_reads: int) -> tuple[DataFrame, DataFrame]:
    """``reads`` with ``_component``: those of components that fit a task, and the others."""
    sizes = reads.groupBy("_component").count()
    small = reads.join(sizes.filter(F.col("count") <= task_reads).select("_component"), "_component", "left_semi")
    large = reads.join(sizes.filter(F.col("count") > task_reads).select("_component"), "_component", "left_semi")
    return small, large


def cover_by_rounds(reads: DataFrame, min_reads: int, task_reads: int = TASK_READS, batch_reads: int = TASK_READS) -> DataFrame:
    """_id of the winners' reads among ``reads`` (_id, g, m, coord, mcoord), by rounds of the three steps."""
    won = [reads.select("_id").filter("false")]
    live = live_reads(reads, min_reads)
    while not live.isEmpty():
        winners, left = cover_round(live, min_reads)
        winners = cut(winners, "winners")
        won.append(cut(live.join(winners.select("g", "m"), ["g", "m"], "left_semi").select("_id"), "won"))
        before, live = live, live_reads(left, min_reads)
        drop(before)
        if live.isEmpty():
            break
        parts = cut(live.join(overlap_components(live), ["g", "m"]).select(*reads.columns, "_component"), "parts")
        small, large = split(parts, task_reads)
        won.append(cut(solved(small, min_reads), "won"))
        if large.isEmpty():
            break
        ids = cut(solved(foremost(large, batch_reads), min_reads), "won")
        won.append(ids)
        taken = large.join(ids, "_id", "left_semi").select("g", "m").distinct()
        before, live = live, live_reads(without(large.select(reads.columns), cut(taken, "winners")), min_reads)
        drop(before)
    return reduce(DataFrame.unionByName, won)


def greedy_cover(reads: DataFrame, min_reads: int = 5, task_reads: int = TASK_READS, batch_reads: int = TASK_READS) -> DataFrame:
    """Reads of the winning clusters; ``reads`` has g, m, coord, mcoord and any other columns, which stay out of the loop. It is read twice: a table, not a long plan."""
    parts = cut(gene_components(reads.select(F.col("g").cast("long").alias("g"), F.col("m").cast("long").alias("m")).distinct()), "genes")
    labels = parts.select(F.col("gene_id").alias("_gene"), F.col("component").alias("_component"))
    table = cut(reads.filter("m is not null").join(labels, F.col("g") == F.col("_gene")).drop("_gene").withColumn("_id", F.monotonically_increasing_id()), "cover")
    slim = table.select("_id", *[F.col(c).cast("long").alias(c) for c in ("g", "m", "coord", "mcoord")], "_component")
    small, large = split(slim, task_reads)
    won = solved(small, min_reads)
    if not large.isEmpty():
        won = won.union(cover_by_rounds(large.drop("_component"), min_reads, task_reads, batch_reads))
    return table.join(won, "_id", "left_semi").select(reads.columns)
