"""Candidate clusters: canonical gene pairs, discordance, families, duplicates, support.

Reads with a null gene are in no pair and go; null positions are a position like others for duplicates. No rows give no
rows. Other columns are kept, whatever their names (but those that begin with ``_``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.columns import is_mate

PAIR = ["g", "m"]


def canonical_pairs(reads: DataFrame) -> DataFrame:
    """Adds g (smaller gene), m (larger), swapped and is_mate."""
    return reads.withColumns({"g": F.least("gene", "mgene"), "m": F.greatest("gene", "mgene"), "swapped": F.col("gene") > F.col("mgene"), "is_mate": is_mate(F.col("coord"), F.col("mcoord"))})


def discordant(reads: DataFrame) -> DataFrame:
    return canonical_pairs(reads).filter("gene <> mgene")


def one_family(families: DataFrame) -> DataFrame:
    """(gene_id, family_id): the smallest family of each gene."""
    return families.groupBy("gene_id").agg(F.min("family_id").alias("family_id"))


def with_families(clusters: DataFrame, families: DataFrame) -> DataFrame:
    """``clusters`` (with g, m) and the families of both genes; genes without one have null, repeated ones the smallest."""
    one = one_family(families)
    a = one.select(F.col("gene_id").alias("g"), F.col("family_id").alias("g_family"))
    b = one.select(F.col("gene_id").alias("m"), F.col("family_id").alias("m_family"))
    return clusters.join(a, "g", "left").join(b, "m", "left")


def cross_family(clusters: DataFrame, families: DataFrame) -> DataFrame:
    """Pairs of different families, or of genes without one."""
    return with_families(clusters, families).filter("g_family is null or m_family is null or g_family <> m_family").drop("g_family", "m_family")


def dedup_reads(reads: DataFrame, order: list[str]) -> DataFrame:
    """One read for each (g, m, coord, mcoord), the first by ``order``, then by its other columns; reads without a mate position (0) all stay.

    An aggregation with partial results. Reads without a mate position are keyed by all their columns, so that they do not
    meet in one group; rows that are equal in all columns are counted and repeated.
    """
    keys = [*PAIR, "coord", "mcoord"]
    rest = [c for c in dict.fromkeys([*order, *reads.columns]) if c not in keys]
    counted = F.count("*").cast("int").alias("_n")
    if rest:
        own = F.when(F.col("mcoord") == 0, F.struct(*rest))
        kept = reads.withColumn("_own", own).groupBy(*keys, "_own").agg(F.min(F.struct(*rest)).alias("_r"), counted)
    else:
        kept = reads.groupBy(*keys).agg(counted)
    copies = F.when(F.col("mcoord") == 0, F.sequence(F.lit(1), F.col("_n"))).otherwise(F.array(F.lit(1)))
    return kept.withColumn("_k", F.explode(copies)).select(*[c if c in keys else F.col("_r")[c].alias(c) for c in reads.columns])


def cluster_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy(*PAIR).agg(F.count("*").alias("n"))


def min_support(reads: DataFrame, min_reads: int = 5) -> DataFrame:
    """Reads of clusters with more than ``min_reads``. Counts are aggregated first; only survivors' reads are joined. ``reads`` is read twice."""
    return reads.join(cluster_counts(reads).filter(F.col("n") > min_reads).select(*PAIR), PAIR, "left_semi")


def stats_by_source(reads: DataFrame, source: str) -> DataFrame:
    """(g, m, nbread, maxnbread, maxsource): reads of each cluster, most from one source, and the first such source."""
    parts = reads.groupBy(*PAIR, source).agg(F.count("*").alias("c"))
    return parts.groupBy(*PAIR).agg(F.sum("c").alias("nbread"), F.max("c").alias("maxnbread"), (-F.max(F.struct("c", (-F.col(source)).alias("s")))["s"]).cast("long").alias("maxsource"))
