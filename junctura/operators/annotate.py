"""First-match interval joins: reads to genes, positions to exons.

Genes with a null id, chromosome or end, and those that end before they start, match nothing; reads with a null chromosome or position
have no gene. Repeated reads stay; repeated gene rows change nothing. Columns of reads are kept, whatever their
names (but those that begin with ``_``, and the one that is added).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of 2 ** BIN bases: a few genes each where genes are dense, some hundred thousand bins for a genome.
BIN = 11


def gene_bins(genes: DataFrame, slack: int = 50) -> DataFrame:
    """(chr, bin, hits): distinct genes of each bin by (tx_start, id as text); a gene is in every bin that it and its slack touch."""
    valid = genes.filter("tx_start <= tx_end and gene_id is not null and chr is not null").select("chr", "tx_start", "tx_end", "gene_id").distinct()
    span = F.sequence(F.shiftright(F.col("tx_start") - slack, BIN), F.shiftright("tx_end", BIN))
    row = F.struct((F.col("tx_start") - slack).alias("lo"), F.col("gene_id").cast("string").alias("tie"), F.col("tx_end").alias("hi"), "gene_id")
    binned = valid.select("chr", F.explode(span).alias("bin"), row.alias("g")).groupBy("chr", "bin").agg(F.sort_array(F.collect_list("g")).alias("hits"))
    return binned.select("chr", "bin", F.transform("hits", lambda g: F.struct(g["lo"], g["hi"], g["gene_id"])).alias("hits"))


def match_genes(reads: DataFrame, genes: DataFrame, chr_col: str = "chr", coord_col: str = "coord", slack: int = 50, how: str = "inner") -> DataFrame:
    """``reads`` with ``hits``: all genes at (chr_col, coord_col), first match first. A point lies in one bin, so no row is repeated."""
    bins = gene_bins(genes, slack).withColumnsRenamed({"chr": "_chr", "bin": "_bin", "hits": "_hits"})
    joined = reads.join(bins, (F.col(chr_col) == F.col("_chr")) & (F.shiftright(coord_col, BIN) == F.col("_bin")), how)
    at = F.col(coord_col)
    hits = F.transform(F.filter("_hits", lambda g: (g["lo"] <= at) & (at <= g["hi"])), lambda g: g["gene_id"])
    return joined.withColumn("hits", hits).drop("_chr", "_bin", "_hits")


def first_intervals(genes: DataFrame, slack: int = 50) -> DataFrame:
    """(chr, bin, lo, hi, gene_id): bins cut at the borders of their genes into disjoint intervals, each with the one gene that comes first there."""
    high = F.shiftleft("bin", BIN) + (1 << BIN) - 1
    begins = F.transform("hits", lambda g: F.greatest(g["lo"], F.shiftleft("bin", BIN)))
    ends = F.filter(F.transform("hits", lambda g: g["hi"] + 1), lambda x: x <= high)
    pieces = gene_bins(genes, slack).withColumn("cuts", F.array_distinct(F.concat(begins, ends))).select("chr", "bin", "hits", "cuts", F.explode("cuts").alias("lo"))
    lo = F.col("lo")
    hi = F.coalesce(F.array_min(F.filter("cuts", lambda c: c > lo)) - 1, high)
    first = F.get(F.filter("hits", lambda g: (g["lo"] <= lo) & (lo <= g["hi"])), F.lit(0))["gene_id"]
    return pieces.select("chr", "bin", "lo", hi.alias("hi"), first.alias("gene_id")).filter("gene_id is not null")


def first_in_bins(reads: DataFrame, intervals: DataFrame, chr_col: str = "chr", coord_col: str = "coord", out: str = "gene", more: dict[str, str] | None = None) -> DataFrame:
    """``reads`` with the first gene at a position; reads without one are dropped. ``intervals`` are ``first_intervals``, best as a written table.

    An equi-join on (chr, bin) with a range condition that at most one interval meets, all of it generated code. Spark broadcasts the intervals where
    their size in bytes is below its threshold and shuffles on (chr, bin) where not. ``more``: other columns of the intervals, and their names in the result.
    """
    named = [F.col(c).alias(n) for c, n in (more or {}).items()]
    held = intervals.select(F.col("chr").alias("_chr"), F.col("bin").alias("_bin"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("gene_id").alias(out), *named)
    at = F.col(coord_col)
    return reads.join(held, (F.col(chr_col) == F.col("_chr")) & (F.shiftright(coord_col, BIN) == F.col("_bin")) & at.between(F.col("_lo"), F.col("_hi"))).drop("_chr", "_bin", "_lo", "_hi")


def first_gene(reads: DataFrame, genes: DataFrame, chr_col: str = "chr", coord_col: str = "coord", out: str = "gene", slack: int = 50) -> DataFrame:
    """``first_in_bins`` over the intervals of ``genes``."""
    return first_in_bins(reads, first_intervals(genes, slack), chr_col, coord_col, out)


def exon_frame(exons: Column, at: Column, slack: int = 50, literal: bool = False) -> Column:
    """Frame of the first exon (array<struct<start, end, frame>> in list order) that ends after ``at``, -2 if none or if it begins more than ``slack`` later."""
    hit = F.get(F.filter(exons, lambda e: e["end"] > at), F.lit(0))
    frame = F.get(exons, F.lit(0))["frame"] if literal else hit["frame"]
    return F.when(hit.isNull() | (hit["start"] > at + slack), F.lit(-2)).otherwise(frame)
