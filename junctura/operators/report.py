"""Orientation, exon frames, breakpoints and the cluster report.

Null positions take no part in breakpoints, null frames (-2) in no match. Equal reads count each. No reads give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.config import FusionConfig
from junctura.functions.columns import gene_label, in_frame, percent
from junctura.operators.annotate import exon_frame
from junctura.operators.order import running

CL_COLUMNS = ["chr_a", "chr_b", "gene_a", "gene_b", "nbreads", "offset_start", "offset_length", "fb_start", "fb_end", "exon_match_percent"]


def orient(reads: DataFrame) -> DataFrame:
    """(coord, chr, gene) become the end with the larger coordinate, (mcoord, mchr, mgene) the other; equal ends swap too."""
    up = F.col("coord") > F.col("mcoord")
    swap = {c: F.when(up, F.col(c)).otherwise(F.col(f"m{c}")) for c in ("coord", "chr", "gene")} | {f"m{c}": F.when(up, F.col(f"m{c}")).otherwise(F.col(c)) for c in ("coord", "chr", "gene")}
    return reads.withColumns(swap)


def exon_arrays(exons: DataFrame) -> DataFrame:
    """(gene_id, gene_name, exons) of exon tables with arrays starts, ends, frames."""
    row = F.transform(F.arrays_zip("starts", "ends", "frames"), lambda e: F.struct(e["starts"].alias("start"), e["ends"].alias("end"), e["frames"].alias("frame")))
    return exons.select("gene_id", "gene_name", row.alias("exons"))


def first_genes(oriented: DataFrame, order: list[str]) -> DataFrame:
    """(g, m, gene, mgene): the genes of each cluster's first read by (coord, mcoord), then ``order``; an aggregation with partial results."""
    by = list(dict.fromkeys(["coord", "mcoord", *order]))
    first = F.min(F.struct(*[F.col(c).alias(f"by_{c}") for c in by], "gene", "mgene")).alias("f")
    return oriented.groupBy("g", "m").agg(first).select("g", "m", "f.gene", "f.mgene")


def with_frames(oriented: DataFrame, exons: DataFrame, cfg: FusionConfig = FusionConfig(), order: list[str] | None = None) -> DataFrame:
    """Adds frame, mframe and both gene names; genes without exons give -2 and a null name.

    compat "literal": the exon lists (and names) of a cluster are those of its first read's genes, for all its reads, and a list's first frame is
    given for every hit. A first read whose gene has no exons gives -2 and a null name to the whole cluster.
    """
    table = exon_arrays(exons)
    literal = cfg.compat == "literal"
    a = table.select(F.col("gene_id").alias("_gene"), F.col("gene_name"), F.col("exons").alias("_a"))
    b = table.select(F.col("gene_id").alias("_mgene"), F.col("gene_name").alias("mgene_name"), F.col("exons").alias("_b"))
    frame = lambda exons, at: F.coalesce(exon_frame(F.col(exons), F.col(at), cfg.slack, literal), F.lit(-2))
    if literal:
        lists = first_genes(oriented, order or []).withColumnsRenamed({"gene": "_gene", "mgene": "_mgene"})
        listed = lists.join(a, "_gene", "left").join(b, "_mgene", "left").drop("_gene", "_mgene")  # one row a cluster
        return oriented.join(listed, ["g", "m"]).withColumns({"frame": frame("_a", "coord"), "mframe": frame("_b", "mcoord")}).drop("_a", "_b")
    # a read takes its frame to the second join, not the list
    one = oriented.join(a, F.col("gene") == F.col("_gene"), "left").withColumn("frame", frame("_a", "coord")).drop("_gene", "_a")
    return one.join(b, F.col("mgene") == F.col("_mgene"), "left").withColumn("mframe", frame("_b", "mcoord")).drop("_mgene", "_b")


def breakpoints(reads: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """(g, m, fb_start, fb_end): largest lower and smallest upper end of a cluster's reads."""
    if cfg.compat == "literal":
        lower, upper = F.when(F.col("is_mate"), F.col("mcoord")).otherwise(F.greatest("coord", "mcoord")), F.when(F.col("is_mate"), F.col("coord")).otherwise(F.least("coord", "mcoord"))
    else:
        lower, upper = F.least("coord", "mcoord"), F.greatest("coord", "mcoord")
    return reads.groupBy("g", "m").agg(F.max(lower).alias("fb_start"), F.min(upper).alias("fb_end"))


def match_percent(framed: DataFrame) -> DataFrame:
    """(g, m, exon_match_percent)"""
    hits = F.count_if(in_frame(F.col("frame"), F.col("mframe")))
    return framed.groupBy("g", "m").agg(percent(hits, F.count("*")).alias("exon_match_percent"))


def summarize(framed: DataFrame, header_bytes: int, order: list[str], cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """One row a cluster: its first read's ends and names, size, byte range in the reads file, breakpoints and percentage.

    ``framed`` are oriented reads with frames, gene names and line_len; the first read is the least by ``order``.
    Clusters are ordered by (mgene, gene) of their first read, then (g, m). Byte offsets are a running sum over
    clusters, one row each, not over reads.
    """
    first = F.min(F.struct(*[F.col(c).alias(f"by_{c}") for c in order], "chr", "mchr", "gene", "mgene", "gene_name", "mgene_name")).alias("f")
    lower, upper = F.least("coord", "mcoord"), F.greatest("coord", "mcoord")
    if cfg.compat == "literal":
        lower, upper = F.when(F.col("is_mate"), F.col("mcoord")).otherwise(F.col("coord")), F.when(F.col("is_mate"), F.col("coord")).otherwise(F.col("mcoord"))
    hits = F.count_if(in_frame(F.col("frame"), F.col("mframe")))
    rows = framed.groupBy("g", "m").agg(first, F.count("*").alias("nbreads"), F.sum("line_len").cast("long").alias("offset_length"), F.max(lower).alias("fb_start"), F.min(upper).alias("fb_end"), percent(hits, F.count("*")).alias("exon_match_percent"))
    placed = running(rows.withColumns({"_m": F.col("f.mgene"), "_g": F.col("f.gene")}), ["_m", "_g", "g", "m"], "cluster_rank", {"offset_length": "offset_start"})
    return placed.withColumn("offset_start", F.col("offset_start") + header_bytes).drop("_m", "_g")


def cluster_list(summary: DataFrame, chrs: DataFrame) -> DataFrame:
    """The ten report columns with chromosome names, and cluster_rank."""
    names = chrs
    a, b = names.select(F.col("chr").alias("_ca"), F.col("chr_name").alias("chr_a")), names.select(F.col("chr").alias("_cb"), F.col("chr_name").alias("chr_b"))
    joined = summary.join(a, F.col("f.chr") == F.col("_ca"), "left").join(b, F.col("f.mchr") == F.col("_cb"), "left")
    labels = {"gene_a": gene_label(F.coalesce("f.gene_name", F.lit("")), F.col("f.gene")), "gene_b": gene_label(F.coalesce("f.mgene_name", F.lit("")), F.col("f.mgene"))}
    return joined.withColumns(labels).select("cluster_rank", *CL_COLUMNS)


def report_lines(listed: DataFrame) -> DataFrame:
    """(cluster_rank, line): one readable line a cluster, ``gene - mgene : n reads // chr - chr``."""
    return listed.select("cluster_rank", F.format_string("%s - %s : %d reads // %s - %s", "gene_a", "gene_b", "nbreads", "chr_a", "chr_b").alias("line"))


def to_lines(listed: DataFrame) -> DataFrame:
    """Tab-separated report lines in cluster order."""
    return listed.orderBy("cluster_rank").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in CL_COLUMNS]).alias("value"))
