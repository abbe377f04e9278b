"""Reference tables from a UCSC transcript table: gene intervals, exons, families.

Rows with a null name, chromosome or end are in no table; repeated transcripts are one gene; no rows give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from junctura.functions.columns import family_motif, number_list
from junctura.operators.order import running
from junctura.tables import cut

SCHEMA = (
    "bin int, name string, chrom string, strand string, txStart long, txEnd long, cdsStart long, cdsEnd long, exonCount int, "
    "exonStarts string, exonEnds string, score int, name2 string, cdsStartStat string, cdsEndStat string, exonFrames string"
)


def read_refgene(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SCHEMA)


def parse_refgene(lines: DataFrame) -> DataFrame:
    """The columns of SCHEMA from tab-separated lines (value); lines with fewer columns have nulls for the rest."""
    cells = F.split("value", "\t")
    return lines.select(*[F.get(cells, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(StructType.fromDDL(SCHEMA))])


def read_chromosome_map(spark: SparkSession, path: str) -> DataFrame:
    """(ref_name, sam_name) of lines ``ref_name=sam_name``."""
    part = F.split("value", "=", 2)
    return spark.read.text(path).filter(F.col("value").contains("=")).select(F.trim(part[0]).alias("ref_name"), F.trim(part[1]).alias("sam_name"))


def rename(refgene: DataFrame, names: DataFrame) -> DataFrame:
    """Transcripts on listed chromosomes under their other name (chrom), mRNA accessions only, with gene_id, their number."""
    kept = refgene.filter(F.col("name").startswith("NM_")).join(names, F.col("chrom") == F.col("ref_name"))
    number = F.regexp_extract("name", r"^NM_(\d+)", 1)
    return kept.withColumn("gene_id", number.cast("long")).withColumn("chrom", F.col("sam_name")).drop("ref_name", "sam_name")


def gene_intervals(renamed: DataFrame, chrs: DataFrame) -> DataFrame:
    """(chr, tx_start, tx_end, gene_id); rows that end before they start stay out."""
    dim = chrs.select("chr", F.col("chr_name").alias("chrom"))
    return renamed.filter("txStart <= txEnd").join(dim, "chrom").select("chr", F.col("txStart").alias("tx_start"), F.col("txEnd").alias("tx_end"), "gene_id")


def exon_table(renamed: DataFrame) -> DataFrame:
    """(gene_id, gene_name, exon_count, starts, ends, frames), one row a gene id (the first by position)."""
    row = F.struct("chrom", "txStart", "txEnd", F.col("name2").alias("gene_name"), F.col("exonCount").alias("exon_count"), number_list(F.col("exonStarts")).alias("starts"), number_list(F.col("exonEnds")).alias("ends"), number_list(F.col("exonFrames"), "int").alias("frames"))
    return renamed.groupBy("gene_id").agg(F.min(row).alias("r")).select("gene_id", "r.gene_name", "r.exon_count", "r.starts", "r.ends", "r.frames")


def families(renamed: DataFrame, literal: bool = False) -> DataFrame:
    """(gene_id, family_id): symbols are ranked by motif, descending; a gene of several symbols has the smallest of their families.

    ``literal``: as by a pass over lines ``symbol<TAB>gene_id`` in descending order, in which a line stays in the family of the line before while
    it begins with that family's motif (a line's first two characters and the capitals that follow), and else begins a family with its own.

    That needs no pass. Lines that begin with one motif stand together in this order, so a family is all lines from the first one with its
    motif to the last one that begins with it; hence all lines of one motif are in one family, that of the motif, among it and the shorter ones it begins
    with, whose first line comes first. So motifs meet their beginnings in a join, and families are ranked by their first lines.
    """
    rows = renamed.select("gene_id", F.col("name2").alias("symbol")).filter("symbol is not null").distinct()
    if not literal:
        rows = rows.select("gene_id", family_motif(F.col("symbol")).alias("motif")).distinct()
        ranked = running(rows.select("motif").distinct(), [F.desc("motif")], "rank").select("motif", (F.col("rank") - 1).alias("family_id"))
        return rows.join(ranked, "motif").groupBy("gene_id").agg(F.min("family_id").alias("family_id"))
    line = F.concat("symbol", F.lit("\t"), F.coalesce(F.col("gene_id").cast("string"), F.lit("")))
    lines = rows.select("gene_id", line.alias("line")).withColumn("motif", F.regexp_extract("line", "^((?s:..)[A-Z]*)", 1))
    motifs = cut(lines.groupBy("motif").agg(F.max("line").alias("top")), "motifs")
    begins = motifs.select("motif", F.explode(F.transform(F.sequence(F.lit(2), F.length("motif")), lambda n: F.substring("motif", F.lit(1), n))).alias("begin"))
    held = begins.join(motifs.select(F.col("motif").alias("begin"), "top"), "begin").groupBy("motif").agg(F.max(F.struct("top", "begin")).alias("f")).select("motif", "f.top")
    ranked = running(held.select("top").distinct(), [F.desc("top")], "rank").select("top", (F.col("rank") - 1).alias("family_id"))
    return lines.select("gene_id", "motif").distinct().join(held, "motif").join(ranked, "top").groupBy("gene_id").agg(F.min("family_id").alias("family_id"))


def build_reference(refgene: DataFrame, names: DataFrame, chrs: DataFrame, literal: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, exons, families)"""
    renamed = rename(refgene, names)
    return gene_intervals(renamed, chrs), exon_table(renamed), families(renamed, literal)
