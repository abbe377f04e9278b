"""The test tables as a transcript table, chromosomes, genes, families, exons, fragments, read records and SAM text.

Five regions are the chromosomes (index 5: unmapped), every part is a transcript, and every line item is one fragment that gives two
mirrored read records: one end in its part's gene, the other in one of four genes of the same block of 40, so that genes and
clusters grow with the tables. Genes, exons and families come from the transcript table through the reference build. Only
integer arithmetic, so SQL engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.sources import refgene
from junctura.tables import new_folder, shuffles_go

UNMAPPED = 5
#: Files that the SAM text is written to, by order number.
FILES = 16
ORDER = ["chr", "mchr", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seg", "mapq"]
READ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seg", "src", "mapq", "chr", "coord", "mchr", "mcoord"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("chr"), F.col("r_name").alias("chr_name"))


def _join(*cells: Column | str) -> Column:
    return F.concat_ws("\t", *[c.cast("string") if isinstance(c, Column) else F.lit(c) for c in cells])


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): parts as lines of a transcript table: accession part + 1, contig ``c`` and part % 5, four exons."""
    p = _table(spark, sf_dir, "part").withColumn("start", F.lit(1000) + (F.col("p_partkey") - F.col("p_partkey") % 5) * 140)
    k = F.sequence(F.lit(0), F.lit(3))
    listed = lambda f: F.concat(F.array_join(F.transform(k, lambda i: f(i).cast("string")), ","), F.lit(","))
    starts = listed(lambda i: F.col("start") + i * 150)
    ends = listed(lambda i: F.col("start") + i * 150 + 100 + F.col("p_size") % 20)
    frames = listed(lambda i: F.when((F.col("p_partkey") + i) % 7 == 0, -1).otherwise((F.col("p_size") + i) % 3))
    end = F.col("start") + 600 + F.col("p_size") * 4
    name = F.concat(F.lit("NM_"), F.lpad((F.col("p_partkey") + 1).cast("string"), 9, "0"), F.lit(".2"))
    symbol = F.concat("p_type", F.lit("_"), F.col("p_partkey").cast("string"))
    contig = F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string"))
    return p.select(_join("0", name, contig, "+", F.col("start"), end, F.col("start"), end, "4", starts, ends, "0", symbol, "cmpl", "cmpl", frames).alias("value"))


def contig_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("ref_name"), F.col("r_name").alias("sam_name"))


def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refgene.rename(refgene.parse_refgene(transcript_lines(spark, sf_dir)), contig_names(spark, sf_dir))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refgene.gene_intervals(_renamed(spark, sf_dir), chromosomes(spark, sf_dir))


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, gene_name, exon_count, starts, ends, frames): four exons a gene."""
    return refgene.exon_table(_renamed(spark, sf_dir))


def families(spark: SparkSession, sf_dir: str, literal: bool = False) -> DataFrame:
    return refgene.families(_renamed(spark, sf_dir), literal)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n, p, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    b = p - p % 40 + (p % 40 + 1 + (s * 7 + n) % 4 * 9) % 40
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity").cast("int") % 10).alias("mapq"),
        F.when(o % 97 == 0, UNMAPPED).otherwise(p % 5).cast("int").alias("chr_a"),
        (F.lit(940) + (p - p % 5) * 140 + (o * 37 + n * 11) % 720).cast("long").alias("pos_a"),
        (b % 5).cast("int").alias("chr_b"),
        (F.lit(940) + (b - b % 5) * 140 + (o * 53 + n * 29) % 720).cast("long").alias("pos_b"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both records of each fragment, from one scan."""
    end = lambda seg, x, y: F.struct(F.lit(seg).alias("seg"), F.col(f"chr_{x}").alias("chr"), F.col(f"pos_{x}").alias("coord"), F.col(f"chr_{y}").alias("mchr"), F.col(f"pos_{y}").alias("mcoord"))
    both = fragments(spark, sf_dir).withColumn("e", F.explode(F.array(end(1, "a", "b"), end(2, "b", "a"))))
    return both.withColumn("src", F.col("l_linenumber")).select(*READ[:4], "e.seg", "src", "mapq", "e.chr", "e.coord", "e.mchr", "e.mcoord")


def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, value) of a SAM header: a version line, then one line a chromosome."""
    sq = chromosomes(spark, sf_dir).select((F.col("chr") + 2).alias("line_no"), F.concat(F.lit("@SQ\tSN:"), F.col("chr_name"), F.lit("\tLN:99999999")).alias("value"))
    return spark.createDataFrame([(1, "@HD\tVN:1.0")], "line_no int, value string").union(sq)


def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read records as SAM lines (value), with what orders them."""
    return _named(spark, sf_dir).select(*READ[:5], "mapq", sam_line().alias("value"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read records with the names of both chromosomes."""
    names = chromosomes(spark, sf_dir)
    a, b = names.select(F.col("chr").alias("chr"), F.col("chr_name").alias("name")), names.select(F.col("chr").alias("mchr"), F.col("chr_name").alias("mname"))
    return reads(spark, sf_dir).join(a, "chr", "left").join(b, "mchr", "left")


def sam_line() -> Column:
    """A record's line; a mate on the same chromosome is ``=``, unmapped ends are ``*``.

    Records of orders divisible by 101 have no number for their position, those of orders divisible by 103 are cut short.
    """
    name = F.concat(F.lit("r"), F.concat_ws(".", *[F.col(c).cast("string") for c in READ[:5]]))
    rnext = F.when(F.col("chr") == F.col("mchr"), "=").otherwise(F.coalesce("mname", F.lit("*")))
    pos = F.when(F.col("l_orderkey") % 101 == 0, "x").otherwise(F.col("coord").cast("string"))
    whole = _join(name, "0", F.coalesce("name", F.lit("*")), pos, F.col("mapq"), "10M", rnext, F.col("mcoord"), "0", "ACGT", "*", "NM:i:0")
    return F.when(F.col("l_orderkey") % 103 == 0, F.substring_index(whole, "\t", 8)).otherwise(whole)


def sam_files(spark: SparkSession, sf_dir: str, first: int = 0, last: int = FILES) -> str:
    """Folder of FILES text files (of those from ``first`` to before ``last``): each has the header, then the lines of its orders in order.

    Numbers are shuffled and sorted, and become text as they are written; ``k`` is written as it was sorted, or Spark sorts again.
    """
    by = [*READ[:5], "mapq"]
    numbers = [*by, "chr", "coord", "mchr", "mcoord", "name", "mname"]
    number = F.col("l_orderkey") % FILES
    name = lambda k: F.lpad(k.cast("string"), 2, "0").alias("k")
    body = _named(spark, sf_dir).filter(number.between(first, last - 1)).select(name(number), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("head"), *numbers)
    every = F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("k")
    heads = header(spark, sf_dir).select("line_no", "value", every).select(name(F.col("k")), "line_no", F.col("value").alias("head"), *[F.lit(None).cast(body.schema[c].dataType).alias(c) for c in numbers])
    dealt = heads.union(body).repartition("k").sortWithinPartitions("k", F.asc_nulls_last("line_no"), *by)
    path = new_folder(spark, "sam")
    with shuffles_go(spark):
        dealt.select("k", F.coalesce("head", sam_line()).alias("value")).write.partitionBy("k").text(path)
    return path
