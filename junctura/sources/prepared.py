"""Prepared reference folders: one text file of genes and one of exons a chromosome, and one of families.

``<chr>.gtf``: start, end, gene id, by start. ``<chr>_exon.gtf``: gene id, name, number of exons, starts, ends, frames (comma lists), by id;
rows of five columns have no name. ``family_gene.txt``: gene id, family id, by gene id. Columns are tab-separated.

The chromosome is the file's name (Spark's file metadata; ``:``, ``/`` and ``%`` stand there as ``%3A``, ``%2F`` and ``%25``). A name may also be a folder of part files. Lines that lack a number, and genes that end before they
start, are passed over; unknown chromosomes and repeated exon rows (the first by start, end and name stays) too; missing files are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.functions.columns import number_list
from junctura.tables import _remove

FAMILIES = "family_gene.txt"
GENES, EXONS = ".gtf", "_exon.gtf"
#: Characters that file names cannot have, in names of chromosomes.
ESCAPED = {"%": "%25", ":": "%3A", "/": "%2F"}


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(chr_name, exon, cells) of all lines of the folder's chromosome files."""
    path = F.col("_metadata.file_path")
    found = spark.read.option("recursiveFileLookup", "true").text(folder).select(F.regexp_extract(path, r"/([^/]+)\.gtf(/[^/]*)?$", 1).alias("at"), F.split("value", "\t").alias("cells"))
    exon = F.col("at").endswith("_exon")
    name = F.url_decode(F.replace(F.when(exon, F.regexp_replace("at", "_exon$", "")).otherwise(F.col("at")), F.lit("+"), F.lit("%2B")))
    for plain, escaped in reversed(ESCAPED.items()):
        name = F.replace(name, F.lit(escaped), F.lit(plain))
    return found.filter("at <> ''").select(name.alias("chr_name"), exon.alias("exon"), "cells")


def _number(i: int, kind: str = "bigint") -> Column:
    return F.get("cells", F.lit(i)).try_cast(kind)


def read_genes(spark: SparkSession, folder: str, chrs: DataFrame) -> DataFrame:
    """(chr, tx_start, tx_end, gene_id)"""
    rows = _lines(spark, folder).filter("not exon").select("chr_name", _number(0).alias("tx_start"), _number(1).alias("tx_end"), _number(2).alias("gene_id"))
    return rows.filter("tx_start <= tx_end and gene_id is not null").join(chrs, "chr_name").select("chr", "tx_start", "tx_end", "gene_id")


def read_exons(spark: SparkSession, folder: str) -> DataFrame:
    """(gene_id, gene_name, exon_count, starts, ends, frames), one row a gene id."""
    rows = _lines(spark, folder).filter("exon")
    named = F.when(F.size("cells") > 5, 1).otherwise(0)
    cell = lambda i: F.get("cells", named + i)
    row = F.struct(number_list(cell(2)).alias("starts"), number_list(cell(3)).alias("ends"), F.when(named == 1, F.get("cells", F.lit(1))).alias("gene_name"), cell(1).try_cast("int").alias("exon_count"), number_list(cell(4), "int").alias("frames"))
    kept = rows.select(_number(0).alias("gene_id"), row.alias("r")).filter("gene_id is not null and r.frames is not null")
    return kept.groupBy("gene_id").agg(F.min("r").alias("r")).select("gene_id", "r.gene_name", "r.exon_count", "r.starts", "r.ends", "r.frames")


def read_families(spark: SparkSession, folder: str) -> DataFrame:
    """(gene_id, family_id)"""
    rows = spark.read.option("pathGlobFilter", FAMILIES).text(folder).select(F.split("value", "\t").alias("cells"))
    return rows.select(_number(0).alias("gene_id"), _number(1).alias("family_id")).filter("gene_id is not null and family_id is not null")


def read_reference(spark: SparkSession, folder: str, chrs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, exons, families)"""
    return read_genes(spark, folder, chrs), read_exons(spark, folder), read_families(spark, folder)


def _write(lines: DataFrame, by: list[str], folder: str, ending: str) -> None:
    """``lines`` (name, value) as one file a name, in order: written as partitions, then each partition's file takes its name."""
    spark = lines.sparkSession
    tmp = f"{folder}/_writing{ending}"
    lines.repartition("name").sortWithinPartitions("name", *by).select("name", "value").write.mode("overwrite").partitionBy("name").text(tmp)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(tmp).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        fs = fs.getRawFileSystem()  # no checksum files beside files that people edit
    for found in fs.listStatus(hadoop.Path(tmp)):
        at = found.getPath()
        if at.getName().startswith("name="):
            name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(at.getName()[5:])
            part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
            for plain, escaped in ESCAPED.items():
                name = name.replace(plain, escaped)
            target = hadoop.Path(f"{folder}/{name}{ending}")
            fs.delete(target, True)
            fs.rename(part, target)
    _remove(spark, tmp)


def _joined(*cells: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])


def _listed(c: str) -> Column:
    return F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))


def write_reference(genes: DataFrame, exons: DataFrame, families: DataFrame, chrs: DataFrame, folder: str) -> None:
    """The three kinds of files. A chromosome is one file, so one task's stream; exons are written to the chromosomes of their genes."""
    placed = genes.join(chrs, "chr").select(F.col("chr_name").alias("name"), "tx_start", "tx_end", "gene_id")
    _write(placed.withColumn("value", _joined(F.col("tx_start"), F.col("tx_end"), F.col("gene_id"))), ["tx_start", "tx_end", "gene_id"], folder, GENES)
    rows = placed.select("name", "gene_id").distinct().join(exons, "gene_id")
    _write(rows.withColumn("value", _joined(F.col("gene_id"), F.col("gene_name"), F.col("exon_count"), _listed("starts"), _listed("ends"), _listed("frames"))), ["gene_id"], folder, EXONS)
    stem, ending = FAMILIES.split(".")
    _write(families.select(F.lit(stem).alias("name"), "gene_id", "family_id", _joined(F.col("gene_id"), F.col("family_id")).alias("value")), ["gene_id", "family_id"], folder, f".{ending}")
