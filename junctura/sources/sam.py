"""SAM text: header, chromosome dictionary and read records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.config import FusionConfig
from junctura.sources import sam_bytes

#: What tells lines apart and ranks equal reads: their place, or without places their digest.
PLACE, KEY = ["file", "position"], ["chr", "mchr", "line_key"]
HEAD_ROWS = 1000


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the ``@`` lines at the start of a file, in file order. Only the head of the file is read.

    ``take`` reads a file's splits in order and stops as soon as it has enough rows; it asks for more until a
    record line (or the file's end) is seen, so no header is too long.
    """
    n = HEAD_ROWS
    while True:
        rows = [r.value for r in spark.read.text(path).take(n)]
        head = next((i for i, x in enumerate(rows) if not x.startswith("@")), len(rows))
        if head < len(rows) or len(rows) < n:
            return spark.createDataFrame(list(enumerate(rows[:head], 1)), "line_no int, value string")
        n *= 8


def chromosomes(header: DataFrame) -> DataFrame:
    """(chr, chr_name) in header order, from 0, of the ``@SQ`` lines; a header is small by its kind."""
    names = header.filter(F.col("value").startswith("@SQ")).select("line_no", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chr_name"))
    return names.select((F.row_number().over(Window.orderBy("line_no")) - 1).cast("int").alias("chr"), "chr_name")


def chromosome_index(df: DataFrame, chrs: DataFrame, name: str, out: str) -> DataFrame:
    """``df`` with the index of chromosome ``name``; null if it is unknown."""
    dim = chrs.select(F.col("chr_name").alias("_name"), F.col("chr").alias(out))
    return df.join(dim, F.col(name) == F.col("_name"), "left").drop("_name")


def parse_lines(lines: DataFrame, chrs: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Reads of (value): line_key, raw, line_len, chr, coord, mchr, mcoord, mapq; unmapped ends have a null chr.

    Header lines, null lines, lines without a position and lines with fewer than eleven columns are passed over. Single-end input
    has null mates. Equal lines stay. ``line_key`` is a digest of the line. Lines with a place (file, position) keep it:
    plans carry it instead of ``raw`` and fetch the text at the end.
    """
    place = [c for c in PLACE if c in lines.columns]
    rows = lines.filter(~F.col("value").startswith("@")).withColumn("c", F.split("value", "\t", 12)).filter(F.size("c") >= 11)
    mate = F.when(F.col("c")[6] == "=", F.col("c")[2]).otherwise(F.col("c")[6])
    parsed = rows.select(
        *place,
        F.unhex(F.md5("value")).alias("line_key"),
        F.col("value").alias("raw"),
        (F.octet_length("value") + 1).alias("line_len"),
        F.col("c")[2].alias("rname"),
        F.expr("try_cast(c[3] as bigint)").alias("coord"),
        F.expr("try_cast(c[4] as int)").alias("mapq"),
        (mate if cfg.paired else F.lit(None).cast("string")).alias("mname"),
        F.expr("try_cast(c[7] as bigint)" if cfg.paired else "cast(null as bigint)").alias("mcoord"),
    ).filter("coord is not null")
    placed = chromosome_index(chromosome_index(parsed, chrs, "rname", "chr"), chrs, "mname", "mchr")
    return placed.select(*place, "line_key", "raw", "line_len", "chr", "coord", "mchr", "mcoord", "mapq")


def read_sam(spark: SparkSession, path: str, cfg: FusionConfig = FusionConfig(), places: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, chromosomes, reads) of a file or a folder of files with one header; see ``parse_lines``.

    With ``places`` reads have their file and byte position, from files that Arrow can open; without, lines come through
    Spark's text reader, from any path that Spark can read, and are told apart by line_key.
    """
    header = header_lines(spark, path)
    chrs = chromosomes(header)
    return header, chrs, parse_lines(sam_bytes.read(spark, path) if places else spark.read.text(path).select("value"), chrs, cfg)


def mapped(reads: DataFrame, min_mapq: int = 0) -> DataFrame:
    return reads.filter(F.col("chr").isNotNull() & (F.col("mapq") > min_mapq))
