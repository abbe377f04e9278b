"""The detection job: reads and reference tables to supported fusion candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.config import FusionConfig
from junctura.functions.columns import is_mate
from junctura.operators import annotate, clusters, proximity, report
from junctura.operators.cover import greedy_cover
from junctura.plans.counters import Counters, NoCounters
from junctura.sources import sam, sam_bytes
from junctura.tables import cut, cut_in_parts, drop


@dataclass(frozen=True)
class FusionResult:
    """reads: oriented supporting reads with frames and gene names. clusters: the report columns. summary: clusters before naming."""

    reads: DataFrame
    summary: DataFrame
    clusters: DataFrame


def _hits(reads: DataFrame, bins: DataFrame, columns: list[str], named: dict[str, str], counters: Counters) -> DataFrame:
    """Reads with a gene at their own end: both positions, mchr, gene and ``columns``."""
    found = counters.by_chr(annotate.first_in_bins(counters.by_chr(reads, "mapped"), bins, "chr", "coord", "gene", named), "gene_hits")
    return found.select(*dict.fromkeys(["coord", "mchr", "mcoord", "gene", *named.values(), *columns]))


def _pairs(hits: DataFrame, bins: DataFrame, named: dict[str, str], counters: Counters) -> DataFrame:
    """Those of ``hits`` with another gene at the mate's end."""
    both = counters.by_chr(annotate.first_in_bins(hits, bins, "mchr", "mcoord", "mgene", named), "mate_hits", "mchr")
    return counters.rows(clusters.discordant(both), "discordant")


def candidates(reads: DataFrame, genes: DataFrame, cfg: FusionConfig = FusionConfig(), counters: Counters = NoCounters()) -> DataFrame:
    """Discordant reads: both ends in a gene, and not the same. The genes' intervals are written once for both joins."""
    bins = cut(annotate.first_intervals(genes, cfg.slack), "bins")
    return _pairs(_hits(reads, bins, reads.columns, {}, counters), bins, {}, counters)


def _distinct(reads: DataFrame, genes: DataFrame, families: DataFrame | None, order: list[str], cfg: FusionConfig, counters: Counters, keep: list[str] | None) -> DataFrame:
    """Distinct reads as a written table: g, m, both positions and the columns of ``keep``.

    Reads are written between the two joins with genes, so that the shuffle files of one are gone when the other begins; what comes after is
    done in parts by both positions, in which duplicates agree. Genes' families are joined to the intervals: no read is shuffled for them.
    """
    keep = [*reads.columns, "swapped"] if keep is None else keep
    carried = [c for c in dict.fromkeys([*order, *keep]) if c in reads.columns]
    wanted = list(dict.fromkeys([*clusters.PAIR, "coord", "mcoord", *keep]))
    intervals = annotate.first_intervals(genes, cfg.slack)
    named = lambda name: {} if families is None else {"family_id": name}
    bins = cut(intervals if families is None else intervals.join(clusters.one_family(families), "gene_id", "left"), "bins")
    hits = cut(_hits(reads, bins, carried, named("_family"), counters), "hits")

    def step(part: DataFrame) -> DataFrame:
        pairs = _pairs(part, bins, named("_mfamily"), counters)
        if families is not None:
            pairs = counters.rows(pairs.filter("_family is null or _mfamily is null or _family <> _mfamily"), "cross_family")
        slim = pairs.select(*dict.fromkeys([*wanted, *carried]))
        return counters.rows(clusters.dedup_reads(slim, order), "distinct").select(*wanted)

    table = cut_in_parts(hits, ["coord", "mcoord"], step, "distinct")
    drop(hits)
    drop(bins)
    return table


def _with_ends(reads: DataFrame) -> DataFrame:
    """``reads`` with what follows from their other columns and is not stored: is_mate and, where there is swapped, gene and mgene."""
    ends = {"is_mate": is_mate(F.col("coord"), F.col("mcoord"))}
    if "swapped" in reads.columns:
        ends |= {"gene": F.when(F.col("swapped"), F.col("m")).otherwise(F.col("g")), "mgene": F.when(F.col("swapped"), F.col("g")).otherwise(F.col("m"))}
    return reads.withColumns(ends)


def distinct_reads(reads: DataFrame, genes: DataFrame, families: DataFrame | None, order: list[str], cfg: FusionConfig = FusionConfig(), counters: Counters = NoCounters(), keep: list[str] | None = None) -> DataFrame:
    """Distinct reads of cross-family clusters (of all, without ``families``), as a written table: what follows reads them several times, the source only once.

    ``keep``: the columns that are wanted beside g, m and both positions (all, if None); ``swapped`` gives gene and mgene. Others stay behind before
    the first shuffle, but for those of ``order``, which go once duplicates are gone.
    """
    return _with_ends(_distinct(reads, genes, families, order, cfg, counters, keep))


def enough_reads(reads: DataFrame, genes: DataFrame, families: DataFrame, order: list[str], cfg: FusionConfig = FusionConfig(), counters: Counters = NoCounters(), keep: list[str] | None = None) -> DataFrame:
    """Distinct reads of cross-family clusters that have enough of them, as a written table; ``keep`` as above."""
    table = _distinct(reads, genes, families, order, cfg, counters, keep)
    enough = cut_in_parts(table, clusters.PAIR, lambda part: clusters.min_support(part, cfg.min_reads), "enough")
    drop(table)
    return _with_ends(enough)


def supported(reads: DataFrame, genes: DataFrame, families: DataFrame, order: list[str], cfg: FusionConfig = FusionConfig(), counters: Counters = NoCounters(), keep: list[str] | None = None) -> DataFrame:
    """Distinct reads of cross-family clusters that have enough reads, before and after the proximity filter, from a written table; ``keep`` as above."""
    table = _distinct(reads, genes, families, order, cfg, counters, keep)

    def step(part: DataFrame) -> DataFrame:
        enough = clusters.min_support(part, cfg.min_reads).withColumn("is_mate", is_mate(F.col("coord"), F.col("mcoord")))
        return counters.rows(proximity.l1_neighbours(enough, ["g", "m", "is_mate"], "coord", "mcoord", cfg.radius), "close").select(table.columns)

    close = cut_in_parts(table, clusters.PAIR, step, "close")
    drop(table)
    return clusters.min_support(_with_ends(close), cfg.min_reads)


def detect(
    reads: DataFrame, genes: DataFrame, families: DataFrame, exons: DataFrame, chrs: DataFrame, order: list[str], header_bytes: int = 0, cfg: FusionConfig = FusionConfig(), counters: Counters = NoCounters()
) -> FusionResult:
    """``reads``: mapped records with chr, coord, mchr, mcoord, line_len; ``order`` ranks equal records. Other columns stay behind.

    ``counters`` are told how many reads go into and come out of each step.
    """
    slim = reads.select(*dict.fromkeys(["chr", "coord", "mchr", "mcoord", "line_len", *order]))
    won = greedy_cover(supported(slim, genes, families, order, cfg, counters), cfg.min_reads)
    framed = cut(counters.rows(report.with_frames(report.orient(won), exons, cfg, order), "supporting"), "supporting")
    summary = report.summarize(framed, header_bytes, ["coord", "mcoord", *[c for c in order if c not in ("coord", "mcoord")]], cfg)
    return FusionResult(framed, summary, report.cluster_list(summary, chrs))


def supporting_lines(result: FusionResult, path: str) -> DataFrame:
    """(cluster_rank, coord, mcoord, file, position, line_len, value): lines by cluster, then position. Their text is read from the SAM files
    at ``path`` by byte ranges; nothing else of these is read or shuffled."""
    return sam_bytes.fetch(_ranked(result).select("cluster_rank", "coord", "mcoord", *sam.PLACE, "line_len"), path)


def supporting_lines_by_key(result: FusionResult, lines: DataFrame) -> DataFrame:
    """(cluster_rank, coord, mcoord, line_key, value), for reads without places: text is joined from ``lines`` (line_key, raw).

    Lines that no read needs go first, in a semi join whose small side Spark broadcasts below its threshold; only the others' text is de-duplicated.
    """
    ranked = _ranked(result).select("cluster_rank", "coord", "mcoord", "line_key")
    text = lines.select("line_key", "raw").join(ranked.select("line_key").distinct(), "line_key", "left_semi").dropDuplicates(["line_key"])
    return ranked.join(text, "line_key").select("cluster_rank", "coord", "mcoord", "line_key", F.col("raw").alias("value"))


def _ranked(result: FusionResult) -> DataFrame:
    return result.reads.join(result.summary.select("g", "m", "cluster_rank"), ["g", "m"])
