"""One query for each operator, over the fixture of the test tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.config import FusionConfig
from junctura.functions.columns import family_motif, number_list, percent
from junctura.operators import annotate, clusters, cover, proximity, report
from junctura.operators.order import running
from junctura.plans import detect
from junctura.sources import fixture as fx
from junctura.sources import refgene, sam, sam_bytes
from junctura.tables import cut, cut_each, parts_of, remove

HEADER_BYTES = 1000
PRIME = 2**31 - 1
KEYS = ["g", "m", "is_mate"]
RID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seg"]
#: What tells the genes and chromosomes of both ends.
ENDS = ("chr", "mchr", "swapped")


def mapped(s: SparkSession, d: str, min_mapq: int = 0) -> DataFrame:
    reads = fx.reads(s, d).withColumn("chr", F.when(F.col("chr") < fx.UNMAPPED, F.col("chr")))
    return sam.mapped(reads, min_mapq)


def gene_bins(s: SparkSession, d: str) -> DataFrame:
    """Intervals of first genes as a table, so that its size decides on a broadcast."""
    return cut(annotate.first_intervals(fx.genes(s, d)), "bins")


def with_gene(s: SparkSession, d: str) -> DataFrame:
    return annotate.first_in_bins(mapped(s, d), gene_bins(s, d))


def with_mate(s: SparkSession, d: str) -> DataFrame:
    bins = gene_bins(s, d)
    return annotate.first_in_bins(annotate.first_in_bins(mapped(s, d), bins), bins, "mchr", "mcoord", "mgene")


def order_of(keep: tuple[str, ...]) -> list[str]:
    """As much of the reads' order as decides on the columns of ``keep``: equal reads differ in none of them where they agree in these."""
    return fx.ORDER[: max((fx.ORDER.index(c) + 1 for c in keep if c in fx.ORDER), default=0)]


def distinct_reads(s: SparkSession, d: str, keep: tuple[str, ...]) -> DataFrame:
    return detect.distinct_reads(mapped(s, d), fx.genes(s, d), None, order_of(keep), keep=[*keep])


def kept(s: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Discordant distinct reads of cross-family clusters, as a table: g, m, both positions and the columns of ``keep``."""
    return detect.distinct_reads(mapped(s, d), fx.genes(s, d), fx.families(s, d), order_of(keep), keep=[*keep])


def enough(s: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return detect.enough_reads(mapped(s, d), fx.genes(s, d), fx.families(s, d), order_of(keep), keep=[*keep])


def close(s: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return detect.supported(mapped(s, d), fx.genes(s, d), fx.families(s, d), order_of(keep), keep=[*keep])


def framed(s: SparkSession, d: str, keep: tuple[str, ...] = ENDS) -> DataFrame:
    return report.with_frames(report.orient(close(s, d, keep)), fx.exons(s, d))


def summary(s: SparkSession, d: str) -> DataFrame:
    reads = framed(s, d, (*ENDS, "l_linenumber")).withColumn("line_len", 100 + F.col("l_linenumber"))
    return report.summarize(reads, HEADER_BYTES, ["coord", "mcoord", "chr", "mchr"])


def scan_mapped(s, d):
    return mapped(s, d).select(*RID, "mapq", "chr", "coord", "mchr", "mcoord")


def chr_counts(s, d):
    return fx.reads(s, d).groupBy("chr").agg(F.count("*").alias("n"))


def mapq_threshold(s, d):
    return mapped(s, d, 3).groupBy("chr", "mapq").agg(F.count("*").alias("n"), F.sum("coord").alias("coords"))


def chr_lookup(s, d):
    names = s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name")).union(s.read.parquet(f"{d}/nation.parquet").select("n_name"))
    return sam.chromosome_index(names, fx.chromosomes(s, d), "name", "chr").select("name", F.coalesce("chr", F.lit(fx.UNMAPPED)).alias("chr"))


def _records(s, d, cfg=FusionConfig()):
    """(header, chromosomes, parsed reads) of the fixture's SAM text."""
    head = fx.header(s, d)
    chrs = sam.chromosomes(head)
    lines = cut(head.select("value").union(fx.sam_lines(s, d).select("value")), "sam")  # stands for the file: its text is not rendered anew for each use
    return head, chrs, sam.parse_lines(lines, chrs, cfg)


def sam_header(s, d):
    """The chromosome dictionary of the header's lines."""
    return _records(s, d)[1]


def sam_parse(s, d):
    """Every parsed record of a paired file; index 5 is unmapped."""
    at = lambda c: F.coalesce(c, F.lit(fx.UNMAPPED)).alias(c)
    return _records(s, d)[2].select("line_len", at("chr"), "coord", at("mchr"), "mcoord", "mapq", F.hex("line_key").alias("line_key"))


def sam_single_end(s, d):
    """Mapped records of the same text as single-end reads over a quality threshold."""
    reads = sam.mapped(_records(s, d, FusionConfig(paired=False, min_mapq=4))[2], 4)
    return reads.groupBy("chr", "mapq").agg(F.count("*").alias("n"), F.sum("coord").alias("coords"), F.sum("line_len").cast("long").alias("bytes"), F.count("mchr").alias("mates"), F.count("mcoord").alias("mate_positions"))


def mate_chr_resolve(s, d):
    """Mate columns of SAM lines: same chromosome, none, a name."""
    head, chrs, reads = _records(s, d)
    cells = F.split("raw", "\t")
    known = reads.withColumns({"rnext": cells[6], "chr_a": F.coalesce("chr", F.lit(fx.UNMAPPED))})
    return known.groupBy("chr_a", "rnext", F.coalesce("mchr", F.lit(fx.UNMAPPED)).alias("mchr")).agg(F.count("*").alias("n"))


def orientation_counts(s, d):
    return clusters.canonical_pairs(mapped(s, d).withColumns({"gene": F.lit(1), "mgene": F.lit(2)})).groupBy("chr", "is_mate").agg(F.count("*").alias("n"))


def gene_first_match(s, d):
    return with_gene(s, d).select(*RID, "mapq", "chr", "coord", "gene")


def gene_all_matches(s, d):
    hits = annotate.match_genes(mapped(s, d), fx.genes(s, d), "chr", "coord").withColumn("gene", F.explode("hits"))
    return hits.groupBy("gene").agg(F.count("*").alias("n"), F.sum("coord").alias("coords"))


def gene_hit_miss(s, d):
    found = annotate.match_genes(mapped(s, d), fx.genes(s, d), "chr", "coord", how="left").withColumn("hit", F.coalesce(F.size("hits"), F.lit(0)) > 0)
    return found.groupBy("chr").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def mate_gene(s, d):
    return with_mate(s, d).groupBy("gene", "mgene").agg(F.count("*").alias("n"), F.sum("mcoord").alias("mcoords"))


def canonical_pairs(s, d):
    return clusters.canonical_pairs(with_mate(s, d)).groupBy("g", "m", "swapped", "is_mate").agg(F.count("*").alias("n"))


def discordant_reads(s, d):
    return clusters.discordant(with_mate(s, d)).select(*RID, "mapq", "g", "m", "swapped", "is_mate")


def cluster_counts(s, d):
    return clusters.cluster_counts(clusters.discordant(with_mate(s, d)))


def cluster_stats_by_source(s, d):
    return clusters.stats_by_source(distinct_reads(s, d, ("l_linenumber",)), "l_linenumber")


def gene_intervals(s, d):
    """Gene intervals of the transcript table."""
    return fx.genes(s, d)


def exon_table(s, d):
    """Exons of the transcript table, one row each."""
    e = fx.exons(s, d).select("gene_id", "gene_name", "exon_count", F.posexplode(F.arrays_zip("starts", "ends", "frames")).alias("k", "e"))
    return e.select("gene_id", "gene_name", "exon_count", "k", F.col("e.starts").alias("e_start"), F.col("e.ends").alias("e_end"), F.col("e.frames").alias("frame"))


def gene_families(s, d):
    return fx.families(s, d).join(fx.exons(s, d), "gene_id").select("gene_id", family_motif(F.col("gene_name")).alias("motif"), "family_id")


def gene_families_literal(s, d):
    """The order-dependent fold over the transcript table's symbols."""
    return fx.families(s, d, literal=True)


def same_family_clusters(s, d):
    return clusters.with_families(cluster_counts(s, d), fx.families(s, d)).filter("g_family = m_family").select("g", "m", "n", F.col("g_family").alias("family_id"))


def cross_family_clusters(s, d):
    return clusters.cross_family(cluster_counts(s, d), fx.families(s, d)).select("g", "m", "n")


def dedup_reads(s, d):
    return distinct_reads(s, d, ("chr", "mchr", *RID)).select(*RID, "g", "m", "chr", "mchr", "coord", "mcoord")


def min_support(s, d):
    return clusters.cluster_counts(kept(s, d)).filter("n > 5")


def min_support_reads(s, d):
    return enough(s, d, (*RID,)).select(*RID, "g", "m", "coord", "mcoord")


def proximity_reads(s, d):
    return proximity.l1_neighbours(enough(s, d), KEYS, "coord", "mcoord", 199).select("g", "m", "is_mate", "coord", "mcoord")


def proximity_tight(s, d):
    return proximity.l1_neighbours(enough(s, d), KEYS, "coord", "mcoord", 20).select("g", "m", "is_mate", "coord", "mcoord")


def proximity_clusters(s, d):
    return clusters.cluster_counts(close(s, d))


def top_cluster(s, d):
    return proximity_clusters(s, d).orderBy(F.desc("n"), "g", "m").limit(1)


def cover_neighbours(s, d):
    """Clusters that share a gene with the largest one (one row, the only thing that is broadcast)."""
    counts = cut(proximity_clusters(s, d), "counts")
    top = counts.orderBy(F.desc("n"), "g", "m").limit(1).select(F.col("g").alias("tg"), F.col("m").alias("tm"))
    near = F.col("g").isin(F.col("tg"), F.col("tm")) | F.col("m").isin(F.col("tg"), F.col("tm"))
    return counts.join(F.broadcast(top.limit(1)), near & ~((F.col("g") == F.col("tg")) & (F.col("m") == F.col("tm")))).select("g", "m", "n")


def cover_round1(s, d):
    """Clusters that win the first round, and what it leaves to the others."""
    winners, left = cover.cover_round(cut(close(s, d), "close"), 5)
    return winners.select("g", "m", "n", F.lit(True).alias("winner")).unionByName(clusters.cluster_counts(left).withColumn("winner", F.lit(False)))


def set_cover(s, d):
    return clusters.cluster_counts(cover.greedy_cover(close(s, d)))


def set_cover_report(s, d):
    """The whole job: report rows of the clusters that the cover keeps."""
    reads = mapped(s, d).withColumn("line_len", 100 + F.col("l_linenumber"))
    return detect.detect(reads, fx.genes(s, d), fx.families(s, d), fx.exons(s, d), fx.chromosomes(s, d), order_of(("l_linenumber",)), HEADER_BYTES).clusters


def report_lines(s, d):
    """The readable report of the clusters before the cover."""
    return report.report_lines(cluster_list(s, d))


def supporting_lines(s, d):
    """The whole job from SAM files: lines of the reads of each cluster that the cover keeps; plans carry places in the files, text is read by them at the end."""
    path = fx.sam_files(s, d)
    _, chrs, reads = sam.read_sam(s, path)
    result = detect.detect(sam.mapped(reads), fx.genes(s, d), fx.families(s, d), fx.exons(s, d), chrs, sam.PLACE, HEADER_BYTES)
    return detect.supporting_lines(result, path)


def sam_positions(s, d):
    """Every line of the SAM files but their headers, with its place. Some files at a time are on disk: their text is larger than all that is told of it."""
    step = -(-fx.FILES // parts_of(s, f"{d}/lineitem.parquet"))

    def places() -> Iterator[DataFrame]:
        for first in range(0, fx.FILES, step):
            path = fx.sam_files(s, d, first, min(first + step, fx.FILES))
            lines = sam_bytes.read(s, path).filter(~F.col("value").startswith("@"))
            yield lines.select((F.col("file") + first).cast("int").alias("file"), "position", "line_len", F.unhex(F.md5("value")).alias("digest"))
            remove(s, path)

    return cut_each(places(), "places").withColumn("digest", F.lower(F.hex("digest")))


def oriented_reads(s, d):
    return report.orient(close(s, d, ENDS)).select("g", "m", "chr", "coord", "gene", "mchr", "mcoord", "mgene")


def exon_frames(s, d):
    return framed(s, d).select("g", "m", "coord", "mcoord", "gene", "mgene", "frame", "mframe")


def exon_frames_literal(s, d):
    """Frames by the exon lists of each cluster's first read, and by their first exon."""
    framed = report.with_frames(report.orient(close(s, d, ENDS)), fx.exons(s, d), FusionConfig(compat="literal"), ["chr", "mchr"])
    return framed.select("g", "m", "coord", "mcoord", "gene", "mgene", "gene_name", "mgene_name", "frame", "mframe")


def exon_match_pct(s, d):
    return report.match_percent(framed(s, d))


def breakpoints(s, d):
    return report.breakpoints(close(s, d))


def breakpoints_literal(s, d):
    return report.breakpoints(close(s, d), FusionConfig(compat="literal"))


def cluster_byte_index(s, d):
    return summary(s, d).select("cluster_rank", "g", "m", "nbreads", "offset_start", "offset_length")


def cluster_list(s, d):
    return report.cluster_list(summary(s, d), fx.chromosomes(s, d))


def fusion_report(s, d):
    """Clusters, reads and shares over all clusters."""
    return summary(s, d).agg(F.count("*").alias("clusters"), F.sum("nbreads").alias("reads"), F.max("nbreads").alias("largest"), percent(F.count_if(F.col("exon_match_percent") > 10), F.count("*")).alias("in_frame_pct"))


def _refgene(s, d):
    """Parts as transcripts: accessions, seven contigs of which five have a name."""
    p = s.read.parquet(f"{d}/part.parquet")
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "NR_").otherwise("NM_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    rows = p.select(name.alias("name"), F.concat(F.lit("c"), (F.col("p_partkey") % 7).cast("string")).alias("chrom"), F.col("p_type").alias("name2"))
    return refgene.rename(rows, fx.contig_names(s, d))


def refgene_rename(s, d):
    return _refgene(s, d).select("gene_id", "chrom")


def family_fold(s, d):
    """The order-dependent family fold over all part types as symbols."""
    return refgene.families(_refgene(s, d).withColumn("name2", F.regexp_replace("name2", "(?<=^.{4})[A-Z]", "1")), literal=True)


def exon_arrays(s, d):
    """Comma lists to numbers and back to figures."""
    e = fx.exons(s, d)
    listed = lambda c: F.concat(F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))), F.lit(","))
    back = e.select("gene_id", number_list(listed("starts")).alias("starts"), number_list(listed("ends")).alias("ends"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    return back.select("gene_id", F.size("starts").cast("long").alias("exon_count"), total("starts").alias("sum_starts"), F.array_max("ends").alias("last_end"))


def _ranked(s, d, first, then):
    return running(mapped(s, d), [first, then, *RID, "mapq"], "rank", keys=["chr"]).select("chr", "coord", "mcoord", "rank")


def sorted_reads(s, d):
    return _ranked(s, d, "coord", "mcoord")


def sorted_mates(s, d):
    return _ranked(s, d, "mcoord", "coord")


def cluster_rank_desc(s, d):
    return running(proximity_clusters(s, d), [F.desc("n"), "g", "m"], "rank")


def cluster_rank_asc(s, d):
    """Clusters from the smallest to the largest (the ascending merge order)."""
    return running(proximity_clusters(s, d), ["n", "g", "m"], "rank")


def sorted_coordinates(s, d):
    """Distinct coordinates of each chromosome in order: their number, and a digest that depends on their order.

    The digest is a sum of values times ranks, modulo a prime; ranks come from ranges, so no chromosome is gathered.
    """
    ranked = running(mapped(s, d).select("chr", "coord").distinct(), ["coord"], "rank", keys=["chr"])
    weighed = F.col("rank").cast("decimal(18,0)") * (F.col("coord") * 48271 % PRIME).cast("decimal(10,0)")
    return ranked.groupBy("chr").agg(F.count("*").alias("n"), (F.sum(weighed) % PRIME).cast("long").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        sam_header, sam_parse, sam_positions, sam_single_end, scan_mapped, chr_counts, mapq_threshold, chr_lookup, mate_chr_resolve, orientation_counts, gene_first_match, gene_all_matches, gene_hit_miss,
        mate_gene, canonical_pairs, discordant_reads, cluster_counts, cluster_stats_by_source, gene_intervals, exon_table, gene_families, gene_families_literal, same_family_clusters, cross_family_clusters,
        dedup_reads, min_support, min_support_reads, proximity_reads, proximity_tight, proximity_clusters, top_cluster, cover_neighbours, cover_round1,
        set_cover, set_cover_report, report_lines, supporting_lines, oriented_reads, exon_frames, exon_frames_literal, exon_match_pct, breakpoints, breakpoints_literal, cluster_byte_index, cluster_list,
        fusion_report, refgene_rename, family_fold, exon_arrays, sorted_reads, sorted_mates, cluster_rank_desc, cluster_rank_asc, sorted_coordinates,
    )
}
