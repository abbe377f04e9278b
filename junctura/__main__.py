"""spark-submit or ``python -m junctura``: detect fusion candidates in a SAM file and write the report and its reads."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.config import FusionConfig
from junctura.operators.report import report_lines, to_lines
from junctura.plans.counters import Counters
from junctura.plans.detect import FusionResult, detect, supporting_lines, supporting_lines_by_key
from junctura.sources import indexed, prepared, refgene, sam
from junctura.tables import clear, cut


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--sam", required=True, help="a SAM file, or a folder of files with one header")
    p.add_argument("--refgene", help="UCSC transcript table; with --chr-names")
    p.add_argument("--chr-names", help="lines ref_name=sam_name")
    p.add_argument("--reference-dir", help="prepared folder: <chr>.gtf, <chr>_exon.gtf, family_gene.txt; in place of --refgene")
    p.add_argument("--save-reference", help="write the reference built from --refgene as such a folder")
    p.add_argument("--out", required=True)
    p.add_argument("--min-mapq", type=int, default=0)
    p.add_argument("--min-reads", type=int, default=5)
    p.add_argument("--alpha", type=int, default=200)
    p.add_argument("--slack", type=int, default=50)
    p.add_argument("--single-end", action="store_true")
    p.add_argument("--text-reader", action="store_true", help="read the SAM text through Spark's text reader, from any path that Spark can read; lines are then told apart by digests, not byte positions")
    p.add_argument("--compat", choices=["intended", "literal"], default="intended")
    p.add_argument("--log", default="junctura-stages.log", help="file of this machine to which stages, seconds and counters are appended")
    p.add_argument("--work-dir", help="folder that the driver and all executors share, for tables between stages; the session's spark.checkpoint.dir if it has one")
    return p


def main(argv: list[str] | None = None) -> None:
    p = options()
    a = p.parse_args(argv)
    if bool(a.reference_dir) == bool(a.refgene and a.chr_names):
        p.error("give --reference-dir, or --refgene and --chr-names")
    cfg = FusionConfig(a.min_reads, a.alpha, a.slack, a.min_mapq, not a.single_end, a.compat)
    builder = SparkSession.builder.appName("junctura")
    spark = (builder.config("spark.checkpoint.dir", a.work_dir) if a.work_dir else builder).getOrCreate()
    clock = Stages(a.log)
    header, chrs, reads = sam.read_sam(spark, a.sam, cfg, not a.text_reader)
    keys = ["line_key"] if a.text_reader else sam.PLACE
    counters = Counters(chrs.count())
    # one scan of the alignment text; what follows reads a few numbers and a place for each record
    slim = cut(sam.mapped(counters.by_chr(reads, "reads"), cfg.min_mapq).select(*keys, "line_len", "chr", "coord", "mchr", "mcoord", "mapq"), "reads")
    clock.done("scan")
    if a.reference_dir:
        tables = prepared.read_reference(spark, a.reference_dir, chrs)
    else:
        tables = refgene.build_reference(refgene.read_refgene(spark, a.refgene), refgene.read_chromosome_map(spark, a.chr_names), chrs, a.compat == "literal")
    genes, exons, families = (cut(t, "reference") for t in tables)
    if a.save_reference:
        prepared.write_reference(genes, exons, families, chrs, a.save_reference)
    clock.done("reference")
    size = header.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    result = detect(slim, genes, families, exons, chrs, sam.KEY if a.text_reader else sam.PLACE, size, cfg, counters)
    result = replace(result, clusters=cut(result.clusters, "clusters"))
    clock.done("detect")
    for row in report_lines(result.clusters).orderBy("cluster_rank").toLocalIterator():
        print(row.line)
    write_result(result, header, a.out, supporting_lines_by_key(result, reads) if a.text_reader else supporting_lines(result, a.sam))
    clock.done("write")
    totals = result.clusters.agg(F.count("*"), F.sum("nbreads")).first()
    clear(spark)
    names = {r.chr: r.chr_name for r in chrs.collect()}
    clock.end({"clusters": totals[0], "supporting_reads": totals[1] or 0} | described(counters, names))
    print(f"{totals[0]} clusters, {totals[1] or 0} reads; {clock}")


def described(counters: Counters, names: dict[int, str]) -> dict:
    """Counts under names: reads by chromosome, gene hits and misses of both ends, and what each filter removed."""
    v = counters.values()
    named = lambda by: {names.get(c, "unmapped"): n for c, n in sorted(by.items(), key=lambda x: (x[0] is None, x[0]))}
    total = lambda name: sum(v[name].values())
    misses = {c: n - v["gene_hits"].get(c, 0) for c, n in v["mapped"].items()}
    return {
        "reads": total("reads"), "reads_by_chr": named(v["reads"]), "mapped": total("mapped"), "mapped_by_chr": named(v["mapped"]), "gene_hits": total("gene_hits"), "gene_hits_by_chr": named(v["gene_hits"]),
        "gene_misses": sum(misses.values()), "gene_misses_by_chr": named(misses), "mate_hits": total("mate_hits"), "mate_misses": total("gene_hits") - total("mate_hits"), "discordant": v["discordant"],
        "same_family_removed": v["discordant"] - v["cross_family"], "duplicates_removed": v["cross_family"] - v["distinct"], "distinct": v["distinct"], "close": v["close"], "supporting": v["supporting"],
    }


class Stages:
    """Wall-clock seconds of each stage, printed and appended to a log as they end: start, stage, seconds, counters."""

    def __init__(self, log: str | None = None) -> None:
        self.at, self.began, self.took, self.log = time.perf_counter(), datetime.now(UTC), {}, log

    def done(self, name: str) -> None:
        now = time.perf_counter()
        self.took[name] = now - self.at
        print(f"{name}: {self.took[name]:.1f} s", flush=True)
        self._append(name, self.took[name], None)
        self.at, self.began = now, datetime.now(UTC)

    def end(self, counters: dict) -> None:
        self._append("total", sum(self.took.values()), counters)

    def _append(self, name: str, seconds: float, counters: dict | None) -> None:
        if self.log:
            with open(self.log, "a", encoding="utf-8") as f:
                f.write(f"{self.began.isoformat(timespec='seconds')}\t{name}\t{seconds:.3f}\t{json.dumps(counters) if counters else ''}\n")

    def __str__(self) -> str:
        return ", ".join(f"{name} {s:.1f} s" for name, s in self.took.items())


def write_result(result: FusionResult, header: DataFrame, out: str, lines: DataFrame) -> None:
    """cluster_list.cl (report lines), reads.sam (header, then ``lines`` by cluster) and reads.index (the parts of reads.sam and their first bytes).

    Offsets of the report count through the parts of reads.sam, joined by name; ``indexed.cluster_bytes`` reads a cluster's lines by them.
    """
    spark = header.sparkSession
    own = [c for c in (*sam.PLACE, "line_key") if c in lines.columns]
    body = lines.select(F.lit(1).alias("part"), "cluster_rank", "coord", "mcoord", *own, "value")
    zero = lambda c: F.lit(0).cast("long").alias(c)
    head = header.select(F.lit(0).alias("part"), zero("cluster_rank"), F.col("line_no").cast("long").alias("coord"), zero("mcoord"), *[F.lit(None).cast(body.schema[c].dataType).alias(c) for c in own], "value")
    to_lines(result.clusters).write.mode("overwrite").text(f"{out}/cluster_list.cl")
    head.unionByName(body).orderBy("part", "cluster_rank", "coord", "mcoord", *own).select("value").write.mode("overwrite").text(f"{out}/reads.sam")
    indexed.write_index(spark, f"{out}/reads.sam", f"{out}/reads.index")


if __name__ == "__main__":
    main()
