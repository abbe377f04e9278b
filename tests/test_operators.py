"""Boundary cases by hand, and operators against plain loops on random rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from junctura.config import FusionConfig
from junctura.operators import annotate, clusters, cover, proximity, report
from junctura.plans import detect
from junctura.sources import refgene, sam, sam_bytes

GENES = "chr int, tx_start long, tx_end long, gene_id long"


def test_first_match_bounds(spark):
    genes = spark.createDataFrame([(0, 1000, 2000, 7), (0, 900, 1100, 8), (0, 5000, 4000, 9), (1, 1000, 2000, 10), (0, 900, 1100, 11)], GENES)
    points = {850: 8, 849: None, 1100: 8, 1101: 7, 2000: 7, 2001: None, 4500: None}
    reads = spark.createDataFrame([(0, x) for x in points], "chr int, coord long")
    found = {r.coord: r.gene for r in annotate.first_gene(reads, genes).collect()}
    # equal starts go by id as text: "11" comes before "8"
    assert found == {k: 11 if v == 8 else v for k, v in points.items() if v}


def test_first_match_random(spark):
    rng = random.Random(1)
    genes = [(rng.randrange(2), s, s + rng.randrange(1, 40_000), i) for i, s in enumerate(rng.randrange(0, 90_000) for _ in range(60))]
    reads = [(rng.randrange(2), rng.randrange(0, 140_000)) for _ in range(400)]
    want = []
    for c, x in reads:
        hits = [(s, str(i), i) for g, s, e, i in genes if g == c and x + 50 >= s and x <= e]
        if hits:
            want.append((c, x, min(hits)[2]))
    got = annotate.first_gene(spark.createDataFrame(reads, "chr int, coord long"), spark.createDataFrame(genes, GENES))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_exon_frames(spark):
    exons = spark.createDataFrame([(1, "A", 2, [100, 300], [200, 400], [0, 2])], "gene_id long, gene_name string, exon_count int, starts array<long>, ends array<long>, frames array<int>")
    at = [99, 50, 49, 199, 200, 250, 249, 399, 400]
    rows = spark.createDataFrame([(1, 1, 1, 1, x, x) for x in at], "g long, m long, gene long, mgene long, coord long, mcoord long")
    got = {r.coord: r.frame for r in report.with_frames(rows, exons).collect()}
    assert got == {99: 0, 50: 0, 49: -2, 199: 0, 200: -2, 250: 2, 249: -2, 399: 2, 400: -2}
    literal = {r.coord: r.frame for r in report.with_frames(rows, exons, FusionConfig(compat="literal")).collect()}
    assert literal[399] == 0


def test_dedup_and_support(spark):
    rows = [(1, 2, 10, 20, i) for i in range(2)] + [(1, 2, 10, 0, i) for i in range(2)] + [(3, 4, i, 1, 0) for i in range(6)]
    reads = spark.createDataFrame(rows, "g long, m long, coord long, mcoord long, o int")
    kept = clusters.dedup_reads(reads, ["o"])
    assert kept.filter("g = 1").count() == 3
    assert {(r.g, r.m) for r in clusters.min_support(kept, 5).collect()} == {(3, 4)}


@pytest.mark.parametrize("radius", [1, 20, 199])
def test_proximity_random(spark, radius):
    rng = random.Random(radius)
    rows = sorted({(rng.randrange(3), rng.randrange(-300, 1500), rng.randrange(-300, 1500)) for _ in range(500)} | {(0, 0, 0), (0, radius, 0), (1, 0, 0), (1, 5000, radius + 5001)})
    want = [r for r in rows if any(q != r and q[0] == r[0] and abs(q[1] - r[1]) + abs(q[2] - r[2]) <= radius for q in rows)]
    got = proximity.l1_neighbours(spark.createDataFrame(rows, "k int, x long, y long"), ["k"], "x", "y", radius)
    assert sorted(map(tuple, got.collect())) == want


def sequential_cover(rows, least):
    left, won = list(rows), []
    while True:
        n = {}
        for r in left:
            n[r[:2]] = n.get(r[:2], 0) + 1
        top = min(n, key=lambda p: (-n[p], p), default=None)
        if top is None or n[top] <= least:
            return sorted(won)
        own = [r for r in left if r[:2] == top]
        won += own
        places = {x for r in own for x in r[2:4]}
        left = [r for r in left if r[:2] != top and not (set(r[:2]) & set(top) and (r[2] in places or r[3] in places))]


def test_cover_strategies_agree(spark):
    rng = random.Random(3)
    rows = sorted({(*sorted(rng.sample(range(8), 2)), rng.randrange(12), rng.randrange(12)) for _ in range(160)})
    rows += [(20, 21, i, i + 1) for i in range(5)]
    reads = spark.createDataFrame(rows, "g long, m long, coord long, mcoord long")
    want = sequential_cover(rows, 5)
    assert want
    assert sorted(map(tuple, cover.greedy_cover(reads, 5).collect())) == want
    for task, batch in ((0, 1_000_000), (0, 1), (30, 25)):
        assert sorted(map(tuple, cover.greedy_cover(reads, 5, task, batch).collect())) == want


def chain(n):
    """Clusters of falling size, each with a read that the one before removes, so that each waits for the one before."""
    rows = []
    for c in range(n):
        rows += [(c, c + 1, 1000 * c + i, 500_000 + 1000 * c + i) for i in range(8 + 2 * (n - c))] + [(c, c + 1, 1000 * (c - 1), 7_000_000 + c)] * (c > 0)
    return rows


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    rows = chain(14)
    rounds = []
    one = cover.cover_round
    monkeypatch.setattr(cover, "cover_round", lambda *a: rounds.append(1) or one(*a))
    reads = spark.createDataFrame(rows, "g long, m long, coord long, mcoord long")
    assert sorted(map(tuple, cover.greedy_cover(reads, 5, task_reads=0).collect())) == sequential_cover(rows, 5)
    assert len(rounds) == 1
    rounds.clear()
    assert sorted(map(tuple, cover.greedy_cover(reads, 5, task_reads=100, batch_reads=60).collect())) == sequential_cover(rows, 5)
    assert len(rounds) <= 5


def test_rounds_fall_into_parts_that_share_positions(spark):
    rows = [(1, 2, 10, 20), (1, 3, 10, 30), (1, 4, 11, 40), (5, 6, 10, 20), (5, 7, None, None)]
    reads = spark.createDataFrame(rows, "g long, m long, coord long, mcoord long")
    found = {(r.g, r.m): r._component for r in cover.overlap_components(reads).collect()}
    assert found[1, 2] == found[1, 3] and len({found[p] for p in ((1, 2), (1, 4), (5, 6), (5, 7))}) == 4


def fold(lines):
    """Family of each line ``symbol<TAB>id``, by the pass itself."""
    out, held, family = {}, None, -1
    for line in sorted(lines, reverse=True):
        if held is None or not line.startswith(held):
            held, family = re.match("(?s:..)[A-Z]*", line)[0], family + 1
        out[line] = family
    return out


def test_family_motifs(spark):
    rows = spark.createDataFrame([(1, "ABCD1"), (2, "ABC1"), (3, "C1orf2"), (4, "ABCX"), (5, "ABCa")], "gene_id long, name2 string")
    plain = {r.gene_id: r.family_id for r in refgene.families(rows).collect()}
    assert plain == {3: 0, 4: 1, 1: 2, 2: 3, 5: 3}
    folded = {r.gene_id: r.family_id for r in refgene.families(rows, literal=True).collect()}
    assert folded == {3: 0, 5: 1, 4: 1, 1: 1, 2: 1}  # ABCa comes first with the motif ABC, and ABCX and ABCD begin with it


def test_family_fold_against_the_pass(spark):
    rng = random.Random(8)
    symbols = ["".join(rng.choices("AB1b", k=rng.randrange(0, 7))) for _ in range(400)] + ["", "A", "A", "AB", "é", "ÀB"]
    rows = [(i, s) for i, s in enumerate(symbols)] + [(3, "A"), (3, "AB1"), (500, None)]
    want = {}
    for line, family in fold({f"{s}\t{i}" for i, s in rows if s is not None}).items():
        i = int(line.split("\t")[1])
        want[i] = min(want.get(i, family), family)
    got = {r.gene_id: r.family_id for r in refgene.families(spark.createDataFrame(rows, "gene_id long, name2 string"), literal=True).collect()}
    assert got == want
    assert refgene.families(spark.createDataFrame([], "gene_id long, name2 string"), literal=True).count() == 0


def write_case(tmp_path):
    """Eight read pairs between two genes, one of them on an unlisted contig's neighbour, and noise."""
    head = ["@HD\tVN:1.0", "@SQ\tSN:1\tLN:99999", "@SQ\tSN:2\tLN:99999"]
    rec = lambda n, c, p, q, mc, mp: f"r{n}\t0\t{c}\t{p}\t{q}\t10M\t{mc}\t{mp}\t0\tACGT\t*"
    body = []
    for i in range(8):
        body += [rec(i, "1", 1100 + i * 3, 30, "2", 5100 + i * 3), rec(i, "2", 5100 + i * 3, 30, "1", 1100 + i * 3)]
    body += [rec(90, "1", 1100, 0, "2", 5100), rec(91, "*", 0, 30, "*", 0), rec(92, "1", 1200, 30, "=", 1300), "short\tline"]
    (tmp_path / "in.sam").write_text("\n".join(head + body) + "\n")
    tx = lambda name, chrom, a, b, sym, frames: f"0\t{name}\t{chrom}\t+\t{a}\t{b}\t{a}\t{b}\t1\t{a},\t{b},\t0\t{sym}\tc\tc\t{frames},"
    (tmp_path / "ref.txt").write_text("\n".join([tx("NM_001", "chr1", 1000, 2000, "AAA1", 0), tx("NM_002", "chr2", 5000, 6000, "BBB1", 1), tx("NR_003", "chr1", 900, 2000, "CCC1", 0), tx("NM_004", "chrUn", 1, 2, "DDD1", 0)]) + "\n")
    (tmp_path / "names.txt").write_text("chr1=1\nchr2=2\n")
    return head


def test_sam_job_end_to_end(spark, tmp_path):
    from junctura.__main__ import write_result

    head = write_case(tmp_path)
    cfg = FusionConfig()
    header, chrs, reads = sam.read_sam(spark, str(tmp_path / "in.sam"), cfg)
    assert [r.value for r in header.orderBy("line_no").collect()] == head
    genes, exons, families = refgene.build_reference(refgene.read_refgene(spark, str(tmp_path / "ref.txt")), refgene.read_chromosome_map(spark, str(tmp_path / "names.txt")), chrs)
    assert {(r.chr, r.gene_id) for r in genes.collect()} == {(0, 1), (1, 2)}
    size = sum(len(x) + 1 for x in head)
    result = detect.detect(sam.mapped(reads), genes, families, exons, chrs, sam.PLACE, size, cfg)
    assert "raw" not in result.reads.columns
    write_result(result, header, str(tmp_path / "out"), detect.supporting_lines(result, str(tmp_path / "in.sam")))
    line = "".join(p.read_text() for p in sorted((tmp_path / "out/cluster_list.cl").glob("part-*"))).splitlines()
    text = "".join(p.read_text() for p in sorted((tmp_path / "out/reads.sam").glob("part-*")))
    assert len(line) == 1
    cells = line[0].split("\t")
    assert cells[:5] == ["2", "1", "BBB1(2)", "AAA1(1)", "16"]
    assert cells[7:] == ["1121", "5100", "0"]
    part = text[int(cells[5]) : int(cells[5]) + int(cells[6])]
    assert text.startswith("\n".join(head)) and len(part.splitlines()) == 16 and part.endswith("\n") and int(cells[5]) + int(cells[6]) == len(text)
    listed = [r.split("\t") for p in (tmp_path / "out/reads.index").glob("part-*") for r in p.read_text().splitlines()]
    at = 0
    for name, first, size in listed:
        assert int(first) == at and (tmp_path / "out/reads.sam" / name).stat().st_size == int(size)
        at += int(size)
    assert at == len(text)


def test_clusters_are_read_through_the_index_of_many_parts(spark, tmp_path):
    from junctura.sources import indexed

    rng = random.Random(6)
    lines = [(c, i, f"cluster {c} line {i} " + "x" * rng.randrange(40)) for c in range(1, 30) for i in range(rng.randrange(1, 30))]
    out = str(tmp_path / "reads.sam")
    spark.createDataFrame(lines, "c int, i int, value string").repartitionByRange(7, "c", "i").sortWithinPartitions("c", "i").select("value").write.text(out)
    assert len(indexed.parts(out)) >= 7
    rows, want, at = [], {}, 0
    for c in range(1, 30):
        want[c] = "".join(f"{v}\n" for k, _, v in lines if k == c)
        rows.append((c, at, len(want[c])))
        at += len(want[c])
    got = {}
    for r in sorted(indexed.cluster_bytes(spark.createDataFrame(rows, "cluster_rank long, offset_start long, offset_length long"), out).collect()):
        got[r.cluster_rank] = got.get(r.cluster_rank, "") + r.value
    assert got == want


def test_job_from_the_command_line(spark, tmp_path):
    """A reference built, saved and read again gives the same report; counters agree with the rows; the log grows."""
    import json

    from junctura.__main__ import main

    write_case(tmp_path)
    at = lambda name: str(tmp_path / name)
    common = ["--sam", at("in.sam"), "--log", at("log")]
    main([*common, "--refgene", at("ref.txt"), "--chr-names", at("names.txt"), "--save-reference", at("prepared"), "--out", at("a")])
    main([*common, "--reference-dir", at("prepared"), "--out", at("b")])
    text = lambda name: [p.read_text() for p in sorted((tmp_path / name).glob("part-*"))]
    assert text("a/cluster_list.cl") == text("b/cluster_list.cl") and text("a/reads.sam") == text("b/reads.sam")
    main([*common, "--reference-dir", at("prepared"), "--out", at("d"), "--text-reader"])
    lines = lambda name: sorted("".join(text(name)).splitlines())
    assert text("a/cluster_list.cl") == text("d/cluster_list.cl") and lines("a/reads.sam") == lines("d/reads.sam")
    log = [r.split("\t") for r in (tmp_path / "log").read_text().splitlines()]
    assert [r[1] for r in log] == ["scan", "reference", "detect", "write", "total"] * 3
    found = json.loads(log[4][3])
    assert found == json.loads(log[9][3]) == json.loads(log[14][3])
    assert found["reads_by_chr"] == {"1": 10, "2": 8, "unmapped": 1} and found["mapped_by_chr"] == {"1": 9, "2": 8} and found["clusters"] == 1
    assert (found["gene_hits"], found["gene_misses"], found["mate_hits"], found["discordant"], found["duplicates_removed"], found["supporting_reads"]) == (17, 0, 17, 16, 0, 16)
    with pytest.raises(SystemExit):
        main([*common, "--out", at("c")])


def test_single_end_has_no_clusters(spark, tmp_path):
    write_case(tmp_path)
    cfg = FusionConfig(paired=False, min_mapq=5)
    _, _, reads = sam.read_sam(spark, str(tmp_path / "in.sam"), cfg)
    assert reads.filter("mchr is not null or mcoord is not null").count() == 0
    genes = spark.createDataFrame([(0, 1000, 2000, 1)], GENES)
    assert detect.candidates(sam.mapped(reads, 5), genes, cfg).count() == 0
    assert sam.mapped(reads, 30).count() == 0 and sam.mapped(reads, 29).filter(F.col("chr").isNull()).count() == 0


def test_ranges_rank_and_sum(spark):
    from junctura.operators.order import running

    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randrange(40), rng.choice([None, 1, 5])) for _ in range(300)] + [(None, 3, 2)]
    out = running(spark.createDataFrame(rows, "k string, x int, w int"), ["x"], "rank", {"w": "before"}, ["k"])
    for k in ("a", "b", None):
        got = sorted((r["rank"], r.x, r.w, r.before) for r in out.collect() if r.k == k)
        assert [r[0] for r in got] == list(range(1, len(got) + 1)) and [r[1] for r in got] == sorted(x for j, x, _ in rows if j == k)
        assert [r[3] for r in got] == [sum(r[2] or 0 for r in got[:i]) for i in range(len(got))]
    assert running(spark.createDataFrame([], "x int"), ["x"], "rank").count() == 0


def test_components(spark):
    from junctura.tables import components

    edges = [(i, i + 1) for i in range(100, 130)] + [(5, 4), (4, 5), (7, 7), (None, 3), (129, 100)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 131)} | {4: 4, 5: 4, 7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from junctura.tables import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda name, other=None: {"spark.master": "spark://host:7077"}.get(name, other))

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_nulls_empties_and_clashing_names(spark):
    """Null positions, genes and chromosomes, no rows, and columns with the names of inner ones."""
    schema = "chr int, coord long, mchr int, mcoord long, hits string, component string, count string, n string"
    rows = [(0, 1500, 0, 5500, "h", "c", "k", "n"), (None, 1500, 0, 5500, "h", "c", "k", "n"), (0, None, 0, 5500, "h", "c", "k", "n"), (0, 1500, None, None, "h", "c", "k", "n")]
    reads = spark.createDataFrame(rows, schema)
    genes = spark.createDataFrame([(0, 1000, 2000, 1), (0, 5000, 6000, 2), (None, 0, 9999, 3), (0, None, 5, 4), (0, 1000, 2000, None)], GENES)
    found = detect.candidates(reads, genes)
    assert [(r.gene, r.mgene, r.hits, r.component, r["count"], r.n) for r in found.collect()] == [(1, 2, "h", "c", "k", "n")]
    assert detect.candidates(reads.filter("false"), genes).count() == 0 and detect.candidates(reads, genes.filter("false")).count() == 0
    held = spark.createDataFrame([(1, 2, i if i else None, 7, True, "s", "x", i) for i in range(8)], "g long, m long, coord long, mcoord long, is_mate boolean, component string, _x string, id int").drop("_x")
    assert sorted(r.id for r in cover.greedy_cover(held, 5).collect()) == list(range(8))
    assert sorted(r.id for r in cover.greedy_cover(held, 5, task_reads=0).collect()) == list(range(8))
    assert cover.greedy_cover(held.filter("false"), 5).count() == 0
    assert sorted(r.id for r in proximity.l1_neighbours(held, ["g", "m"], "coord", "mcoord", 1).collect()) == list(range(1, 8))
    assert proximity.l1_neighbours(held.filter("false"), ["g", "m"], "coord", "mcoord", 1).count() == 0
    again = held.union(held).withColumn("mcoord", F.when(F.col("coord") < 4, 0).otherwise(F.col("mcoord")))
    kept = clusters.dedup_reads(again, ["id"])
    assert kept.columns == held.columns and kept.filter("mcoord = 0").count() == 6 and kept.filter("coord >= 4 or coord is null").count() == 5
    assert clusters.dedup_reads(again.filter("false"), ["id"]).count() == 0


def test_header_is_read_from_the_head_of_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sam, "HEAD_ROWS", 2)
    head = ["@HD", *[f"@SQ\tSN:c{i}\tLN:5" for i in range(30)]]
    (tmp_path / "a.sam").write_text("\n".join([*head, "r1\t0\tc1", "@late"]))
    assert [(r.line_no, r.value) for r in sam.header_lines(spark, str(tmp_path / "a.sam")).collect()] == list(enumerate(head, 1))
    (tmp_path / "b.sam").write_text("\n".join(head))
    assert sam.header_lines(spark, str(tmp_path / "b.sam")).count() == 31
    (tmp_path / "c.sam").write_text("")
    assert sam.header_lines(spark, str(tmp_path / "c.sam")).count() == 0


def test_fetched_lines_equal_the_text(spark, tmp_path):
    write_case(tmp_path)
    path = str(tmp_path / "in.sam")
    text = (tmp_path / "in.sam").read_text()
    header, chrs, reads = sam.read_sam(spark, path)
    genes, exons, families = refgene.build_reference(refgene.read_refgene(spark, str(tmp_path / "ref.txt")), refgene.read_chromosome_map(spark, str(tmp_path / "names.txt")), chrs)
    found = detect.supporting_lines(detect.detect(sam.mapped(reads), genes, families, exons, chrs, sam.PLACE), path).collect()
    assert len(found) == 16 and all(text[r.position : r.position + r.line_len] == r.value + "\n" for r in found)


@pytest.mark.parametrize("size", [1, 7, 50, 1 << 20])
def test_places_do_not_depend_on_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    folder = tmp_path / "d"
    (folder / "sub").mkdir(parents=True)
    want = []
    for k, name in enumerate(["a.sam", "b.sam", "c.sam", "sub/d.sam"]):
        lines = ["".join(rng.choices("ab\té", k=rng.randrange(9))) for _ in range(rng.randrange(15))] if k != 1 else []
        data = "\n".join(lines).encode() + (b"\n" if k == 2 and lines else b"")
        (folder / name).write_bytes(data)
        at = 0
        for line in (data[:-1] if data.endswith(b"\n") else data).split(b"\n") if data else []:
            want.append((k, at, len(line) + 1, line.decode()))
            at += len(line) + 1
    (folder / "_SUCCESS").write_text("no line")
    lines = sam_bytes.read(spark, str(folder), size)
    assert sorted(map(tuple, lines.collect())) == want
    some = lines.drop("value").filter("position % 3 <> 1").withColumn("x", F.lit("kept"))
    got = sorted((r.file, r.position, r.line_len, r.value) for r in sam_bytes.fetch(some, str(folder)).collect())
    assert got == [w for w in want if w[1] % 3 != 1]


def test_long_lines_and_no_files(spark, tmp_path):
    (tmp_path / "x").write_text("a" * 100_000 + "\n" + "b" * 50_000)
    assert [(r.position, r.line_len) for r in sam_bytes.read(spark, str(tmp_path / "x"), 1000).collect()] == [(0, 100_001), (100_001, 50_001)]
    (tmp_path / "none").mkdir()
    assert sam_bytes.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="absent"):
        sam_bytes.read(spark, str(tmp_path / "absent")).count()


def test_prepared_folders(spark, tmp_path):
    """Both kinds of exon rows, odd names, bad rows, and what is written is read again."""
    from junctura.sources import prepared

    chrs = spark.createDataFrame([(0, "1"), (1, "HLA*01:01 x+y"), (2, "empty")], "chr int, chr_name string")
    genes = spark.createDataFrame([(0, 5, 9, 11), (0, 2, 9, 12), (1, 1, 2, 13), (0, 7, 7, 11)], GENES)
    exons = spark.createDataFrame([(11, "A", 2, [5, 7], [6, 9], [0, -1]), (13, None, 1, [1], [2], [2])], "gene_id long, gene_name string, exon_count int, starts array<long>, ends array<long>, frames array<int>")
    families = spark.createDataFrame([(12, 0), (11, 1)], "gene_id long, family_id long")
    at = str(tmp_path / "ref")
    prepared.write_reference(genes, exons, families, chrs, at)
    assert (tmp_path / "ref/1.gtf").read_text() == "2\t9\t12\n5\t9\t11\n7\t7\t11\n"
    assert (tmp_path / "ref/1_exon.gtf").read_text() == "11\tA\t2\t5,7,\t6,9,\t0,-1,\n"
    assert (tmp_path / "ref/family_gene.txt").read_text() == "11\t1\n12\t0\n"
    back = prepared.read_reference(spark, at, chrs)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(back[0]) == rows(genes) and rows(back[2]) == rows(families)
    assert rows(back[1]) == rows(exons.withColumn("gene_name", F.coalesce("gene_name", F.lit(""))))
    (tmp_path / "ref/1.gtf").write_text("9\t5\t1\nx\t5\t2\n1\t5\n3\t4\t5\n")
    (tmp_path / "ref/unknown.gtf").write_text("1\t5\t1\n")
    (tmp_path / "ref/1_exon.gtf").write_text("7\t2\t1,5,\t2,6,\t0,1,\n7\t2\t1,5,\t2,6,\t0,1,\nbad\n8\tB\t1\t3,\t4,\t2,\n")
    (tmp_path / "ref/empty.gtf").write_text("")
    genes, exons, _ = prepared.read_reference(spark, at, chrs)
    assert sorted(map(tuple, genes.collect())) == [(0, 3, 4, 5), (1, 1, 2, 13)]
    assert {r.gene_id: (r.gene_name, r.exon_count, r.starts, r.ends, r.frames) for r in exons.collect()} == {7: (None, 2, [1, 5], [2, 6], [0, 1]), 8: ("B", 1, [3], [4], [2]), 13: ("", 1, [1], [2], [2])}


def test_counters_agree_with_queries(spark):
    from junctura.plans import queries as q
    from junctura.plans.counters import Counters
    from junctura.sources import fixture as fx

    d = "/root/testdata/sf0.001"
    counters = Counters(5)
    reads = counters.by_chr(fx.reads(spark, d).withColumn("chr", F.when(F.col("chr") < fx.UNMAPPED, F.col("chr"))), "reads")
    detect.distinct_reads(sam.mapped(reads), fx.genes(spark, d), fx.families(spark, d), fx.ORDER, counters=counters)
    v = counters.values()
    assert v["reads"] == {None if r.chr == fx.UNMAPPED else r.chr: r.n for r in q.chr_counts(spark, d).collect()}
    hits = {r.chr: (r.hits, r.misses) for r in q.gene_hit_miss(spark, d).collect()}
    assert {c: (v["gene_hits"].get(c, 0), n - v["gene_hits"].get(c, 0)) for c, n in v["mapped"].items()} == hits
    assert v["discordant"] == q.discordant_reads(spark, d).count() and v["distinct"] == q.kept(spark, d).count()


def test_counters_of_many_chromosomes(spark, monkeypatch):
    from junctura.plans import counters as c

    monkeypatch.setattr(c, "BLOCK", 5)
    found = c.Counters(23)
    found.by_chr(spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 23).cast("int").alias("chr")), "x").write.format("noop").mode("overwrite").save()
    want = {}
    for i in range(1000):
        key = i % 23 if i % 3 else None
        want[key] = want.get(key, 0) + 1
    assert found.values() == {"x": want}


def test_literal_frames_go_by_the_first_read(spark):
    exons = spark.createDataFrame([(1, "A", 1, [100], [200], [0]), (2, "B", 1, [500], [600], [1]), (3, "C", 1, [100], [900], [2])], "gene_id long, gene_name string, exon_count int, starts array<long>, ends array<long>, frames array<int>")
    rows = spark.createDataFrame([(1, 2, 1, 2, 150, 550, 1), (1, 2, 2, 1, 150, 550, 2), (1, 9, 9, 1, 150, 550, 3)], "g long, m long, gene long, mgene long, coord long, mcoord long, o int")
    framed = lambda cfg: sorted((r.o, r.frame, r.mframe, r.gene_name, r.mgene_name) for r in report.with_frames(rows, exons, cfg, ["o"]).collect())
    assert framed(FusionConfig(compat="literal")) == [(1, 0, 1, "A", "B"), (2, 0, 1, "A", "B"), (3, -2, -2, None, "A")]
    assert framed(FusionConfig()) == [(1, 0, 1, "A", "B"), (2, -2, -2, "B", "A"), (3, -2, -2, None, "A")]
