"""The queries as DuckDB SQL over the same tables. Each is the common steps below and one SELECT."""

from __future__ import annotations

RID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, seg"
SOURCE = r"""
WITH RECURSIVE fx_genes AS (
  SELECT CAST(p_partkey + 1 AS BIGINT) AS gene_id, concat(p_type, '_', CAST(p_partkey AS VARCHAR)) AS gene_name, CAST(p_partkey % 5 AS INT) AS chr,
    CAST(1000 + (p_partkey - p_partkey % 5) * 140 AS BIGINT) AS tx_start, CAST(1000 + (p_partkey - p_partkey % 5) * 140 + 600 + p_size * 4 AS BIGINT) AS tx_end
  FROM part
), fx_families AS (
  SELECT gene_id, CAST(dense_rank() OVER (ORDER BY regexp_extract(gene_name, '^(..[A-Z]*)', 1) DESC) - 1 AS BIGINT) AS family_id FROM fx_genes
), fx_exons AS (
  SELECT CAST(p_partkey + 1 AS BIGINT) AS gene_id, CAST(k AS INT) AS k, CAST(1000 + (p_partkey - p_partkey % 5) * 140 + k * 150 AS BIGINT) AS e_start,
    CAST(1000 + (p_partkey - p_partkey % 5) * 140 + k * 150 + 100 + p_size % 20 AS BIGINT) AS e_end,
    CAST(CASE WHEN (p_partkey + k) % 7 = 0 THEN -1 ELSE (p_size + k) % 3 END AS INT) AS frame
  FROM part, range(4) r(k)
), fx_ends AS (
  SELECT *, l_partkey AS a, l_partkey - l_partkey % 40 + (l_partkey % 40 + 1 + (l_suppkey * 7 + l_linenumber) % 4 * 9) % 40 AS b FROM lineitem
), fx_frag AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS INT) % 10 AS INT) AS mapq,
    CAST(CASE WHEN l_orderkey % 97 = 0 THEN 5 ELSE a % 5 END AS INT) AS chr_a,
    CAST(940 + (a - a % 5) * 140 + (l_orderkey * 37 + l_linenumber * 11) % 720 AS BIGINT) AS pos_a,
    CAST(b % 5 AS INT) AS chr_b,
    CAST(940 + (b - b % 5) * 140 + (l_orderkey * 53 + l_linenumber * 29) % 720 AS BIGINT) AS pos_b
  FROM fx_ends
), fx_records AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 AS seg, l_linenumber AS src, mapq, chr_a AS chr, pos_a AS coord, chr_b AS mchr, pos_b AS mcoord FROM fx_frag
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 2, l_linenumber, mapq, chr_b, pos_b, chr_a, pos_a FROM fx_frag
)"""
#: The records as the lines of SAM files, with their places; fx_reads are those that can be parsed.
SAM = SOURCE + r""", sam_whole AS (
  SELECT r.*, CAST(l_orderkey % 16 AS INT) AS file, CASE WHEN chr = mchr THEN '=' ELSE coalesce(b.r_name, '*') END AS rnext,
    concat_ws(chr(9), 'r' || concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, seg), '0', coalesce(a.r_name, '*'), CASE WHEN l_orderkey % 101 = 0 THEN 'x' ELSE CAST(coord AS VARCHAR) END, mapq, '10M',
      CASE WHEN chr = mchr THEN '=' ELSE coalesce(b.r_name, '*') END, mcoord) AS begin
  FROM fx_records r LEFT JOIN region a ON chr = a.r_regionkey LEFT JOIN region b ON mchr = b.r_regionkey
), sam_lines AS (SELECT *, CASE WHEN l_orderkey % 103 = 0 THEN begin ELSE concat_ws(chr(9), begin, '0', 'ACGT', '*', 'NM:i:0') END AS value FROM sam_whole
), sam_head AS (SELECT strlen('@HD' || chr(9) || 'VN:1.0') + 1 + (SELECT sum(strlen('@SQ' || chr(9) || 'SN:' || r_name || chr(9) || 'LN:99999999') + 1) FROM region) AS bytes
), sam_text AS (
  SELECT *, CAST(bytes + coalesce(sum(strlen(value) + 1) OVER (PARTITION BY file ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, seg, mapq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position,
    CAST(strlen(value) + 1 AS INT) AS line_len
  FROM sam_lines, sam_head
), fx_reads AS (SELECT *, md5(value) AS line_key FROM sam_text WHERE l_orderkey % 101 <> 0 AND l_orderkey % 103 <> 0)
"""
TABLES = SOURCE + r""", fx_reads AS (SELECT *, 100 + l_linenumber AS line_len FROM fx_records)
"""
#: From reads to the clusters before the cover. @ties@ ranks equal reads.
DETECT = r""", mapped AS (SELECT * FROM fx_reads WHERE chr < 5 AND mapq > 0),
point_gene AS MATERIALIZED (
  SELECT chr, coord, gene_id AS gene FROM (
    SELECT p.chr, p.coord, gene_id, row_number() OVER (PARTITION BY p.chr, p.coord ORDER BY tx_start, CAST(gene_id AS VARCHAR)) AS k
    FROM (SELECT DISTINCT chr, coord FROM fx_reads WHERE chr < 5) p JOIN fx_genes g ON p.chr = g.chr AND p.coord + 50 >= tx_start AND p.coord <= tx_end) WHERE k = 1
), hit AS (SELECT r.*, p.gene FROM mapped r JOIN point_gene p USING (chr, coord)),
mate AS MATERIALIZED (SELECT r.*, p.gene AS mgene FROM hit r JOIN point_gene p ON r.mchr = p.chr AND r.mcoord = p.coord),
pairs AS (SELECT *, least(gene, mgene) AS g, greatest(gene, mgene) AS m, gene > mgene AS swapped, coord > mcoord AS is_mate FROM mate),
disc AS (SELECT * FROM pairs WHERE gene - mgene <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g, m, coord, mcoord ORDER BY @ties@) AS rn FROM disc),
dd AS MATERIALIZED (SELECT * FROM ranked WHERE rn = 1 OR mcoord = 0),
fam AS (SELECT dd.* FROM dd JOIN fx_families a ON g = a.gene_id JOIN fx_families b ON m = b.gene_id WHERE a.family_id <> b.family_id),
sup AS MATERIALIZED (SELECT * FROM fam WHERE (g, m) IN (SELECT (g, m) FROM fam GROUP BY g, m HAVING count(*) > 5)),
near AS MATERIALIZED (SELECT DISTINCT r.* FROM sup r JOIN sup q ON q.g = r.g AND q.m = r.m AND q.is_mate = r.is_mate
  WHERE (q.coord <> r.coord OR q.mcoord <> r.mcoord) AND abs(q.coord - r.coord) + abs(q.mcoord - r.mcoord) <= 199),
close AS MATERIALIZED (SELECT * FROM near WHERE (g, m) IN (SELECT (g, m) FROM near GROUP BY g, m HAVING count(*) > 5)),
counts AS MATERIALIZED (SELECT g, m, count(*) AS n FROM close GROUP BY g, m)
"""
#: The cover by rounds: in each, clusters that precede all their neighbours win, and others lose the reads at their places.
COVER = r""", numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY g, m, coord, mcoord, is_mate, @order@) AS id FROM close),
cover AS (
  SELECT g, m, coord, mcoord, id, false AS won FROM numbered
  UNION ALL
  SELECT g, m, coord, mcoord, id, won FROM (
    WITH live AS (SELECT g, m, coord, mcoord, id FROM cover WHERE NOT won),
    sized AS (SELECT g, m, count(*) AS n FROM live GROUP BY g, m HAVING count(*) > 5),
    gene_ends AS (SELECT g, m, n, unnest([g, m]) AS gene_id FROM sized),
    top AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY n DESC, g, m) AS k FROM gene_ends),
    win AS (SELECT g, m FROM top GROUP BY g, m HAVING max(k) = 1),
    spots AS (SELECT gene_id, unnest([coord, mcoord]) AS pos FROM (SELECT unnest([g, m]) AS gene_id, coord, mcoord FROM live SEMI JOIN win USING (g, m)))
    SELECT g, m, coord, mcoord, id, true AS won FROM live SEMI JOIN win USING (g, m)
    UNION ALL
    SELECT g, m, coord, mcoord, id, false FROM live l SEMI JOIN sized USING (g, m) ANTI JOIN win USING (g, m)
      ANTI JOIN spots a ON a.gene_id = l.g AND a.pos = l.coord ANTI JOIN spots b ON b.gene_id = l.g AND b.pos = l.mcoord
      ANTI JOIN spots c ON c.gene_id = l.m AND c.pos = l.coord ANTI JOIN spots d ON d.gene_id = l.m AND d.pos = l.mcoord
  )
), covered AS MATERIALIZED (SELECT * FROM numbered WHERE id IN (SELECT id FROM cover WHERE won))
"""
#: Report columns of the clusters of @reads@.
REPORT = r""", oriented AS (
  SELECT g, m, is_mate, line_len, @order@, CASE WHEN is_mate THEN coord ELSE mcoord END AS coord, CASE WHEN is_mate THEN mcoord ELSE coord END AS mcoord,
    CASE WHEN is_mate THEN chr ELSE mchr END AS chr, CASE WHEN is_mate THEN mchr ELSE chr END AS mchr,
    CASE WHEN is_mate THEN gene ELSE mgene END AS gene, CASE WHEN is_mate THEN mgene ELSE gene END AS mgene
  FROM @reads@
), point_frame AS (
  SELECT gene, pos, CASE WHEN e_start > pos + 50 THEN -2 ELSE frame END AS frame FROM (
    SELECT p.gene, p.pos, e_start, frame, row_number() OVER (PARTITION BY p.gene, p.pos ORDER BY k) AS kk
    FROM (SELECT gene, coord AS pos FROM oriented UNION SELECT mgene, mcoord FROM oriented) p JOIN fx_exons e ON e.gene_id = p.gene AND e.e_end > p.pos) WHERE kk = 1
), framed AS MATERIALIZED (
  SELECT o.*, CAST(coalesce(a.frame, -2) AS INT) AS frame, CAST(coalesce(b.frame, -2) AS INT) AS mframe
  FROM oriented o LEFT JOIN point_frame a ON o.gene = a.gene AND o.coord = a.pos LEFT JOIN point_frame b ON o.mgene = b.gene AND o.mcoord = b.pos
), firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, m ORDER BY coord, mcoord, @ties@) AS rn1 FROM framed) WHERE rn1 = 1
), summed AS (
  SELECT g, m, count(*) AS nbreads, CAST(sum(line_len) AS BIGINT) AS offset_length, max(least(coord, mcoord)) AS fb_start, min(greatest(coord, mcoord)) AS fb_end,
    count(*) FILTER (frame >= 0 AND mframe >= 0 AND (frame + 1) % 3 = mframe) * 100 // count(*) AS exon_match_percent
  FROM framed GROUP BY g, m
), summary AS (
  SELECT s.*, f.chr, f.mchr, f.gene, f.mgene, row_number() OVER (ORDER BY f.mgene, f.gene, s.g, s.m) AS cluster_rank,
    CAST(1000 + coalesce(sum(offset_length) OVER (ORDER BY f.mgene, f.gene, s.g, s.m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_start
  FROM summed s JOIN firsts f USING (g, m)
), listed AS (
  SELECT cluster_rank, a.r_name AS chr_a, b.r_name AS chr_b, format('{}({})', x.gene_name, gene) AS gene_a, format('{}({})', y.gene_name, mgene) AS gene_b,
    nbreads, offset_start, offset_length, fb_start, fb_end, exon_match_percent
  FROM summary s JOIN region a ON s.chr = a.r_regionkey JOIN region b ON s.mchr = b.r_regionkey JOIN fx_genes x ON x.gene_id = s.gene JOIN fx_genes y ON y.gene_id = s.mgene
)
"""
#: The first round of the cover alone.
ROUND = r""", ends AS (SELECT DISTINCT g, m, n, unnest([g, m]) AS gene_id FROM counts),
best AS (SELECT gene_id, g AS bg, m AS bm FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY n DESC, g, m) AS k FROM ends) WHERE k = 1),
winners AS MATERIALIZED (SELECT g, m, n FROM ends JOIN best USING (gene_id) GROUP BY g, m, n HAVING bool_and(bg = g AND bm = m)),
places AS (SELECT DISTINCT unnest([g, m]) AS gene_id, coord AS pos, mcoord AS mpos FROM close WHERE (g, m) IN (SELECT (g, m) FROM winners)),
taken AS MATERIALIZED (SELECT gene_id, pos FROM places UNION SELECT gene_id, mpos FROM places)
"""
#: The order-dependent family fold over @symbols@ (gene_id, symbol), line by line in descending order.
FOLD = r""", named AS (@symbols@),
ranked_lines AS MATERIALIZED (SELECT line, regexp_extract(line, '^(..[A-Z]*)', 1) AS motif, row_number() OVER (ORDER BY line DESC) AS i FROM (SELECT DISTINCT symbol || chr(9) || gene_id AS line FROM named)),
fold AS (
  SELECT i, line, motif AS held, CAST(0 AS BIGINT) AS family_id FROM ranked_lines WHERE i = 1
  UNION ALL
  SELECT r.i, r.line, CASE WHEN starts_with(r.line, held) THEN held ELSE motif END, family_id + CASE WHEN starts_with(r.line, held) THEN 0 ELSE 1 END
  FROM fold JOIN ranked_lines r ON r.i = fold.i + 1
)
SELECT gene_id, min(family_id) AS family_id FROM named JOIN fold ON fold.line = symbol || chr(9) || gene_id GROUP BY gene_id
"""

#: The first exon's frame of a gene's list, where the first exon that ends after the place begins near enough.
_LITERAL = """CAST(CASE WHEN (SELECT min_by(e_start, k) FROM fx_exons e WHERE e.gene_id = {0} AND e_end > {1}) <= {1} + 50 THEN (SELECT min_by(frame, k) FROM fx_exons e WHERE e.gene_id = {0}) ELSE -2 END AS INT)"""

_SELECTS = {
    "scan_mapped": f"SELECT {RID}, mapq, chr, coord, mchr, mcoord FROM mapped",
    "chr_counts": "SELECT chr, count(*) AS n FROM fx_reads GROUP BY chr",
    "mapq_threshold": "SELECT chr, mapq, count(*) AS n, CAST(sum(coord) AS BIGINT) AS coords FROM mapped WHERE mapq > 3 GROUP BY chr, mapq",
    "chr_lookup": "SELECT name, CAST(coalesce(r_regionkey, 5) AS INT) AS chr FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation) LEFT JOIN region ON name = r_name",
    "orientation_counts": "SELECT chr, coord > mcoord AS is_mate, count(*) AS n FROM mapped GROUP BY 1, 2",
    "gene_first_match": f"SELECT {RID}, mapq, chr, coord, gene FROM hit",
    "gene_all_matches": "SELECT gene_id AS gene, count(*) AS n, CAST(sum(coord) AS BIGINT) AS coords FROM mapped r JOIN fx_genes g ON r.chr = g.chr AND r.coord + 50 >= tx_start AND r.coord <= tx_end GROUP BY 1",
    "gene_hit_miss": "SELECT chr, count(gene) AS hits, count(*) - count(gene) AS misses FROM mapped LEFT JOIN point_gene USING (chr, coord) GROUP BY chr",
    "mate_gene": "SELECT gene, mgene, count(*) AS n, CAST(sum(mcoord) AS BIGINT) AS mcoords FROM mate GROUP BY 1, 2",
    "canonical_pairs": "SELECT g, m, swapped, is_mate, count(*) AS n FROM pairs GROUP BY ALL",
    "discordant_reads": f"SELECT {RID}, mapq, g, m, swapped, is_mate FROM disc",
    "cluster_counts": "SELECT g, m, count(*) AS n FROM disc GROUP BY 1, 2",
    "cluster_stats_by_source": """SELECT g, m, CAST(sum(c) AS BIGINT) AS nbread, max(c) AS maxnbread, CAST(first(src ORDER BY c DESC, src) AS BIGINT) AS maxsource
        FROM (SELECT g, m, src, count(*) AS c FROM dd GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "gene_families": "SELECT gene_id, regexp_extract(gene_name, '^(..[A-Z]*)', 1) AS motif, family_id FROM fx_genes JOIN fx_families USING (gene_id)",
    "same_family_clusters": "SELECT g, m, count(*) AS n, a.family_id FROM disc JOIN fx_families a ON g = a.gene_id JOIN fx_families b ON m = b.gene_id WHERE a.family_id = b.family_id GROUP BY g, m, a.family_id",
    "cross_family_clusters": "SELECT g, m, count(*) AS n FROM disc JOIN fx_families a ON g = a.gene_id JOIN fx_families b ON m = b.gene_id WHERE a.family_id <> b.family_id GROUP BY g, m",
    "dedup_reads": f"SELECT {RID}, g, m, chr, mchr, coord, mcoord FROM dd",
    "min_support": "SELECT g, m, count(*) AS n FROM fam GROUP BY g, m HAVING count(*) > 5",
    "min_support_reads": f"SELECT {RID}, g, m, coord, mcoord FROM sup",
    "proximity_reads": "SELECT g, m, is_mate, coord, mcoord FROM near",
    "proximity_tight": """SELECT DISTINCT r.g, r.m, r.is_mate, r.coord, r.mcoord FROM sup r JOIN sup q ON q.g = r.g AND q.m = r.m AND q.is_mate = r.is_mate
        WHERE (q.coord <> r.coord OR q.mcoord <> r.mcoord) AND abs(q.coord - r.coord) + abs(q.mcoord - r.mcoord) <= 20""",
    "proximity_clusters": "SELECT g, m, n FROM counts",
    "top_cluster": "SELECT g, m, n FROM counts ORDER BY n DESC, g, m LIMIT 1",
    "cover_neighbours": """SELECT c.g, c.m, c.n FROM counts c, (SELECT g AS tg, m AS tm FROM counts ORDER BY n DESC, g, m LIMIT 1)
        WHERE (c.g IN (tg, tm) OR c.m IN (tg, tm)) AND NOT (c.g = tg AND c.m = tm)""",
    "cover_round1": """SELECT g, m, n, true AS winner FROM winners UNION ALL SELECT g, m, count(*), false FROM close
        WHERE (g, m) NOT IN (SELECT (g, m) FROM winners) AND (g, coord) NOT IN (SELECT (gene_id, pos) FROM taken) AND (g, mcoord) NOT IN (SELECT (gene_id, pos) FROM taken)
        AND (m, coord) NOT IN (SELECT (gene_id, pos) FROM taken) AND (m, mcoord) NOT IN (SELECT (gene_id, pos) FROM taken) GROUP BY g, m""",
    "oriented_reads": "SELECT g, m, chr, coord, gene, mchr, mcoord, mgene FROM oriented",
    "exon_frames": "SELECT g, m, coord, mcoord, gene, mgene, frame, mframe FROM framed",
    "exon_frames_literal": f"""SELECT o.g, o.m, o.coord, o.mcoord, o.gene, o.mgene, x.gene_name, y.gene_name AS mgene_name, {_LITERAL.format('f.gene', 'o.coord')} AS frame, {_LITERAL.format('f.mgene', 'o.mcoord')} AS mframe
        FROM oriented o JOIN firsts f USING (g, m) LEFT JOIN fx_genes x ON x.gene_id = f.gene LEFT JOIN fx_genes y ON y.gene_id = f.mgene""",
    "exon_match_pct": "SELECT g, m, exon_match_percent FROM summed",
    "breakpoints": "SELECT g, m, max(least(coord, mcoord)) AS fb_start, min(greatest(coord, mcoord)) AS fb_end FROM close GROUP BY g, m",
    "breakpoints_literal": "SELECT g, m, max(CASE WHEN is_mate THEN mcoord ELSE coord END) AS fb_start, min(CASE WHEN is_mate THEN coord ELSE mcoord END) AS fb_end FROM oriented GROUP BY g, m",
    "cluster_byte_index": "SELECT cluster_rank, g, m, nbreads, offset_start, offset_length FROM summary",
    "cluster_list": "SELECT * FROM listed",
    "report_lines": "SELECT cluster_rank, format('{} - {} : {} reads // {} - {}', gene_a, gene_b, nbreads, chr_a, chr_b) AS line FROM listed",
    "gene_intervals": "SELECT chr, tx_start, tx_end, gene_id FROM fx_genes",
    "exon_table": "SELECT gene_id, gene_name, CAST(4 AS INT) AS exon_count, k, e_start, e_end, frame FROM fx_exons JOIN fx_genes USING (gene_id)",
    "cluster_rank_asc": "SELECT g, m, n, row_number() OVER (ORDER BY n, g, m) AS rank FROM counts",
    "sorted_coordinates": """SELECT chr, count(*) AS n, CAST(sum(CAST(rank AS HUGEINT) * (coord * 48271 % 2147483647)) % 2147483647 AS BIGINT) AS digest
        FROM (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY coord) AS rank FROM (SELECT DISTINCT chr, coord FROM mapped)) GROUP BY chr""",
    "fusion_report": "SELECT count(*) AS clusters, CAST(sum(nbreads) AS BIGINT) AS reads, max(nbreads) AS largest, count(*) FILTER (exon_match_percent > 10) * 100 // count(*) AS in_frame_pct FROM summary",
    "refgene_rename": "SELECT CAST(p_partkey AS BIGINT) AS gene_id, r_name AS chrom FROM part JOIN region ON p_partkey % 7 = r_regionkey WHERE p_partkey % 3 <> 0",
    "exon_arrays": "SELECT gene_id, count(*) AS exon_count, CAST(sum(e_start) AS BIGINT) AS sum_starts, max(e_end) AS last_end FROM fx_exons GROUP BY gene_id",
    "sorted_reads": f"SELECT chr, coord, mcoord, row_number() OVER (PARTITION BY chr ORDER BY coord, mcoord, {RID}, mapq) AS rank FROM mapped",
    "sorted_mates": f"SELECT chr, coord, mcoord, row_number() OVER (PARTITION BY chr ORDER BY mcoord, coord, {RID}, mapq) AS rank FROM mapped",
    "cluster_rank_desc": "SELECT g, m, n, row_number() OVER (ORDER BY n DESC, g, m) AS rank FROM counts",
}

_SAM_SELECTS = {
    "sam_positions": "SELECT file, position, line_len, md5(value) AS digest FROM sam_text",
    "sam_header": "SELECT CAST(r_regionkey AS INT) AS chr, r_name AS chr_name FROM region",
    "sam_parse": "SELECT line_len, chr, coord, mchr, mcoord, mapq, upper(line_key) AS line_key FROM fx_reads",
    "sam_single_end": """SELECT chr, mapq, count(*) AS n, CAST(sum(coord) AS BIGINT) AS coords, CAST(sum(line_len) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS mates, CAST(0 AS BIGINT) AS mate_positions
        FROM fx_reads WHERE chr < 5 AND mapq > 4 GROUP BY chr, mapq""",
    "mate_chr_resolve": "SELECT chr AS chr_a, rnext, mchr, count(*) AS n FROM fx_reads GROUP BY ALL",
}
_COVER_SELECTS = {
    "set_cover": "SELECT g, m, count(*) AS n FROM covered GROUP BY g, m",
    "set_cover_report": "SELECT * FROM listed",
}
_FIXTURE_ORDER, _SAM_ORDER = f"{RID}, mapq", "file, position"
_PART_SYMBOLS = """SELECT CAST(p_partkey AS BIGINT) AS gene_id, CASE WHEN substr(p_type, 5, 1) BETWEEN 'A' AND 'Z' THEN concat(substr(p_type, 1, 4), '1', substr(p_type, 6)) ELSE p_type END AS symbol
  FROM part JOIN region ON p_partkey % 7 = r_regionkey WHERE p_partkey % 3 <> 0"""


def _sql(parts: str, select: str, order: str, reads: str = "close") -> str:
    ties = order if order == _SAM_ORDER else f"chr, mchr, {order}"
    return f"{parts}\n{select}".replace("@order@", order).replace("@ties@", ties).replace("@reads@", reads)


ORACLES = (
    {name: _sql(TABLES + DETECT + REPORT + ROUND, select, _FIXTURE_ORDER) for name, select in _SELECTS.items()}
    | {name: _sql(SAM, select, _SAM_ORDER) for name, select in _SAM_SELECTS.items()}
    | {name: _sql(TABLES + DETECT + COVER + REPORT, select, _FIXTURE_ORDER, "covered") for name, select in _COVER_SELECTS.items()}
    | {"supporting_lines": _sql(SAM + DETECT + COVER + REPORT, "SELECT cluster_rank, f.coord, f.mcoord, file, position, t.line_len, value FROM framed f JOIN summary USING (g, m) JOIN sam_text t USING (file, position)", _SAM_ORDER, "covered")}
    | {"gene_families_literal": SOURCE + FOLD.replace("@symbols@", "SELECT gene_id, gene_name AS symbol FROM fx_genes"), "family_fold": SOURCE + FOLD.replace("@symbols@", _PART_SYMBOLS)}
)
