"""Near-duplicate documents by min-max hashing.

Each hash function over a document's word shingles gives two signature values, its minimum and its maximum, so
that a signature of 2k values costs k hash evaluations per shingle; both values agree with probability J, and
bands take values of distinct functions. Documents that share a band are compared on their full sets.

How skew and size are met:

* documents with equal sets are one class from the start (aggregated before anything is compared);
* in each band's bucket all members are compared with one leader, the one with most company over all bands;
  links are joined into components. Documents of buckets that then still hold several components meet once more
  by their rarest shingles, an exact rule, and only there blocks are compared with blocks. Pairs of one
  component can add nothing to the result, so no link is lost;
* sets of too different sizes cannot reach the threshold and are passed over before texts are fetched;
* joins on hot keys are plain shuffled joins, which adaptive execution splits, or salted; nothing gathers a bucket.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import blocks, documents, map_batches, texts_of
from junctura.llm.words import U64, mix, shingle_sets, splitmix
from junctura.tables import components, cut

#: A pair at 85 % shares a band of 6 values with p = 0.377; 24 bands miss it with p = 1e-5.
BANDS, ROWS = 24, 6
PERCENT, SHINGLE = 85, 5
#: The pipeline's stage: near-duplicates are documents with a similarity of 0.8; 24 bands of 5 miss such a pair with p = 7e-5.
STAGE_PERCENT, STAGE_ROWS = 80, 5
BLOCK_BYTES = 1 << 20
#: Documents in a block of those that share a rare shingle, and shingles of all its documents: about so many, or one document.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Parts that a hot group is dealt to where its rows meet a fact about the group.
SALTS = 64


def minmax_bands(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(document, band) keys. Function j gives value j (its minimum) and value j + k (its maximum); a band takes values of distinct functions."""
    k = bands * rows // 2
    scale, shift = splitmix(k, 101) | U64(1), splitmix(k, 202)
    out = np.zeros((len(sets), bands), U64)
    weight, salt = splitmix(rows, 303) | U64(1), splitmix(bands, 404)
    for i, s in enumerate(sets):
        if not len(s):
            continue
        low, high = np.full(k, U64(0xFFFFFFFFFFFFFFFF)), np.zeros(k, U64)
        for at in range(0, len(s), 4096):
            hashed = s[None, at : at + 4096] * scale[:, None]
            hashed += shift[:, None]
            np.minimum(low, hashed.min(axis=1), out=low)
            np.maximum(high, hashed.max(axis=1), out=high)
        values = np.concatenate([low, high]).reshape(bands, rows)
        out[i] = mix((values * weight).sum(axis=1, dtype=U64) ^ salt)
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, set_key, bands): set_key is a 128-bit digest of the full set, null for an empty one."""

    def make(batch: pa.RecordBatch) -> dict:
        sizes, keys, bands = [], [], []
        for _, part in blocks(texts_of(batch.column(1)), BLOCK_BYTES):
            sets = shingle_sets(part, SHINGLE)
            sizes += [len(s) for s in sets]
            keys += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands.append(minmax_bands(sets, rows=rows).view(np.int64))
        flat = np.concatenate(bands).reshape(-1)
        offsets = pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32))
        return {"id": batch.column(0), "n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.binary()), "bands": pa.ListArray.from_arrays(offsets, pa.array(flat))}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id", "text"], make, "id long, n_shingles long, set_key binary, bands array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those (a, b) of ``pairs`` whose full sets reach ``percent``; texts: (id, text), one row for each id."""
    need = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # ``need`` grows with the data: a broadcast that happens to fit a small input would not at size
    held = cut(texts.join(need.hint("merge"), "id", "left_semi"), "texts")
    full = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def make(batch: pa.RecordBatch) -> dict:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ta, tb = batch.column(2), batch.column(3)
        keep, at = [], 0
        for first, part in blocks((x.as_py().encode() for pair in zip(ta, tb, strict=True) for x in pair), BLOCK_BYTES):
            for s in shingle_sets(part, SHINGLE):
                if at % 2 == 0:
                    left = s
                else:
                    both = len(np.intersect1d(left, s, assume_unique=True))
                    keep.append(100 * both >= percent * (len(left) + len(s) - both))
                at += 1
        return {"a": [x for x, k in zip(a, keep, strict=True) if k], "b": [x for x, k in zip(b, keep, strict=True) if k]}

    return map_batches(full, ["a", "b", "ta", "tb"], make, "a long, b long")


def shingled(texts: DataFrame) -> DataFrame:
    """(id, text_key, shingles): the full set of each text; an id may have several texts."""

    def make(batch: pa.RecordBatch) -> dict:
        sets = [s for _, part in blocks(texts_of(batch.column(2)), BLOCK_BYTES) for s in shingle_sets(part, SHINGLE)]
        offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
        flat = np.concatenate([np.zeros(0, U64), *sets]).view(np.int64)
        return {"id": batch.column(0), "text_key": batch.column(1), "shingles": pa.ListArray.from_arrays(offsets, pa.array(flat))}

    return map_batches(texts.select("id", F.xxhash64("text").alias("text_key"), "text"), ["id", "text_key", "text"], make, "id long, text_key long, shingles array<bigint>")


def cell_links(percent: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the two sides of a cell, as a forest: enough to join what they join, one row a document at most.

    Intersections of all its pairs are one product of two 0/1 matrices over the shingles that both sides have.
    """
    rows = rows.sort_values("id", ignore_index=True)
    ids, roots = rows["id"].tolist(), rows["root"].tolist()
    diagonal = rows["i"].iloc[0] == rows["j"].iloc[0]
    side = rows["block"].to_numpy() == rows["i"].iloc[0]
    left, right = np.flatnonzero(side), np.flatnonzero(side if diagonal else ~side)
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []})
    sets = [s for _, part in blocks((t.encode() for t in rows["text"]), BLOCK_BYTES) for s in shingle_sets(part, SHINGLE)]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    use = np.zeros(len(value), bool)
    use[column[np.isin(owner, left)]] = True
    other = np.zeros(len(value), bool)
    other[column[np.isin(owner, right)]] = True
    if diagonal:
        other = np.bincount(column, minlength=len(value)) > 1
    rank = np.cumsum(use & other) - 1
    shared = (use & other)[column]
    owner, column = owner[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        marks = np.zeros((len(sets), 4096), np.float32)
        marks[owner[lo:hi], column[lo:hi] - at] = 1
        both[np.ix_(left, right)] += marks[left] @ marks[right].T
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    parent = {r: r for r in roots}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    out = []
    for x, y in zip(*np.nonzero(linked[np.ix_(left, right)]), strict=True):
        x, y = int(left[x]), int(right[y])
        p, q = top(roots[x]), top(roots[y])
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((ids[x], ids[y]))
    return pd.DataFrame(out, columns=["a", "b"])


def with_group_fact(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """``rows`` (group, id, ...) joined to ``facts`` (one row a group): a hot group's rows are dealt to SALTS parts by id."""
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["group", "_salt"], how).drop("_salt")


def open_links(members: DataFrame, roots: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between documents that share a bucket but not a component.

    Such open documents are brought together anew by rare shingles. A document of n shingles shares at least
    need = ceil(percent * n / 100) of them with each partner, hence one of its n - need + 1 rarest (in one order
    for all documents); shingles that no other open document has come first and are never looked up. Documents that merely share
    a passage so drop out before any comparison. Of rare shingles with the same documents one is kept; two
    documents are a pair, more are dealt to blocks by their number and their shingles, and each pair of blocks is a cell that one task compares exactly.
    """
    placed = members.filter("m > 2").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = placed.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    left = cut(placed.join(mixed.select("band", "key"), ["band", "key"], "left_semi").select("id", "root").distinct(), "open")
    if left.isEmpty():
        return left.select(F.col("id").alias("a"), F.col("root").alias("b"))
    sets = cut(shingled(texts.join(left.hint("merge"), "id", "left_semi")), "sets")
    each = sets.select("id", "text_key", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("docs")).filter("docs > 1")
    held = each.join(shared.hint("merge"), "shingle").groupBy("id", "text_key", "n").agg(F.sort_array(F.collect_list(F.struct("docs", "shingle"))).alias("shared"))
    rare = held.withColumn("take", F.expr(f"size(shared) - (n * {percent}L + 99) div 100 + 1")).filter("take > 0")
    rare = rare.select("id", "n", F.explode(F.slice("shared", F.lit(1), F.col("take").cast("int"))).alias("s")).select("id", F.col("n").cast("long").alias("n"), F.col("s.shingle").alias("group"))
    rare = cut(rare.groupBy("id", "group").agg(F.sum("n").alias("shingles")).join(left, "id"), "rare")
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    kinds = rare.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("size"), F.sum("shingles").alias("shingles"), *marks)
    kinds = cut(kinds.filter("lo < hi").groupBy("size", "mark0", "mark1").agg(F.min("group").alias("group"), F.first("a").alias("a"), F.first("b").alias("b"), F.max("shingles").alias("shingles")), "kinds")
    pairs = confirm(cut(kinds.filter("size = 2").select("a", "b"), "pairs"), texts, percent)
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.col("size"), F.ceil(F.col("shingles") / BLOCK_SHINGLES)))
    count = kinds.filter("size > 2").select("group", parts.cast("int").alias("n"))
    block = with_group_fact(rare, count, "inner").withColumn("block", F.pmod(F.xxhash64("id"), "n").cast("int"))
    cells = block.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    full = cells.select("group", "i", "j", "block", "id", "root").hint("merge").join(texts, "id")
    found = full.groupBy("group", "i", "j").applyInPandas(functools.partial(cell_links, percent), "a long, b long")
    return cut(pairs.union(found), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of ``docs``.

    Null or wordless texts have no shingles and stay alone; rows without an id stay alone, with a null
    component, and are kept; rows that repeat an id count as one document of that id. No rows give no rows; other
    columns are ignored.
    """
    sketch = cut(sketches(docs, id_col, text_col, rows), "sketches")
    sets = sketch.filter("set_key is not null and id is not null")
    classes = cut(sets.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = sets.join(classes, (sets.set_key == classes.set_key) & (sets.id == classes.rep), "left_semi").dropDuplicates(["set_key"])
    banded = reps.select("id", "n_shingles", "set_key", F.posexplode("bands").alias("band", "key"))
    # one id may stand for several texts (repeated ids): the class, not the id, is compared
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1")
    members = cut(banded.join(shared, ["band", "key"]).select("band", "key", "id", F.col("n_shingles").alias("n"), "m"), "members")
    company = members.groupBy("id").agg(F.sum("m").alias("company"))
    ranked = cut(members.join(company, "id"), "ranked")
    leaders = ranked.groupBy("band", "key").agg(F.max(F.struct("company", (-F.col("id")).alias("neg"), "n")).alias("top"))
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    star = ranked.join(leaders.select("band", "key", (-F.col("top.neg")).alias("lead"), F.col("top.n").alias("lead_n")), ["band", "key"])
    star = star.filter((F.col("id") != F.col("lead")) & alike(F.col("n"), F.col("lead_n")))
    tested = cut(star.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(), "pairs")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    links = cut(confirm(tested, texts, percent), "links")
    roots = components(links)
    more = open_links(members, roots, texts, percent)
    if not more.isEmpty():
        roots = components(links.union(more))
    named = classes.join(roots, classes.rep == roots.id, "left").select("set_key", F.coalesce("root", "rep").alias("root"))
    found = sketch.join(named, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return found.select("id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of every component, over links of STAGE_PERCENT, the document with the smallest id.

    Rows without an id stay, as do those without words; rows that repeat an id stay or go together.
    """
    gone = near_duplicates(docs, percent=STAGE_PERCENT, rows=STAGE_ROWS).filter("not kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS h FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), g AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (
  WITH RECURSIVE reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.x, g.y FROM reach JOIN g ON reach.y = g.x)
  SELECT x, min(y) AS c FROM reach GROUP BY x
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept FROM s JOIN r ON s.doc_id = r.x
"""
