"""L1 neighbours: reads of one cluster and direction that lie close to another one.

The L1 distance of (x, y) is the larger difference of (x + y, x - y). In these turned coordinates positions are put into
square cells of radius + 1: two reads in one cell are neighbours at once, and only reads alone in their cell look at the eight
cells around. No pair is made within a cell, and a cell is looked at by eight lone reads at most, so work grows with the number of
reads however dense a cluster is.

Reads are shuffled once, by keys and tiles of TILE x TILE cells. A read within the radius of a tile's border goes to the
tiles beyond it too, to be looked at there; a task sorts its tiles and takes them one after another. So a large cluster is many
tasks, and what a task holds is a run of small tiles or one large one, whose distinct positions its area bounds.

Repeated rows are each other's neighbours. Rows with a null key or position have none and go; no rows give no rows.
Other columns are kept, whatever their names (but those that begin with ``_``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Cells along the side of a tile, two at least: then no place is near more than two tiles each way.
TILE = 16
#: Rows of whole tiles that a task takes at once.
RUN = 1 << 17


def _begins(rows: pa.Table, by: list[str]) -> np.ndarray:
    """Whether each row differs from the one before in one of the columns ``by``, which hold no nulls."""
    new = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        new[1:] = reduce(np.logical_or, [pc.not_equal(c.slice(1), c.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False) for c in (rows.column(k).combine_chunks() for k in by)])
    return new


def near(number: np.ndarray, x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, radius: int, tile: int) -> np.ndarray:
    """Whether each row is at home in its tile, and another row of the tile is within ``radius``. Tiles have a number and a place (tx, ty)."""
    side, wide = radius + 1, tile + 4
    u, v = x + y, x - y
    cx, cy = u // side - tx * tile, v // side - ty * tile
    home = (cx >= 0) & (cx < tile) & (cy >= 0) & (cy < tile)
    code = (number * wide + cx + 2) * wide + cy + 2
    by = np.argsort(code, kind="stable")
    cells, first, count = np.unique(code[by], return_index=True, return_counts=True)
    alone = by[first[(count == 1)]]
    found = home.copy()
    found[alone] = False
    lone = alone[home[alone]]
    for step in (i * wide + j for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j):
        looked = code[lone] + step
        at = np.minimum(np.searchsorted(cells, looked), len(cells) - 1)
        there = cells[at] == looked
        who, at = lone[there], at[there]
        # every read of the cell beside: a cell has one lone neighbour in this direction, so no more pairs than rows
        n = count[at]
        who = np.repeat(who, n)
        other = by[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(len(who))]
        found[who[np.maximum(np.abs(u[who] - u[other]), np.abs(v[who] - v[other])) <= radius]] = True
    return found


def l1_neighbours(reads: DataFrame, keys: list[str], x: str, y: str, radius: int, tile: int = TILE, run_rows: int = RUN) -> DataFrame:
    """Rows of ``reads`` with another row of the same ``keys`` at L1 distance of at most ``radius``. ``reads`` is read once."""
    tiled = [*keys, "_tx", "_ty"]
    u, v = F.col(x).cast("long") + F.col(y).cast("long"), F.col(x).cast("long") - F.col(y).cast("long")
    size = F.lit((radius + 1) * tile).cast("long")
    place = lambda at: F.call_function("div", at - F.pmod(at, size), size)

    def tiles(at: Column) -> Column:
        return F.array_distinct(F.array(place(at - radius), place(at + radius)))

    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in dict.fromkeys([*keys, x, y])])
    dealt = reads.filter(known).withColumn("_tx", F.explode(tiles(u))).withColumn("_ty", F.explode(tiles(v))).repartition(*tiled).sortWithinPartitions(*tiled)
    schema, columns = to_arrow_schema(reads.schema), reads.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
            numbers = [rows.column(c).cast(pa.int64()).to_numpy() for c in (x, y, "_tx", "_ty")]
            kept = rows.select(columns).filter(pa.array(near(np.cumsum(new), *numbers, radius, tile)))
            yield from kept.cast(schema).to_batches()

        held: list[pa.RecordBatch] = []
        rows_held, due = 0, run_rows
        for batch in batches:
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held < due:
                continue
            rows = pa.Table.from_batches(held)
            new = _begins(rows, tiled)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from close(rows.slice(0, last), new[:last])
            held, rows_held = rows.slice(last).to_batches(), rows.num_rows - last
            due = max(run_rows, 2 * rows_held)  # a tile larger than a run is looked at again when it has doubled
        if rows_held:
            rows = pa.Table.from_batches(held)
            yield from close(rows, _begins(rows, tiled))

    return dealt.mapInArrow(run, reads.schema)
