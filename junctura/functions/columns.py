"""Scalar expressions of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_mate(coord: Column, mcoord: Column) -> Column:
    """Whether a read is the end with the larger coordinate; equal ends are not."""
    return coord > mcoord


def l1(x: Column, y: Column, u: Column, v: Column) -> Column:
    return F.abs(x - u) + F.abs(y - v)


def in_frame(frame: Column, mate_frame: Column) -> Column:
    """Whether the mate's exon goes on in the frame in which the exon ends."""
    return (frame >= 0) & (mate_frame >= 0) & ((frame + 1) % 3 == mate_frame)


def percent(part: Column, whole: Column) -> Column:
    """Truncated integer percentage."""
    return F.floor(part * 100 / whole).cast("long")


def gene_label(name: Column, gene_id: Column) -> Column:
    return F.format_string("%s(%d)", name, gene_id)


def number_list(text: Column, kind: str = "bigint") -> Column:
    """Numbers of a comma list; empty items are passed over."""
    return F.transform(F.filter(F.split(text, ","), lambda s: s != ""), lambda s: s.cast(kind))


def family_motif(symbol: Column) -> Column:
    """The first two characters of a gene symbol and the capitals that follow."""
    return F.regexp_extract(symbol, "^(..[A-Z]*)", 1)
