"""Counters of a run, gathered while its tables are written: no job of their own.

A count is an observed metric of a plan; where a name counts several plans, the parts of one table, their counts are added. Counts by chromosome are frequent-item sketches with room for more items than a
block of chromosomes has, which makes them exact; longer dictionaries take several sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Chromosomes of one sketch; a sketch has room for so many items and null.
BLOCK = 9_000


class Counters:
    """Named counts of rows that go by. ``n_chr``: chromosomes of the dictionary."""

    def __init__(self, n_chr: int) -> None:
        self.n_chr = n_chr
        self.seen: dict[str, list[Observation]] = {}

    def rows(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, whose rows are counted when it is next computed."""
        return df.observe(self._next(name), F.count("*").alias("n"))

    def by_chr(self, df: DataFrame, name: str, column: str = "chr") -> DataFrame:
        """``df``, whose rows are counted by chromosome; null is the unmapped one."""
        blocks = range(0, max(self.n_chr, 1), BLOCK)
        tops = [F.expr(f"approx_top_k(if({column} >= {b} and {column} < {b + BLOCK}, {column}, null), {BLOCK + 1}, {BLOCK + 1})").alias(f"b{b}") for b in blocks]
        return df.observe(self._next(name), F.count("*").alias("n"), *tops)

    def _next(self, name: str) -> Observation:
        self.seen.setdefault(name, []).append(Observation())
        return self.seen[name][-1]

    def values(self) -> dict[str, int | dict[int | None, int]]:
        """Counts by name, once all tables have been computed: a number, or numbers by chromosome (None: unmapped)."""
        out: dict = {}
        for name, observations in self.seen.items():
            every = [o.get for o in observations]
            total = sum(got["n"] for got in every)
            if len(every[0]) == 1:
                out[name] = total
                continue
            found: dict[int | None, int] = {}
            for r in (r for got in every for c, top in got.items() if c != "n" for r in top or [] if r["item"] is not None):
                found[r["item"]] = found.get(r["item"], 0) + r["count"]
            rest = total - sum(found.values())
            out[name] = found | ({None: rest} if rest else {})
        return out


class NoCounters(Counters):
    def __init__(self) -> None:
        super().__init__(0)

    def rows(self, df: DataFrame, name: str) -> DataFrame:
        return df

    def by_chr(self, df: DataFrame, name: str, column: str = "chr") -> DataFrame:
        return df
