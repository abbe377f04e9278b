"""Parameters of the detection job."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FusionConfig:
    """min_reads: a cluster needs more. alpha: reads of a cluster within alpha - 1 support each other. slack: bases before a gene or exon.

    compat "literal" keeps two deterministic quirks of older tools: breakpoints over orientation-normalised ends,
    and the first exon's frame for every hit.
    """

    min_reads: int = 5
    alpha: int = 200
    slack: int = 50
    min_mapq: int = 0
    paired: bool = True
    compat: str = "intended"

    @property
    def radius(self) -> int:
        return self.alpha - 1
