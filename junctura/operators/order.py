"""Global ranks and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.tables import cut


def running(rows: DataFrame, order: list[str | Column], rank: str, sums: dict[str, str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """``rows`` with their rank from 1 in ``order`` (of all rows, or of those with equal ``keys``) and, for each column of ``sums``, its sum over the rows before.

    Rows are dealt to ranges of (keys, order), so that a hot key is split too, and written; ranks and sums run within a
    range, and what lies before it is added from one small row for each range (and key). Rows that are equal in order
    take consecutive ranks in no fixed order. Null sums count as 0.
    """
    sums, keys = sums or {}, keys or []
    by = [*keys, *order]
    dealt = cut(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = {"_rows": F.coalesce(F.sum("_rows").over(ahead), F.lit(0))} | {f"_sum_{c}": F.coalesce(F.sum(f"_sum_{c}").over(ahead), F.lit(0)) for c in sums}
    starts = totals.withColumns(before).withColumnsRenamed({k: f"_key_{k}" for k in keys}).withColumnRenamed("_part", "_range")
    same = dealt["_part"] == starts["_range"]
    for k in keys:
        same = same & dealt[k].eqNullSafe(starts[f"_key_{k}"])
    within = Window.partitionBy("_part", *keys).orderBy(*order)
    added = {rank: (F.row_number().over(within) + F.col("_rows")).cast("long")}
    added |= {out: (F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(f"_sum_{c}")).cast("long") for c, out in sums.items()}
    return dealt.join(starts, same).withColumns(added).select(*rows.columns, *added)
