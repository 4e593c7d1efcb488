"""Running sums and ranks over a whole table, without gathering it in one task.

The table is range-sorted; each range's sum is one row, so the offsets of the ranges are few; the rest is a sum within
each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.session import written


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums in the order of columns that identify a row: {new column: summed column}; '1' counts rows.

    The ranges are written to the shared folder first, so that all later steps see the same ones.
    """
    names = list(sums)
    ranged = written(df.withColumns({f"_v{i}": F.lit(1).cast("long") if sums[n] == "1" else F.col(sums[n]) for i, n in enumerate(names)}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(names))])
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, *[(F.col(f"_o{i}") + F.sum(f"_v{i}").over(within)).alias(n) for i, n in enumerate(names)])
