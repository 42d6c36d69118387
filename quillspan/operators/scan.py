"""Running sums of groups of any size, none of which is ever in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import staged


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums from the first row of its group up to each, in ``order`` (which tells all rows of a group apart).

    A prefix scan: rows are dealt out by ranges of group and order and written down as blocks; each block adds up its groups, the totals of the
    blocks are summed over, and what stands before a block is added to the sums inside it. A window holds a block, or a group's
    blocks, and no group whole.
    """
    given = rows.withColumns({f"__{k}": F.coalesce(v, F.lit(0)).cast("long") for k, v in sums.items()})
    blocks = staged(given.repartitionByRange(*group, *order).withColumn("__block", F.spark_partition_id()), "scan")
    keys = [F.col(g) for g in group]
    totals = blocks.groupBy("__block", *group).agg(*(F.sum(f"__{k}").alias(k) for k in sums))
    earlier = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("__block").alias("b_block"), *(k.alias(f"b_{g}") for k, g in zip(keys, group)), *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"b__{k}") for k in sums))
    inside = Window.partitionBy("__block", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = blocks.withColumns({f"__{k}": F.sum(f"__{k}").over(inside) for k in sums})
    same = F.col("__block") == F.col("b_block")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"b_{g}"))
    joined = summed.join(before, same)
    return joined.select(*rows.columns, *((F.col(f"__{k}") + F.col(f"b__{k}")).alias(k) for k in sums))
