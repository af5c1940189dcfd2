"""Places in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize


def numbered(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """df with its place (from 0) in the order.

    A range sort whose ties are split by row, so that equal keys of any number spread over ranges; only one count a
    range is ordered in a single task and sent along (as many rows as the shuffle has partitions).
    Equal keys are numbered in any order. The result reads a table in the shared folder.
    """
    tie, part, k, before = (fresh([*df.columns, into], c) for c in ("tie", "part", "k", "before"))
    dealt = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, F.col(tie)).drop(tie)
    rows = materialize(dealt.withColumn(part, F.spark_partition_id()).withColumn(k, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = rows.groupBy(part).agg(F.count("*").alias(before))
    offsets = sizes.withColumn(before, F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(offsets), part).withColumn(into, F.col(k) + F.col(before)).drop(part, k, before)
