"""Numbers and running sums over a whole table in a stated order.

A window without a partition would bring all rows to one task. Here rows are
dealt out by range, each task numbers or sums its own, and what lies before a
task is added from one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import staged

PART_BITS = 33  # of monotonically_increasing_id: the row within its task lies below


def numbered(rows: DataFrame, order: Iterable, name: str = "number") -> DataFrame:
    """`rows` with their place from 0 in `order`, without gaps. Rows that tie
    in all of `order` are numbered in any order among themselves, and a task
    gets all of them."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    part, within = F.call_function("shiftright", "__at", F.lit(PART_BITS)), F.col("__at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    placed = staged(placed.select(*rows.columns, part.alias("__part"), within.alias("__within")), "numbered")
    before = _before(placed.groupBy("__part").agg(F.count("*").alias("__sum")))
    return placed.join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__before") + F.col("__within")).alias(name))


def running_sums(rows: DataFrame, order: Iterable, value: str, name: str = "before") -> DataFrame:
    """`rows` with the sum of `value` over the rows ahead of each in `order`,
    0 for the first. Rows shouldn't tie in all of `order`."""
    dealt = staged(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "running-sums")
    ahead = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__own", F.coalesce(F.sum(value).over(ahead), F.lit(0)))
    before = _before(dealt.groupBy("__part").agg(F.sum(value).alias("__sum")))
    return own.join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__before") + F.col("__own")).alias(name))


def _before(parts: DataFrame) -> DataFrame:
    """(__part, __before) of (__part, __sum): one row for each task of the shuffle."""
    return parts.select("__part", F.expr("coalesce(sum(__sum) OVER (ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("__before"))
