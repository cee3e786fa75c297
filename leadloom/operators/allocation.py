"""Sharing a total among ordered consumers: a running sum over per-consumer counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import cut


def cascade(consumers: DataFrame, wanted: str, order: list[Column], total: Column, buckets: int = 200) -> DataFrame:
    """Adds ``allotted``: each consumer in ``order`` takes what it wants until ``total`` is used up; a NULL total is
    unlimited.

    The running sum is taken in two steps: consumers are range partitioned in ``order``, each partition sums up on its
    own, and the sums of the partitions before (one row each, ``buckets`` at most) are added. Ties in ``order`` must
    not occur, or who comes first among them is open.
    """
    spread = consumers.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id())
    placed = cut(spread)  # partition numbers must not change between the two uses
    sums = placed.groupBy("_part").agg(F.sum(wanted).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_part", before.alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.col("_before") + F.coalesce(F.sum(wanted).over(w), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col(wanted), total - prior))
    return (
        placed.join(offsets, "_part")
        .withColumn("allotted", F.when(total.isNull(), F.col(wanted)).otherwise(left).cast("long"))
        .drop("_part", "_before")
    )


def cut_per_group(rows: DataFrame, group: str, order: list[Column], allotted: DataFrame) -> DataFrame:
    """The first ``allotted`` rows of each group (``allotted``: group, allotted)."""
    w = Window.partitionBy(group).orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(w))
        .join(allotted, group)
        .where(F.col("_rn") <= F.col("allotted"))
        .drop("_rn", "allotted")
    )
