"""Table maintenance on Parquet tables: a rewritten frame is returned, the caller swaps it in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(
    current: DataFrame, batch: DataFrame, key: list[str], order: list[Column], preserve: list[str] | None = None
) -> DataFrame:
    """``current`` with the rows of ``batch`` inserted or replaced by ``key``.

    Within the batch the first row in ``order`` wins, so the latest row wins with a descending order. Columns the batch lacks keep their stored value; those in
    ``preserve`` also do where the batch holds NULL. Rows of the batch with a NULL key are refused (dropped).
    """
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = batch.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    fresh = fresh.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    own, new = current.alias("c"), fresh.withColumn("_new", F.lit(True)).alias("b")
    joined = own.join(new, key, "full_outer")
    cols = []
    for c in current.columns:
        if c in key:
            cols.append(F.col(c))
        elif c not in batch.columns:
            cols.append(F.col(f"c.{c}").alias(c))
        elif preserve and c in preserve:
            cols.append(F.coalesce(F.col(f"b.{c}"), F.col(f"c.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"c.{c}")).alias(c))
    return joined.select(*cols)


def update_from(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``current`` with ``columns`` replaced for the ids of ``changes`` (one row per id), NULLs included."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns]).withColumn("_hit", F.lit(True))
    out = current.join(new, key, "left")
    picks = [
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in current.columns
    ]
    return out.select(*picks)


def append_new(current: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """``current`` plus the rows of ``batch`` whose key is not stored yet."""
    return current.unionByName(batch.join(current.select(*key), key, "left_anti"), allowMissingColumns=True)
