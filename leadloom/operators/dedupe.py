"""Order-sensitive de-duplication: the first row of a key in an explicit total order survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(
    df: DataFrame, key: Column, order: list[Column], limit: int | None = None, keep_null: bool = False
) -> DataFrame:
    """One row per key, the first in ``order`` (which must end in a unique column); at most ``limit`` keys.

    Rows with a NULL key are dropped unless ``keep_null``, which makes NULL a key of its own. The window is planned
    with a partial group limit, so a hot key leaves each task as one row.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    keyed = df.withColumn("_key", key)
    if not keep_null:
        keyed = keyed.where(F.col("_key").isNotNull())
    w = Window.partitionBy("_key").orderBy(*order)
    out = keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_key", "_rn")
    return out if limit is None else out.orderBy(*order).limit(limit)


def drop_reasons(df: DataFrame, reasons: list[tuple[str, Column]], keep: str = "kept") -> DataFrame:
    """Adds ``reason``: the first condition that holds, else ``keep``; unknown conditions count as not met."""
    out = F.lit(keep)
    for name, condition in reversed(reasons):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return df.withColumn("reason", out)


def unique_values(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value) of the keys that have exactly one distinct non-NULL value."""
    return (
        df.select(key.alias("key"), value.alias("value"))
        .where("key IS NOT NULL AND key <> '' AND value IS NOT NULL")
        .groupBy("key")
        .agg(F.min("value").alias("value"), F.max("value").alias("_hi"))
        .where("value = _hi")
        .select("key", "value")
    )
