"""Raw rows are appended as they arrive, so a crash keeps what was written; the final table is de-duplicated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.dedupe import first_by_key


def append_raw(stream: DataFrame, out: str, checkpoint: str):  # noqa: ANN201
    """Runs over what is available; the checkpoint makes a restarted run continue, each batch has its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_rows(spark: SparkSession, out: str, key: Column, order: list[Column]) -> DataFrame:
    """First row of each key over all batches."""
    return first_by_key(spark.read.option("basePath", out).parquet(f"{out}/batch=*"), key, order)
