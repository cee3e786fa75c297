"""Streaming queries run to completion over the files of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.plans.registry import Registry
from leadloom.plans.table_queries import ORACLE as TABLE_SQL
from leadloom.session import shared_folder, table
from leadloom.streaming.admission import admit_stream
from leadloom.streaming.incremental import append_raw, final_rows

R = Registry()


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@R.add(TABLE_SQL["sliding_log_admission"])
def streaming_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admission query as a stream; its decisions equal those of the batch form."""
    folder = shared_folder(spark, "stream")
    out = admit_stream(_stream(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 86_400)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "admitted")


@R.add("SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1")
def streaming_append_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended batch by batch, de-duplicated at the end."""
    folder = shared_folder(spark, "stream")
    append_raw(_stream(spark, sf_dir, "events"), f"{folder}/raw", f"{folder}/state").awaitTermination()
    rows = final_rows(spark, f"{folder}/raw", F.col("event_type"), [F.col("event_id")])
    return rows.select("event_type", F.col("event_id").alias("first_id"))


@R.add(
    "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS hour_us, event_type, count(*) AS n FROM events GROUP BY 1, 2"
)
def streaming_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts with a watermark. Every batch overwrites the stored counts of the windows it touched: updates are
    appended with their batch number and the last one of a window counts."""
    folder = shared_folder(spark, "hourly")
    ts = F.col("ts").cast("timestamp")
    counts = (
        _stream(spark, sf_dir, "events").withColumn("at", ts).withWatermark("at", "1 day")
        .groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_micros("w.start").alias("hour_us"), "event_type", "n")
    )

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    counts.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out")
    return stored.groupBy("hour_us", "event_type").agg(F.max_by("n", "batch").alias("n"))


QUERIES, ORACLE = R.queries, R.sql
