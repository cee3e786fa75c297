"""Session helpers: table loading, shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to a private folder in local mode only."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "leadloom-checkpoints")
    spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """The right side of a join whose sides both grow with the data: both are shuffled, neither is collected in the driver.

    Left alone, Spark broadcasts a side by an estimate that knows nothing of compression, explode() or what a
    checkpoint holds, and the driver holds every such side whole.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"{kind}-{uuid.uuid4().hex}")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a scan has fewer partitions than there are cores, as with one small file.

    Only for heavy work on few bytes; a scan of any size worth a cluster has more partitions and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
