"""Session helpers: recommended settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "false",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def local_session(name: str = "stipendia", cores: str = "8", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return (builder.config("spark.ui.enabled", "false")
            .config("spark.driver.memory", memory)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .getOrCreate())


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared checkpoint folder named by the session.

    A local test session without that setting gets a temporary folder; a
    cluster without it is a configuration error, because an executor-local
    folder would not survive the loss of the executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured:
            context.setCheckpointDir(configured)
        elif _is_local(spark):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="stipendia-checkpoint-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which all executors can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None and not _is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base}/work-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="stipendia-work-")
