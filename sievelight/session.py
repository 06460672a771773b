"""Sessions and the folders that all executors share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

#: Settings that a new local session gets; a cluster's own settings win.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory)
    for k, v in LOCAL.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a local session gets one beside its warehouse; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark drops the shuffles that nothing refers to any more.

    Without it an iteration's files stay until the driver happens to run short of memory. Checkpoints go the same way
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, as it is in ``local_session``; a session made
    elsewhere has to set it when it starts.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes an intermediate folder that this engine wrote, in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that what follows survives lost executors and isn't computed twice."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Tasks of each core that sort a whole table.
TASKS_A_CORE = 16


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys brought together, in so many partitions that the sorts of one task stay small beside its memory."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
