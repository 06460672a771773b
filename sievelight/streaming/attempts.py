"""The ledger as a stream (an extension): attempts arrive as files, results are kept up to date.

Each helper starts a query with the availableNow trigger and a checkpoint in the shared folder, so it ends when what is
there has been consumed and a later call with the same checkpoint goes on from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.session import shared_folder


def _run(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path``, with the schema that they have now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def hourly(spark: SparkSession, path: str, lateness: str = "2 hours", folder: str | None = None) -> DataFrame:
    """(event_type, hour, n, total): tumbling windows, of which every batch overwrites the table with the state so far.

    Sums are decimals, so they don't depend on the order of arrival.
    """
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = read_files(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    counts = rows.groupBy("event_type", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("s"))
    out = counts.select("event_type", F.unix_timestamp("w.start").alias("hour"), "n", F.round(F.col("s").cast("double"), 4).alias("total"))

    def keep(batch: DataFrame, _n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    out.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_type string, hour long, n long, total double").parquet(f"{folder}/rows")


def first_attempts(spark: SparkSession, path: str, keys: list[str], lateness: str = "1 day", folder: str | None = None) -> DataFrame:
    """The first arrival per key; repeats within the watermark are dropped, state older than it is forgotten."""
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = read_files(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return _run(rows.dropDuplicatesWithinWatermark(keys), "append", folder)
