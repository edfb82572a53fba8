"""The growing corpus as a stream: works arrive by files, and the yearly ledger is kept as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_to_ledger(spark: SparkSession, folder: str, schema: str, ledger: str, checkpoint: str) -> None:
    """Takes in all files that are there, batch by batch.  Each batch's counts are stored under its number, so a batch
    that is run again after a failure replaces its own rows and the ledger's sums stay right."""

    def store(batch: DataFrame, number: int) -> None:
        counts = batch.where(F.col("year").isNotNull()).groupBy("year").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    works = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    works.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """year, n over all batches."""
    rows = spark.read.schema("year int, n long, batch int").option("basePath", path).parquet(path)
    return rows.groupBy("year").agg(F.sum("n").alias("n"))
