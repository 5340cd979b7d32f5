"""The change log as a stream: the batch predicates on arriving files, and counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polisframe.model import SCHEMAS, TypeRegistry
from polisframe.operators.changelog import change_condition


def change_stream(spark: SparkSession, path: str, types: TypeRegistry | None = None, max_files: int | None = None,
                  **filters) -> DataFrame:
    """Change rows of a folder that new Parquet files are added to, under the filters of ``changes``."""
    reader = spark.readStream.schema(SCHEMAS["feature_changelog"])
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).where(change_condition(types, **filters))


def windowed_counts(changes: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Changes per window and transaction type. State is kept for windows the watermark has not passed."""
    return changes.withWatermark("transaction_date", lateness).groupBy(
        F.window("transaction_date", window), "transaction_type").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "transaction_type", "n")


def count_arrivals(spark: SparkSession, source: str, folder: str, window: str = "1 day", lateness: str = "30 days", max_files: int | None = None, **filters) -> dict[str, int]:
    """Take in what has arrived in ``source`` since the last call, and end: counts per window go to ``folder``, each batch to a folder of its own.

    State and progress are kept in ``folder``, so a call after an interruption or without new files counts nothing twice. The answer tells how many
    rows came in and how many were later than ``lateness`` behind the newest and left out. ``arrived_counts`` reads the totals.
    """
    counts = windowed_counts(change_stream(spark, source, max_files=max_files, **filters), window, lateness)
    # a batch that runs again overwrites its own folder
    sink = lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch}")
    run = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    progress = run.recentProgress
    return {"rows": sum(p.numInputRows for p in progress), "late": sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators)}


def arrived_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(start, transaction_type, n): the last count of each window that ``count_arrivals`` wrote."""
    return spark.read.parquet(f"{folder}/counts").groupBy("start", "transaction_type").agg(F.max_by("n", "batch").alias("n"))
