"""An extension: pair counts kept up to date over a stream of JSON event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.sources.records import endpoints_of


def event_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(pre, post) of the records of files as they arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).where(F.trim("value") != "")
    return endpoints_of(lines).dropna()


def running_counts(events: DataFrame) -> DataFrame:
    """State is one row per pair seen: as large as the pair table, kept in the state store's partitions."""
    return events.groupBy("pre", "post").agg(F.count("*").alias("synapse_count"))


def drain(spark: SparkSession, folder: str, checkpoint: str, table: str) -> DataFrame:
    """Everything there now, counted once, into a named in-memory table; a later call goes on from the checkpoint."""
    query = running_counts(event_stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(table)
