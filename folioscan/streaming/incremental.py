"""Incremental line search over files that arrive: an extension of the search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.operators.search import grep


def watch(spark: SparkSession, folder: str, schema: str, pattern: str, most: int = 5, text: str = "text", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the new rows of Parquet files in folder that match; stateless, so it needs no watermark."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return grep(arriving, pattern, most, text)


def keep(stream: DataFrame, to: str, checkpoint: str):
    """Append the stream's rows to a folder, each file once."""
    return stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
