"""Sources, sinks and runs shared by the streaming operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_table(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None) -> DataFrame:
    """Parquet files as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there and read all results so far.

    `folder` is the stream's own: output and checkpoint lie in it. Starting the same stream again with
    the same folder goes on where it ended; a lost executor or driver only repeats its batch, and the
    file sink keeps every batch once.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_for_each(stream: DataFrame, folder: str, action: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there, handing every batch to `action`; goes on where it ended."""
    writer = stream.writeStream.foreachBatch(action).option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
