"""Streams over growing folders of files, and their run to the end of what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def read_parquet_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of the files that match ``path``; the schema comes from the files already there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that has arrived, in as many batches as the source sets, then stop.

    A restart with the same ``checkpoint`` goes on where the last run ended.
    """
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append the stream to a Parquet folder, each row exactly once."""
    run_available(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)
