"""Raw CSV files that keep arriving: each is loaded exactly once, with an audit row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fretwork.schemas import RAW
from fretwork.sources.pointers import files_of
from fretwork.streaming.files import run_available

AUDIT = "table_name string, source_file string, row_count bigint, batch_id bigint"


def load_arrivals(spark: SparkSession, pattern: str, name: str, out_dir: str, checkpoint: str, max_files: int | None = None) -> None:
    """Load the files below ``pattern`` that have come since the last run with the same ``checkpoint`` into raw table ``name``.

    A batch of files is written to a folder of its own, then its audit, last; a batch that was lost in between is written again from the
    same files, one whose audit is complete is passed over. A file is known by its path: one that is changed later is not
    read again. A file without rows gives no audit row. Files must appear whole, by a rename or with their folder.
    """
    reader = spark.readStream.schema(RAW[name]).options(header=True, quote='"', escape='"')
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    rows = reader.csv(pattern).select("*", F.col("_metadata.file_path").alias("source_file"))

    def write(batch: DataFrame, batch_id: int) -> None:
        audit = f"{out_dir}/file_audit/raw_{name}/batch_id={batch_id}"
        marker, files = files_of(spark, f"{audit}/_SUCCESS")
        if files.exists(marker):
            return
        folder = f"{out_dir}/raw_{name}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        counts = stored.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"))
        counts.select(F.lit(f"raw_{name}").alias("table_name"), "source_file", "row_count").write.mode("overwrite").parquet(audit)

    run_available(rows.writeStream.foreachBatch(write), checkpoint)


def file_audit(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """(table_name, source_file, row_count, batch_id) of all loaded files."""
    return spark.read.schema(AUDIT).parquet(f"{out_dir}/file_audit/raw_{name}")


def read_arrivals(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The raw table with ``source_file`` and ``batch_id``: batches that have their audit, so never a part of one."""
    schema = T.StructType([*RAW[name].fields, T.StructField("source_file", T.StringType()), T.StructField("batch_id", T.LongType())])
    complete = file_audit(spark, out_dir, name).select("batch_id").distinct()
    return spark.read.schema(schema).parquet(f"{out_dir}/raw_{name}").join(complete, "batch_id", "left_semi").select(*schema.names)
