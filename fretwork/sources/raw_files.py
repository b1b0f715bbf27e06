"""Raw CSV files: declared schemas, rejected rows, load audit."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fretwork.functions.jsonio import is_json
from fretwork.schemas import RAW
from fretwork.session import run_together

# Columns that staging casts, with the type that each text must be able to take.
CASTS = {
    "customers": {"years_playing": "int", "created_at": "date"},
    "inventory": {"quantity": "int"},
    "orders": {"quantity": "int", "unit_price": "decimal(10,2)", "order_date": "date"},
    "products": {"price": "decimal(10,2)", "in_stock": "boolean"},
    "se_handoffs": {"created_at": "timestamp"},
}

# Rows of a packed CSV file.
PACKED_ROWS = 500_000

# Columns that must hold JSON text where they are filled.
JSON_COLUMNS = {"se_handoffs": ["customer_snapshot", "recommended_products"]}


def read_csv(spark: SparkSession, path: str, name: str, multi_line: bool = False) -> DataFrame:
    """A raw file (or a folder of its parts) as text columns; quotes inside a cell are doubled.

    ``multi_line=True`` reads files with line breaks inside a cell, each file in one task; without it large files are split.
    """
    return spark.read.schema(RAW[name]).csv(path, header=True, quote='"', escape='"', multiLine=multi_line)


def write_csv(df: DataFrame, path: str, name: str, packed: bool = False) -> None:
    """Write a raw table in its declared column order with a header row.

    ``packed=True`` writes gzip files. A task reads each of those whole, so they end after ``PACKED_ROWS`` rows.
    """
    writer = df.select(*RAW[name].fieldNames()).write.mode("overwrite")
    if packed:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", str(PACKED_ROWS))
    writer.csv(path, header=True, quote='"', escape='"', emptyValue="")


def reject_reason(name: str) -> Column:
    """Name of the first column whose text does not fit its type; NULL for a good row."""
    checks = [
        F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in CASTS.get(name, {}).items()
    ] + [F.when(F.col(c).isNotNull() & ~is_json(F.col(c)), F.lit(c)) for c in JSON_COLUMNS.get(name, [])]
    return F.coalesce(*checks, F.lit(None).cast("string"))


def good_rows(raw: DataFrame, name: str) -> DataFrame:
    return raw.where(reject_reason(name).isNull())


def rejected_rows(raw: DataFrame, name: str) -> DataFrame:
    """Rows for the quarantine table, with the column at fault."""
    return raw.withColumn("rejected_column", reject_reason(name)).where(F.col("rejected_column").isNotNull())


def load_raw(
    spark: SparkSession, data_dir: str, out_dir: str, names: list[str] | None = None, multi_line: bool = False
) -> DataFrame:
    """Load every declared file into ``raw_<name>`` tables; returns (table_name, row_count).

    The counts are observed while the rows are written: no second pass over the data.
    """

    def load(name: str) -> tuple[str, int]:
        seen = Observation(f"load_{name}")
        rows = read_csv(spark, f"{data_dir}/{name}.csv", name, multi_line).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out_dir}/raw_{name}")
        return f"raw_{name}", int(seen.get["n"])

    counts = run_together(*[functools.partial(load, name) for name in sorted(names or RAW)])
    return spark.createDataFrame(counts, "table_name string, row_count bigint")
