"""Build of the warehouse: raw files to staging to mart tables, written aside, audited, then published.

Every build has a folder of its own below ``<out>/builds``. Readers find the current one through ``<out>/published``, a folder of
numbered pointers that are never changed (``sources.pointers``): a pointer appears in one step, after the build has been written and has
passed its audit, and the highest number counts. So readers see the old build or the new one, never parts of both; a build
that fails leaves the old one as it was, and two builds at the same time end up one after the other.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.operators.checks import contract_report, duplicate_keys
from fretwork.plans import marts, staging
from fretwork.schemas import RAW
from fretwork.session import run_together
from fretwork.sources.pointers import point_to, pointers, remove
from fretwork.sources.raw_files import good_rows, load_raw, rejected_rows

AUDIT = "table_name string, row_count bigint"
MARTS = ["dim_products", "dim_customers", "fct_recommendations", "inventory"]
# Marts that complete another one: all pages of the customers' product lists, and the summed order lines behind both customer tables.
DETAILS = ["product_pages", "order_items"]
KEYS = {"dim_products": ["product_id"], "dim_customers": ["customer_id"], "fct_recommendations": ["handoff_id"], "inventory": ["product_id"]}


class AuditError(ValueError):
    """A build that was written but must not be published."""


def published(spark: SparkSession, out_dir: str) -> list[tuple[int, str]]:
    """(number, folder of the build) of everything that was published, the current build last."""
    return [(number, f"{out_dir}/builds/{name}") for number, name in pointers(spark, f"{out_dir}/published")]


def current(spark: SparkSession, out_dir: str) -> str | None:
    """Folder of the build that readers see; None before the first one."""
    builds = published(spark, out_dir)
    return builds[-1][1] if builds else None


def table_path(spark: SparkSession, out_dir: str, name: str) -> str:
    """Where a table of the current build lies."""
    folder = current(spark, out_dir)
    if folder is None:
        raise ValueError(f"nothing has been published in {out_dir}")
    return f"{folder}/{name}"


def read_table(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """Any table of the current build: raw, quarantine, mart or audit."""
    return spark.read.parquet(table_path(spark, out_dir, name))


def raw_tables(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The raw tables of the current build."""
    return _raw_tables(spark, table_path(spark, out_dir, "").rstrip("/"))


def _raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder}/raw_{name}") for name, schema in RAW.items()}


def create_staging_views(raw: dict[str, DataFrame]) -> None:
    for name in ("products", "customers", "orders"):
        view = getattr(staging, f"stg_{name}")(good_rows(raw[name], name))
        view.createOrReplaceTempView(f"stg_{name}")


def write_marts(raw: dict[str, DataFrame], folder: str, page_products: int = marts.PAGE_PRODUCTS) -> None:
    """Write the marts and the quarantine tables of the raw tables. Order lines are parsed and summed once; both customer tables read the sums."""
    spark = raw["orders"].sparkSession
    good = {name: good_rows(df, name) for name, df in raw.items()}

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def customers() -> None:
        items = written("order_items", marts.order_items(staging.stg_orders(good["orders"])))
        pages = written("product_pages", marts.product_pages(marts.customer_products(items), page_products))
        written("dim_customers", marts.customer_mart(staging.stg_customers(good["customers"]), items, pages))

    run_together(
        customers,
        lambda: written("dim_products", marts.dim_products(staging.stg_products(good["products"]))),
        lambda: written("fct_recommendations", marts.fct_recommendations(good["se_handoffs"])),
        lambda: written("inventory", marts.inventory(good["inventory"])),
        *[functools.partial(written, f"rejected_{name}", rejected_rows(df, name)) for name, df in raw.items()],
    )


def audit_build(spark: SparkSession, folder: str) -> DataFrame:
    """(contract, n_violations) of a written build: raw rows against the load audit, and the keys of the marts."""
    loaded = spark.read.schema(AUDIT).parquet(f"{folder}/load_audit")
    counts = [spark.read.parquet(f"{folder}/raw_{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"raw_{n}").alias("table_name"), "n") for n in RAW]
    stored = counts[0]
    for more in counts[1:]:
        stored = stored.unionByName(more)
    differing = loaded.join(stored, "table_name", "full").where(~F.col("row_count").eqNullSafe(F.col("n")))
    repeated = {f"{n}_key": duplicate_keys(spark.read.parquet(f"{folder}/{n}"), keys) for n, keys in KEYS.items()}
    return contract_report({"raw_rows": differing, **repeated})


def built(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The load audit of the current build; None where there is none."""
    folder = current(spark, out_dir)
    return None if folder is None else spark.read.schema(AUDIT).parquet(f"{folder}/load_audit")


def build(
    spark: SparkSession,
    data_dir: str,
    out_dir: str,
    replace: bool = True,
    multi_line: bool = False,
    page_products: int = marts.PAGE_PRODUCTS,
    strict: bool = False,
) -> DataFrame:
    """Load the raw files, write the marts and the quarantine tables, publish the build; returns its load audit.

    ``replace=False`` touches nothing where a build has been published before. Raw rows that are not all stored stop a build before it is
    published, with ``strict`` also repeated keys of a mart.
    """
    done = None if replace else built(spark, out_dir)
    if done is not None:
        return done
    name = uuid.uuid4().hex
    folder = f"{out_dir}/builds/{name}"
    audit = load_raw(spark, data_dir, folder, multi_line=multi_line)
    raw = _raw_tables(spark, folder)
    write_marts(raw, folder, page_products)
    audit.write.parquet(f"{folder}/load_audit")
    report = audit_build(spark, folder)
    report.write.parquet(f"{folder}/build_audit")
    broken = [r for r in spark.read.parquet(f"{folder}/build_audit").collect() if r["n_violations"] and (strict or r["contract"] == "raw_rows")]
    if broken:
        raise AuditError(f"build {name} is not published: " + ", ".join(f"{r['contract']} {r['n_violations']}" for r in broken))
    point_to(spark, f"{out_dir}/published", name)
    return spark.read.schema(AUDIT).parquet(f"{folder}/load_audit")


def drop_old_builds(spark: SparkSession, out_dir: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` published builds, oldest first, each after its pointer; returns their folders.

    Folders that were never published stay: a build that is running now looks the same as one that failed.
    """
    gone = []
    for number, folder in published(spark, out_dir)[: -max(1, keep)]:
        remove(spark, f"{out_dir}/published/{number:08d}-{folder.rsplit('/', 1)[1]}")
        remove(spark, folder)
        gone.append(folder)
    return gone


def read_mart(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    if name not in MARTS + DETAILS:
        raise ValueError(f"no mart named {name!r}")
    return read_table(spark, out_dir, name)
