"""JSON text parsed once, at load, into VARIANT columns that later reads enter by path.

A loaded table keeps the text and holds two columns beside it per JSON column ``c``: ``c_json`` (VARIANT) and ``c_rest``. A text is one of four:
missing, parsed, malformed, or larger than ``TEXT_BYTES``, the most that VARIANT takes. Missing and malformed texts (so also those nested
deeper than VARIANT allows) have no value at any path. A text that is too large stands in ``c_rest``, and paths are then
looked up in it as text, so it gives the same values at a slower pace. All others have NULL there, so reads by path touch neither the text nor,
where files are shredded, the parts of the VARIANT that no path names.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.functions.jsonio import MESSAGES

TEXT_BYTES = 128 * 1024 * 1024 - 1024
# Files are written with the paths that most of their rows share as columns of their own.
SHREDDING = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}


def with_json(rows: DataFrame, columns: Sequence[str], text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Adds ``c_json`` and ``c_rest`` for each of ``columns``; the table must not have columns of these names."""
    clash = {f"{c}{end}" for c in columns for end in ("_json", "_rest")} & set(rows.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    large = {c: F.octet_length(c) > text_bytes for c in columns}
    parsed = {f"{c}_json": F.try_parse_json(F.when(~large[c], F.col(c))) for c in columns}
    return rows.withColumns({**parsed, **{f"{c}_rest": F.when(large[c], F.col(c)) for c in columns}})


@contextlib.contextmanager
def _shredded(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in SHREDDING}
    for key, value in SHREDDING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def load_json(rows: DataFrame, columns: Sequence[str], path: str, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Write ``rows`` with their parsed columns to the new folder ``path``; returns the stored table."""
    parsed = with_json(rows, columns, text_bytes)
    with _shredded(rows.sparkSession):
        parsed.write.parquet(path)
    return rows.sparkSession.read.schema(parsed.schema).parquet(path)


def at(column: str, path: str, kind: str) -> Column:
    """Value at ``path`` of a loaded column as SQL type ``kind``; NULL where there is none or it does not fit."""
    text = F.get_json_object(f"{column}_rest", path)
    nested = kind.startswith(("array", "struct", "map"))
    return F.coalesce(F.try_variant_get(f"{column}_json", path, kind), F.from_json(text, kind) if nested else text.try_cast(kind))


def snapshots(handoffs: DataFrame) -> DataFrame:
    """handoff_id with the typed snapshot fields and the list of recommended ids, from loaded columns."""
    ids = F.coalesce(at("recommended_products", "$", "array<string>"), F.array().cast("array<string>"))
    fields = [("name", "string"), ("skill", "string"), ("instrument", "string"), ("budget", "double")]
    return handoffs.select("handoff_id", *[at("customer_snapshot", f"$.{name}", kind).alias(name) for name, kind in fields], ids.alias("ids"))


def message_rows(transcripts: DataFrame, kind: str = MESSAGES) -> DataFrame:
    """One row per message of loaded transcript pages: session_id, page_no, position in its page, and the fields that ``kind`` names."""
    found = transcripts.select("session_id", "page_no", F.posexplode(at("messages", "$", kind)).alias("position", "_m"))
    return found.select("session_id", "page_no", "position", "_m.*")
