"""JSON text in columns: validation, canonical text, typed reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAPSHOT = "struct<name:string,skill:string,instrument:string,budget:double>"
MESSAGE = "struct<role:string,content:string,product_ids:array<string>>"
MESSAGES = f"array<{MESSAGE}>"

# A quoted string (kept as it is) or white space between tokens (dropped).
_TOKENS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+'


def is_json(text: Column) -> Column:
    """False for NULL, the empty string and malformed text."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def canonical_json(text: Column) -> Column:
    """Text without white space between tokens, key order kept; NULL where it is not JSON."""
    return F.when(is_json(text), F.regexp_replace(text, _TOKENS, "$1"))


def id_list(text: Column) -> Column:
    """JSON array of ids; NULL, empty or malformed text gives the empty array."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.from_json(text, "array<string>"), empty)


def id_text(text: Column) -> Column:
    return F.array_join(id_list(text), ", ")


def customer_snapshot(text: Column) -> Column:
    return F.from_json(text, SNAPSHOT)


def messages(text: Column) -> Column:
    """Messages of a transcript; a missing or malformed transcript has none."""
    return F.coalesce(F.from_json(text, MESSAGES), F.array().cast(MESSAGES))
