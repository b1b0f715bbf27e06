"""Declared schemas. Files are never read with inferred types."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "timestamp": T.TimestampType()}


def _struct(text: str) -> T.StructType:
    """Schema from ``name type, name type``; unlike a DDL parse it needs no running session."""
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Raw files: every column as text, as it stands in the file; staging casts.
RAW = {
    "customers": _struct(
        "customer_id string, first_name string, last_name string, email string, skill_level string,"
        " primary_instrument string, years_playing string, use_case string, budget_range string, created_at string"
    ),
    "inventory": _struct("product_id string, quantity string"),
    "orders": _struct(
        "order_id string, customer_id string, product_id string, quantity string, unit_price string,"
        " order_date string, status string"
    ),
    "products": _struct(
        "product_id string, name string, brand string, category string, subcategory string, price string,"
        " description string, skill_level string, use_case string, in_stock string, manufacturer_url string"
    ),
    "se_handoffs": _struct(
        "handoff_id string, session_id string, customer_snapshot string, recommended_products string,"
        " conversation_summary string, priority string, created_at string, assigned_se string"
    ),
}

AGENT_HANDOFFS = _struct(
    "handoff_id string, session_id string, customer_name string, skill_level string, primary_instrument string,"
    " use_case string, budget_range string, existing_gear string, recommended_products string,"
    " conversation_summary string, priority string, status string, claimed_by string, claimed_at timestamp,"
    " created_at timestamp"
)

CHAT_TRANSCRIPTS = _struct("session_id string, page_no bigint, messages string, updated_at timestamp")

VECTOR_METADATA = (
    "struct<product_id:string,name:string,brand:string,category:string,price:double,"
    "skill_level:string,use_case:string,type:string>"
)
