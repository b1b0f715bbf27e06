"""The sales handoff queue: new rows, queue views, metrics, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fretwork.functions.jsonio import id_text
from fretwork.functions.keys import stable_id
from fretwork.functions.text import ellipsis, lookup, or_default
from fretwork.schemas import AGENT_HANDOFFS
from fretwork.sources.keyed import with_defaults

# Labels of priorities and states, and what stands for the unknown.
PRIORITY_ICON = {"high": "🔴", "medium": "🟡", "low": "🟢"}
PRIORITY_COLOR = {"high": "#e74c3c", "medium": "#f39c12", "low": "#2ecc71"}
STATUS_LABEL = {"new": "🆕 NEW", "claimed": "👤 IN PROGRESS", "closed": "✅ CLOSED"}
UNKNOWN_ICON, UNKNOWN_COLOR = "⚪", "#888"
NEW_ICON, TAKEN_ICON = "🆕", "👤"


def new_handoffs(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows to append to the queue, always with status "new".

    ``requests``: request_key (unique per request), the customer columns, recommended_product_ids (array),
    conversation_summary, priority (default "medium"). The ids derive from request_key, so a repeated
    write yields the same rows.
    """
    rows = requests.withColumns(
        {
            "handoff_id": stable_id("H-", F.lit("handoff"), F.col("request_key")),
            "session_id": stable_id("S-", F.lit("session"), F.col("request_key")),
            "recommended_products": F.to_json("recommended_product_ids"),
            "status": F.lit("new"),
            "created_at": F.current_timestamp() if now is None else now,
        }
    )
    return with_defaults(rows, AGENT_HANDOFFS, {"priority": F.lit("medium")})


def claim(handoffs: DataFrame, claims: DataFrame) -> DataFrame:
    """New row versions for ``claims`` (handoff_id, claimed_by, claimed_at)."""
    return handoffs.drop("status", "claimed_by", "claimed_at").join(claims, "handoff_id").withColumn(
        "status", F.lit("claimed")
    )


def close(handoffs: DataFrame, closings: DataFrame) -> DataFrame:
    """New row versions for ``closings`` (handoff_id)."""
    return handoffs.join(closings.select("handoff_id"), "handoff_id", "left_semi").withColumn("status", F.lit("closed"))


def priority_rank() -> Column:
    return F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)


def handoff_queue(handoffs: DataFrame) -> DataFrame:
    """All handoffs, urgent first, then newest first."""
    return handoffs.withColumn("priority_rank", priority_rank()).orderBy(
        "priority_rank", F.col("created_at").desc_nulls_last(), "handoff_id"
    )


def latest_handoffs(handoffs: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` handoffs as short lines."""
    newest = handoffs.orderBy(F.col("created_at").desc_nulls_last(), "handoff_id").limit(n)
    return newest.select(
        "handoff_id",
        "customer_name",
        lookup(F.col("priority"), PRIORITY_ICON, UNKNOWN_ICON).alias("badge"),
        F.when(F.col("status") == "new", NEW_ICON).otherwise(TAKEN_ICON).alias("status_icon"),
        "created_at",
        ellipsis(F.col("conversation_summary"), 120).alias("summary"),
    )


def queue_cards(handoffs: DataFrame) -> DataFrame:
    """Texts of the queue page, with the defaults for missing values."""
    dash = {c: or_default(F.col(c), "—").alias(c) for c in ["skill_level", "primary_instrument", "use_case", "budget_range"]}
    return handoffs.select(
        "handoff_id",
        or_default(F.col("customer_name"), "Unknown").alias("title_name"),
        or_default(F.col("customer_name"), "—").alias("customer_name"),
        *dash.values(),
        or_default(F.col("existing_gear"), "None mentioned").alias("existing_gear"),
        or_default(F.col("conversation_summary"), "No summary available.").alias("summary"),
        id_text(F.col("recommended_products")).alias("recommended"),
        lookup(F.col("priority"), PRIORITY_ICON, UNKNOWN_ICON).alias("icon"),
        lookup(F.col("priority"), PRIORITY_COLOR, UNKNOWN_COLOR).alias("color"),
        lookup(F.col("status"), STATUS_LABEL, F.col("status")).alias("status_label"),
        ((F.col("status") == "new") & (F.col("priority") == "high")).alias("expanded"),
    )


def queue_counts() -> list[Column]:
    """Counters of the metrics row; they can be grouped by anything."""
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "new").alias("new"),
        F.count_if(status == "claimed").alias("claimed"),
        F.count_if(status == "closed").alias("closed"),
        F.count_if((status == "new") & (F.col("priority") == "high")).alias("urgent"),
    ]


def handoff_metrics(handoffs: DataFrame) -> DataFrame:
    return handoffs.agg(*queue_counts())


def workload(recommendations: DataFrame) -> DataFrame:
    """Handoffs per engineer, priority and day, with subtotals (NULL stands for "all")."""
    return recommendations.rollup("assigned_se", "priority", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n_handoffs")
    )



def fold_lifecycle(events: DataFrame) -> DataFrame:
    """State of every created handoff after ``events``; only legal moves count.

    ``events``: handoff_id, event (create, claim, close), se, event_at, seq (unique, breaks ties). A handoff is
    created once; the first claim after that counts; the first closing after that by the same engineer
    counts. Every step is a plain minimum per handoff, which Spark combines before the shuffle, so no task walks
    through all events of one handoff.
    """

    def step(kind: str) -> DataFrame:
        return events.where(F.col("event") == kind).withColumn("_at", F.struct("event_at", "seq", "se"))

    moves = step("create").groupBy("handoff_id").agg(F.min("_at").alias("_created"))
    for kind, done, since, more in [
        ("claim", "_claimed", "_created", F.lit(True)),
        ("close", "_closed", "_claimed", F.col("_at.se") == F.col("_since.se")),
    ]:
        after = (
            step(kind)
            .join(moves.select("handoff_id", F.col(since).alias("_since")), "handoff_id")
            .where((F.struct("_at.event_at", "_at.seq") > F.struct("_since.event_at", "_since.seq")) & more)
        )
        found = after.groupBy("handoff_id").agg(F.min("_at").alias(done))
        moves = moves.join(found, "handoff_id", "left")
    status = F.when(F.col("_closed").isNotNull(), "closed").when(F.col("_claimed").isNotNull(), "claimed").otherwise("new")
    return moves.select(
        "handoff_id",
        status.alias("status"),
        F.col("_claimed.se").alias("claimed_by"),
        F.col("_created.event_at").alias("created_at"),
        F.col("_claimed.event_at").alias("claimed_at"),
        F.col("_closed.event_at").alias("closed_at"),
    )
