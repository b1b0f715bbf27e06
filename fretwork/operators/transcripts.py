"""Chat transcripts: pack turns to JSON pages, read them back, escalation state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fretwork.functions.jsonio import messages
from fretwork.functions.text import asks_for_human
from fretwork.sources.keyed import latest

# Turns per stored page. Nearly all sessions fit in page 0; an endless one becomes many bounded rows.
PAGE_TURNS = 1000

SHOWN_ROLES = ["user", "assistant"]


def pack_messages(turns: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """Transcript rows (session_id, page_no, messages) from session_id, turn, role, content, product_ids.

    ``turn`` is unique in its session. Messages without products carry no ``product_ids`` entry.
    """
    message = F.struct("turn", "role", "content", "product_ids")
    pages = turns.groupBy("session_id", F.floor(F.col("turn") / page_turns).alias("page_no")).agg(
        F.sort_array(F.collect_list(message)).alias("_messages")
    )
    stored = F.transform("_messages", lambda m: F.struct(m["role"], m["content"], m["product_ids"]))
    return pages.select("session_id", "page_no", F.to_json(stored).alias("messages"))


def latest_transcripts(pages: DataFrame, version: str, write: str | None = None) -> DataFrame:
    """The pages of each session's highest version, and no others.

    A save replaces the whole transcript: all its pages carry its version, whenever they arrive, and pages of an older
    version go even where the new one has fewer. ``write`` numbers the writes; the last one of a page counts.
    """
    newest = pages.groupBy("session_id").agg(F.max(version).alias("_newest"))
    both = pages.join(newest, "session_id").where(F.col(version).eqNullSafe(F.col("_newest"))).drop("_newest")
    return latest(both, ["session_id", "page_no"], [write or version])


def unpack_messages(transcripts: DataFrame, all_roles: bool = False) -> DataFrame:
    """One row per message: session_id, page_no, position (in its page), role, content, product_ids.

    Only what the customer and the advisor said, unless ``all_roles``.
    """
    rows = transcripts.select("session_id", "page_no", F.posexplode(messages(F.col("messages"))).alias("position", "_m"))
    rows = rows.select("session_id", "page_no", "position", "_m.role", "_m.content", "_m.product_ids")
    return rows if all_roles else rows.where(F.col("role").isin(SHOWN_ROLES))


def with_transcripts(handoffs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Each handoff with the transcript pages of its session; without any, one row with NULLs."""
    return handoffs.join(transcripts.select("session_id", "page_no", "messages"), "session_id", "left")


def escalation_state(turns: DataFrame, whole_words: bool = False) -> DataFrame:
    """Per session: did the customer ask for a human on the last turn that created a handoff?

    ``turns``: session_id, turn, message, handoff_created. Other turns leave the state as it was; a session
    without a handoff is not escalated.
    """
    asks = asks_for_human(F.col("message"), whole_words=whole_words)
    at_handoff = F.when(F.col("handoff_created"), F.struct("turn", asks.alias("asks")))
    return turns.groupBy("session_id").agg(F.coalesce(F.max(at_handoff)["asks"], F.lit(False)).alias("escalated"))
