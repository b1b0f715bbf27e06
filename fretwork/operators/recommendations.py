"""Recommendation lists of chat turns and the cards shown for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fretwork.functions.ranking import top_k
from fretwork.session import materialize

TURN = ["session_id", "turn"]


def recommendation_lists(calls: DataFrame, k: int = 3) -> DataFrame:
    """The product list that each turn ends with: session_id, turn, product_ids.

    ``calls``: session_id, turn, call_no (unique in its turn), op, ids. A search adds its ids to the list, first
    mention first, cut to ``k``. A handoff replaces the list with its own ids as they are. Other calls change
    nothing. Ids are reduced to their first mention, then to ``k`` per turn, before any list is built, so
    a turn with very many calls stays cheap.
    """
    calls = materialize(calls.select(*TURN, "call_no", "op", "ids"), "calls")  # read twice, however the calls are made
    acting = F.col("op").isin("search", "handoff")
    handoff = F.col("op") == "handoff"
    per_turn = calls.groupBy(*TURN).agg(
        F.max(F.when(acting, F.col("call_no"))).alias("_last"),
        F.max(F.when(handoff, F.col("call_no"))).alias("_handoff"),
        F.max_by(F.when(handoff, F.col("ids")), F.when(handoff, F.col("call_no"))).alias("_handoff_ids"),
    )
    live = (
        calls.where(acting)
        .join(per_turn.select(*TURN, "_handoff"), TURN)
        .where(F.col("_handoff").isNull() | (F.col("call_no") >= F.col("_handoff")))
    )
    mentions = live.select(*TURN, "call_no", F.posexplode("ids").alias("_pos", "product_id"))
    first = mentions.groupBy(*TURN, "product_id").agg(F.min(F.struct("call_no", "_pos")).alias("_at"))
    kept = top_k(first, TURN, [F.col("_at")], k, "_rn")
    capped = kept.groupBy(*TURN).agg(F.sort_array(F.collect_list(F.struct("_rn", "product_id"))).alias("_kept"))
    folded = F.coalesce(F.transform("_kept", lambda e: e["product_id"]), F.array().cast("array<string>"))
    ends_with_handoff = F.col("_handoff") == F.col("_last")
    return per_turn.join(capped, TURN, "left").select(
        *TURN, F.when(ends_with_handoff, F.col("_handoff_ids")).otherwise(folded).alias("product_ids")
    )


def turn_cards(lists: DataFrame) -> DataFrame:
    """Cards per turn: listed ids, shown cards (distinct ids), whether an id is listed twice."""
    cards = F.size(F.array_distinct("product_ids"))
    return lists.select(
        *TURN,
        F.size("product_ids").cast("bigint").alias("n_ids"),
        cards.cast("bigint").alias("n_cards"),
        (F.size("product_ids") != cards).alias("has_duplicates"),
    )


def session_cards(cards: DataFrame) -> DataFrame:
    """Cards visible in a session's history, and whether they come from more than one turn."""
    totals = cards.groupBy("session_id").agg(
        F.sum("n_cards").alias("total_cards"),
        F.count_if(F.col("n_cards") > 0).alias("turns_with_cards"),
        F.bool_or("has_duplicates").alias("has_duplicates"),
        F.max_by("n_cards", "turn").alias("last_cards"),
    )
    several = (F.col("total_cards") != F.col("last_cards")) & (F.col("turns_with_cards") > 1)
    return totals.withColumn("several_turns_visible", several)
