"""Transcripts, recommendation lists and text checks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fretwork.functions import text
from fretwork.operators import recommendations, transcripts
from fretwork.operators.phrases import phrase_hits
from fretwork.session import scratch_dir
from fretwork.sources import variants
from fretwork.workload import shop

# Phrases that the checks look for.
ALL_OF = ["la", "er"]
ANY_OF = ["tion the", "schung", "mente la"]
NONE_OF = ["license", "mail", "the the"]


def turns(spark, sf_dir):
    return shop.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        "turn",
        "role",
        F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.array(shop.product_key(F.col("turn")))).alias("product_ids"),
    )


def transcript_pack(spark, sf_dir):
    return transcripts.pack_messages(turns(spark, sf_dir))


def transcript_rows(spark, sf_dir):
    """Packed to JSON, read back, only what customer and advisor said."""
    rows = transcripts.unpack_messages(transcripts.pack_messages(turns(spark, sf_dir), page_turns=4))
    return rows.select(
        "session_id", "page_no", F.col("position").cast("bigint").alias("position"), "role", "content",
        F.array_join("product_ids", ",").alias("product_ids"),
    )


def variant_messages(spark, sf_dir):
    """Transcript pages loaded with their messages parsed once; read by path, only what customer and advisor said."""
    pages = transcripts.pack_messages(turns(spark, sf_dir), page_turns=4)
    rows = variants.message_rows(variants.load_json(pages, ["messages"], scratch_dir(spark, "transcript-json")))
    return rows.where(F.col("role").isin(transcripts.SHOWN_ROLES)).select(
        "session_id", "page_no", F.col("position").cast("bigint").alias("position"), "role", "content",
        F.array_join("product_ids", ",").alias("product_ids"),
    )


def transcript_versions(spark, sf_dir):
    """Two versions of the transcripts, in pages of four turns: all turns, then the first three of every other session."""
    every = turns(spark, sf_dir)
    return [transcripts.pack_messages(rows, page_turns=4) for rows in (every, every.where("session_id % 2 = 0 and turn < 3"))]


def transcript_upsert(spark, sf_dir):
    """Stored transcripts, then a shorter version of every other one: the later version replaces the whole transcript."""
    stored, sent = (rows.withColumn("version", F.lit(n)) for n, rows in enumerate(transcript_versions(spark, sf_dir)))
    return transcript_totals(transcripts.latest_transcripts(stored.unionByName(sent), "version"))


def transcript_totals(table):
    per_session = transcripts.unpack_messages(table, all_roles=True).groupBy("session_id")
    return per_session.agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.length("content")).alias("n_chars"),
        F.count_if(F.col("role") == "system").alias("n_notes"),
    )


def escalation_flag(spark, sf_dir):
    """Every customer message, as substrings and as whole words."""
    message = F.col("text")
    return (
        shop.table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select(
            "conv_id",
            "turn",
            text.asks_for_human(message).alias("asks"),
            text.asks_for_human(message, whole_words=True).alias("asks_in_words"),
        )
    )


def escalation_state(spark, sf_dir):
    """State per session, a handoff being created on each customer message of more than 100 characters."""
    messages = shop.table(spark, sf_dir, "conversations").where("role = 'user'")
    handled = messages.select(
        F.col("conv_id").alias("session_id"),
        "turn",
        F.col("text").alias("message"),
        (F.length("text") > 100).alias("handoff_created"),
    )
    return transcripts.escalation_state(handled)


def calls(spark, sf_dir):
    """Events as tool calls: a user's day is a turn, a signup hands over, an error does nothing."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    value = F.floor("value")
    ids = F.array(*[shop.product_key(x) for x in (k % 10, value % 20, k % 10)])
    return shop.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("turn"),
        F.col("event_id").alias("call_no"),
        F.when(F.col("event_type") == "signup", "handoff")
        .when(F.col("event_type") == "error", "details")
        .otherwise("search")
        .alias("op"),
        ids.alias("ids"),
    )


def rec_list_capped(spark, sf_dir):
    lists = recommendations.recommendation_lists(calls(spark, sf_dir))
    return lists.select("session_id", "turn", F.array_join("product_ids", ",").alias("product_ids"))


def turn_card_stats(spark, sf_dir):
    return recommendations.turn_cards(recommendations.recommendation_lists(calls(spark, sf_dir)))


def session_card_stats(spark, sf_dir):
    cards = recommendations.turn_cards(recommendations.recommendation_lists(calls(spark, sf_dir)))
    return recommendations.session_cards(cards)


def price_mentions(spark, sf_dir):
    """Prices quoted in a summary of every order, and the two range checks on them."""
    total = F.col("o_totalprice")
    summary = F.concat(
        F.lit("Total $"), F.format_number(total.cast("decimal(18,2)"), 2), F.lit(", deposit $"),
        F.floor(total / 10).cast("string"), F.lit(", fee $ 5, code $,7."),
    )
    # Each column is a projection of its own, so that the prices are extracted once per row.
    quoted = shop.table(spark, sf_dir, "orders").select("o_orderkey", text.quoted_prices(summary).alias("prices"))
    hit = F.exists("prices", lambda p: p.between(F.lit(20000.0), F.lit(40000.0)))
    judged = quoted.select(
        "o_orderkey",
        F.size("prices").cast("bigint").alias("n_prices"),
        F.aggregate("prices", F.lit(0.0), lambda a, x: a + x).alias("total"),
        hit.alias("price_range_ok"),
    )
    return judged.withColumn("no_price_range_ok", ~F.col("price_range_ok"))


def phrase_checks(spark, sf_dir):
    """Missing and found phrases in the whole text of every document and chat message."""
    documents = shop.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), "text"
    )
    messages = shop.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text_id"), "text"
    )
    # One search per text for all phrases; the three lists are then read off its result.
    found = text.found_phrases(F.col("text"), text.phrase_array([*ALL_OF, *ANY_OF, *NONE_OF]))
    searched = documents.unionAll(messages).select("text_id", found.alias("found"))
    return searched.select(
        "text_id",
        F.array_join(F.array_except(text.phrase_array(ALL_OF), "found"), ",").alias("missing"),
        F.arrays_overlap(text.phrase_array(ANY_OF), "found").alias("any_found"),
        F.array_join(F.array_intersect(text.phrase_array(NONE_OF), "found"), ",").alias("forbidden"),
    )


def display_text(spark, sf_dir):
    """Texts as pages show them: escaped, cut, joined from parts."""
    body = F.concat(F.lit("$"), F.col("text"), F.lit(" $1"))
    return shop.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.length(text.escape_dollar(body)).cast("bigint").alias("escaped_length"),
        text.ellipsis(F.col("text"), 120).alias("short"),
        text.head(F.col("text"), 30).alias("head"),
        text.join_parts(F.array(F.lit("  "), F.col("role"), F.lit(None), F.lit(": "), F.lit(""), F.lit("x "))).alias("joined"),
    )


def phrase_scan(spark, sf_dir):
    """Every longer word of the benchmark items as a phrase: in how many chat turns it stands, and in how many conversations."""
    words = F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("phrase")
    phrases = shop.table(spark, sf_dir, "benchmark").select(words).where("length(phrase) >= 4").distinct()
    turns = shop.table(spark, sf_dir, "conversations")
    texts = turns.select(F.struct("conv_id", "turn").alias("at"), "text")
    texts = texts.select(F.concat_ws(":", F.col("at.conv_id").cast("string"), F.col("at.turn").cast("string")).alias("text_id"), "text")
    hits = phrase_hits(texts, phrases.select(F.col("phrase").alias("phrase_id"), "phrase"))
    per_conv = hits.groupBy("phrase_id", F.substring_index("text_id", ":", 1).alias("conv")).agg(F.count(F.lit(1)).alias("n"))
    found = per_conv.groupBy(F.col("phrase_id").alias("phrase"))
    return found.agg(F.sum("n").alias("n_turns"), F.count(F.lit(1)).alias("n_conversations"))


QUERIES = {
    "phrase_scan": phrase_scan,
    "transcript_pack": transcript_pack,
    "transcript_rows": transcript_rows,
    "variant_messages": variant_messages,
    "transcript_upsert": transcript_upsert,
    "escalation_flag": escalation_flag,
    "escalation_state": escalation_state,
    "rec_list_capped": rec_list_capped,
    "turn_card_stats": turn_card_stats,
    "session_card_stats": session_card_stats,
    "price_mentions": price_mentions,
    "phrase_checks": phrase_checks,
    "display_text": display_text,
}

_ASKS = " OR ".join(f"contains(lower(text), '{p}')" for p in text.ESCALATION_PHRASES)
_WORDS = r"\b(" + "|".join(text.ESCALATION_PHRASES) + r")\b"

_LISTS = f"""WITH calls AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS turn, event_id,
         CASE event_type WHEN 'signup' THEN 'handoff' WHEN 'error' THEN 'details' ELSE 'search' END AS op,
         [{shop.sql_product_key("k % 10")}, {shop.sql_product_key("v % 20")}, {shop.sql_product_key("k % 10")}] AS ids
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events)),
 marks AS (SELECT user_id, turn, max(event_id) FILTER (op <> 'details') AS last_call,
                  max(event_id) FILTER (op = 'handoff') AS handoff FROM calls GROUP BY ALL),
 entries AS (SELECT user_id, turn, event_id, unnest(ids) AS id, unnest([1, 2, 3]) AS pos
             FROM calls JOIN marks USING (user_id, turn) WHERE op <> 'details' AND event_id >= coalesce(handoff, -1)),
 firsts AS (SELECT user_id, turn, id, min(event_id * 10 + pos) AS place FROM entries GROUP BY ALL),
 kept AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY user_id, turn ORDER BY place) <= 3),
 folded AS (SELECT user_id, turn, list(id ORDER BY place) AS ids FROM kept GROUP BY ALL),
 lists AS (SELECT m.user_id AS session_id, m.turn,
                  CASE WHEN m.handoff = m.last_call THEN c.ids ELSE coalesce(f.ids, []) END AS ids
           FROM marks m LEFT JOIN folded f USING (user_id, turn)
           LEFT JOIN calls c ON c.user_id = m.user_id AND c.turn = m.turn AND c.event_id = m.handoff),
 cards AS (SELECT session_id, turn, len(ids) AS n_ids, len(list_distinct(ids)) AS n_cards,
                  len(ids) <> len(list_distinct(ids)) AS has_duplicates FROM lists)"""


def _sql_found(phrases, sign=""):
    parts = [f"CASE WHEN {sign} contains(lower(text), '{p}') THEN '{p}' END" for p in phrases]
    return "concat_ws(',', " + ", ".join(parts) + ")"


TRANSCRIPTS_SQL = """
  SELECT conv_id AS session_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars,
         count(*) FILTER (role = 'system') AS n_notes
  FROM conversations c WHERE conv_id % 2 <> 0 OR turn < 3
    OR NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn < 3) GROUP BY 1"""

ORACLE = {
    "transcript_pack": f"""
      SELECT conv_id AS session_id, turn // 1000 AS page_no,
             '[' || string_agg(CASE WHEN role = 'assistant'
               THEN CAST(json_object('role', role, 'content', text, 'product_ids', [{shop.sql_product_key("turn")}]) AS VARCHAR)
               ELSE CAST(json_object('role', role, 'content', text) AS VARCHAR) END, ',' ORDER BY turn) || ']' AS messages
      FROM conversations GROUP BY ALL""",
    "transcript_rows": f"""
      SELECT * FROM (
        SELECT conv_id AS session_id, turn // 4 AS page_no,
               row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) - 1 AS position, role, text AS content,
               CASE WHEN role = 'assistant' THEN {shop.sql_product_key("turn")} END AS product_ids
        FROM conversations) WHERE role IN ('user', 'assistant')""",
    "transcript_upsert": TRANSCRIPTS_SQL,
    "escalation_flag": f"""
      SELECT conv_id, turn, {_ASKS} AS asks, regexp_matches(lower(text), '{_WORDS}') AS asks_in_words
      FROM conversations WHERE role = 'user'""",
    "escalation_state": f"""
      SELECT conv_id AS session_id, coalesce(arg_max({_ASKS}, turn) FILTER (length(text) > 100), false) AS escalated
      FROM conversations WHERE role = 'user' GROUP BY 1""",
    "rec_list_capped": _LISTS + " SELECT session_id, turn, array_to_string(ids, ',') AS product_ids FROM lists",
    "turn_card_stats": _LISTS + " SELECT * FROM cards",
    "session_card_stats": _LISTS
    + """ SELECT *, total_cards <> last_cards AND turns_with_cards > 1 AS several_turns_visible FROM (
            SELECT session_id, CAST(sum(n_cards) AS BIGINT) AS total_cards, count(*) FILTER (n_cards > 0) AS turns_with_cards,
                   bool_or(has_duplicates) AS has_duplicates, arg_max(n_cards, turn) AS last_cards
            FROM cards GROUP BY session_id)""",
    "price_mentions": """
      WITH quoted AS (
        SELECT o_orderkey, list_transform(regexp_extract_all('Total $' || format('{:,.2f}', o_totalprice) || ', deposit $'
                 || CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS VARCHAR) || ', fee $ 5, code $,7.',
                 '\\$(\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS p
        FROM orders)
      SELECT o_orderkey, len(p) AS n_prices, list_sum(p) AS total,
             len(list_filter(p, lambda x: x BETWEEN 20000 AND 40000)) > 0 AS price_range_ok,
             len(list_filter(p, lambda x: x BETWEEN 20000 AND 40000)) = 0 AS no_price_range_ok FROM quoted""",
    "phrase_scan": """
      WITH phrases AS (SELECT DISTINCT phrase FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS phrase FROM benchmark) WHERE length(phrase) >= 4)
      SELECT phrase, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations
      FROM phrases JOIN conversations ON contains(lower(text), phrase) GROUP BY phrase""",
    "phrase_checks": f"""
      SELECT text_id, {_sql_found(ALL_OF, "NOT")} AS missing, {_sql_found(ANY_OF)} <> '' AS any_found,
             {_sql_found(NONE_OF)} AS forbidden
      FROM (SELECT 'd' || CAST(doc_id AS VARCHAR) AS text_id, text FROM documents UNION ALL
            SELECT 'c-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations)""",
    "display_text": """
      SELECT conv_id, turn, length(replace('$' || text || ' $1', '$', '&#36;')) AS escaped_length,
             CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS short,
             substr(text, 1, 30) AS head, role || ': x' AS joined FROM conversations""",
}
ORACLE["variant_messages"] = ORACLE["transcript_rows"]
