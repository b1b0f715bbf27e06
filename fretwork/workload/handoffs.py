"""Handoff queue over the given tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from fretwork.functions.ranking import running_total
from fretwork.operators import handoffs, transcripts
from fretwork.plans import marts
from fretwork.schemas import AGENT_HANDOFFS
from fretwork.session import scratch_dir
from fretwork.sources import keyed
from fretwork.sources.keyed import upsert
from fretwork.workload import chat, shop

TIME = "yyyy-MM-dd HH:mm:ss"


def as_time(name: str):
    return F.date_format(name, TIME).alias(name)


def handoff_requests(spark, sf_dir):
    customers = shop.raw_customers(spark, sf_dir)
    return customers.select(
        F.col("customer_id").alias("request_key"),
        F.col("last_name").alias("customer_name"),
        "skill_level",
        "primary_instrument",
        "use_case",
        "budget_range",
        F.array(F.lit("P1"), F.col("customer_id")).alias("recommended_product_ids"),
        F.concat(F.lit("Wants "), "primary_instrument").alias("conversation_summary"),
        F.when(F.col("budget_range") == "2000+", "high").alias("priority"),
    )


def handoff_table(spark, sf_dir):
    """A table created where absent, twice, then appended to, twice with the same requests: each stands once, made just now."""
    path = scratch_dir(spark, "handoffs")
    before = F.lit(datetime.datetime.now(datetime.timezone.utc)).cast("timestamp")
    for _ in range(2):
        keyed.create_if_absent(spark, path, AGENT_HANDOFFS)
        keyed.append(handoffs.new_handoffs(handoff_requests(spark, sf_dir)), path)
    rows = keyed.read(spark, path, AGENT_HANDOFFS, ["handoff_id"], ["created_at"])
    made_now = F.col("created_at").between(before, F.current_timestamp())
    return rows.select("handoff_id", "customer_name", "status", "priority", made_now.alias("made_now"))


def handoff_append(spark, sf_dir):
    """One new handoff per customer; the ids are digests, the same on every run."""
    requests = handoff_requests(spark, sf_dir)
    rows = handoffs.new_handoffs(requests, F.to_timestamp(F.lit("2024-06-01 10:00:00")))
    return rows.withColumns({"claimed_at": F.date_format("claimed_at", TIME), "created_at": F.date_format("created_at", TIME)})


def handoff_queue(spark, sf_dir):
    """The queue with the place of every handoff within its priority."""
    queue = handoffs.handoff_queue(shop.agent_handoffs(spark, sf_dir))
    newest_first = F.lit(1 << 40) - F.coalesce(F.unix_timestamp("created_at"), F.lit(0))
    queue = queue.withColumn("_at", newest_first).withColumn("_one", F.lit(1).cast("bigint"))
    queue = running_total(queue, ["priority_rank"], "_at", "_one", "position", [F.col("created_at").desc_nulls_last(), F.col("handoff_id")])
    return queue.select(
        "position",
        "handoff_id", "session_id", "customer_name", "priority", F.col("priority_rank").cast("bigint").alias("priority_rank"),
        "status", "claimed_by", as_time("claimed_at"), as_time("created_at"),
    )


def handoff_metrics(spark, sf_dir):
    return handoffs.handoff_metrics(shop.agent_handoffs(spark, sf_dir))


def handoff_latest5(spark, sf_dir):
    newest = handoffs.latest_handoffs(shop.agent_handoffs(spark, sf_dir))
    return newest.withColumn("created_at", F.date_format("created_at", TIME))


def handoff_cards(spark, sf_dir):
    return handoffs.queue_cards(shop.agent_handoffs(spark, sf_dir))


def handoff_updates(spark, sf_dir):
    """Claims and closings as new row versions: open urgent handoffs are claimed, claimed ones closed."""
    queue = shop.agent_handoffs(spark, sf_dir).withColumn("version", F.lit(1))
    urgent = queue.where("status = 'new' and priority = 'high'")
    claims = urgent.select("handoff_id", F.lit("Engineer X").alias("claimed_by"), F.col("created_at").alias("claimed_at"))
    closings = queue.where("status = 'claimed'")
    changed = handoffs.claim(queue, claims).unionByName(handoffs.close(queue, closings)).withColumn("version", F.lit(2))
    table = upsert(queue, changed, ["handoff_id"], ["version"])
    return table.select("handoff_id", "status", "claimed_by", as_time("claimed_at"), "version")


def queue_with_transcripts(spark, sf_dir):
    """Every handoff with the transcript of its session, for the sessions that left one."""
    stored = transcripts.pack_messages(chat.turns(spark, sf_dir))
    stored = stored.withColumn("session_id", F.concat(F.lit("S"), F.col("session_id").cast("string")))
    queue = shop.agent_handoffs(spark, sf_dir)
    return transcripts.with_transcripts(queue, stored).select(
        "handoff_id", "session_id", "page_no", F.length("messages").cast("bigint").alias("n_chars")
    )


def lifecycle_events(spark, sf_dir):
    return lifecycle_events_of(shop.table(spark, sf_dir, "events"))


def lifecycle_events_of(events):
    """A user's events as moves of one handoff: signup creates, click claims, purchase closes."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kinds = {"signup": "create", "click": "claim", "purchase": "close"}
    pairs = [F.lit(x) for item in kinds.items() for x in item]
    return events.select(
        F.col("user_id").alias("handoff_id"),
        F.try_element_at(F.create_map(*pairs), F.col("event_type")).alias("event"),
        F.concat(F.lit("Engineer "), (k % 5).cast("string")).alias("se"),
        F.col("ts").alias("event_at"),
        F.col("event_id").alias("seq"),
    )


def handoff_state_fold(spark, sf_dir):
    state = handoffs.fold_lifecycle(lifecycle_events(spark, sf_dir))
    return state_text(state)


def state_text(state):
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ["created_at", "claimed_at", "closed_at"]]
    return state.select("handoff_id", "status", "claimed_by", *times)


def workload_by_day(spark, sf_dir):
    facts = marts.fct_recommendations(shop.raw_se_handoffs(spark, sf_dir))
    load = handoffs.workload(facts)
    return load.withColumn("day", F.col("day").cast("string"))


QUERIES = {
    "handoff_append": handoff_append,
    "handoff_table": handoff_table,
    "handoff_queue": handoff_queue,
    "handoff_metrics": handoff_metrics,
    "handoff_latest5": handoff_latest5,
    "handoff_cards": handoff_cards,
    "handoff_updates": handoff_updates,
    "queue_with_transcripts": queue_with_transcripts,
    "handoff_state_fold": handoff_state_fold,
    "workload_by_day": workload_by_day,
}

_T = "'%Y-%m-%d %H:%M:%S'"
_QUEUE = shop.with_sql("agent_handoffs")


def _label(table, key, default):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def _default(column, text):
    return f"CASE WHEN coalesce({column}, '') = '' THEN '{text}' ELSE {column} END"


STATE_SQL = """WITH moves AS (
  SELECT user_id AS id, event_type AS e, ts, event_id AS seq,
         'Engineer ' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS se FROM events),
 created AS (SELECT id, min((ts, seq)) AS at FROM moves WHERE e = 'signup' GROUP BY id),
 claimed AS (SELECT m.id, min((m.ts, m.seq, m.se)) AS at FROM moves m JOIN created c USING (id)
             WHERE m.e = 'click' AND (m.ts, m.seq) > c.at GROUP BY m.id),
 closed AS (SELECT m.id, min((m.ts, m.seq)) AS at FROM moves m JOIN claimed c USING (id)
            WHERE m.e = 'purchase' AND m.se = c.at[3] AND (m.ts, m.seq) > (c.at[1], c.at[2]) GROUP BY m.id)
 SELECT id AS handoff_id,
        CASE WHEN closed.at IS NOT NULL THEN 'closed' WHEN claimed.at IS NOT NULL THEN 'claimed' ELSE 'new' END AS status,
        claimed.at[3] AS claimed_by, strftime(created.at[1], '%Y-%m-%d %H:%M:%S.%f') AS created_at,
        strftime(claimed.at[1], '%Y-%m-%d %H:%M:%S.%f') AS claimed_at,
        strftime(closed.at[1], '%Y-%m-%d %H:%M:%S.%f') AS closed_at
 FROM created LEFT JOIN claimed USING (id) LEFT JOIN closed USING (id)"""

ORACLE = {
    "handoff_append": shop.with_sql("raw_customers")
    + """ SELECT 'H-' || upper(substr(sha256('["handoff","' || customer_id || '"]'), 1, 16)) AS handoff_id,
             'S-' || upper(substr(sha256('["session","' || customer_id || '"]'), 1, 16)) AS session_id,
             last_name AS customer_name, skill_level, primary_instrument, use_case, budget_range,
             CAST(NULL AS VARCHAR) AS existing_gear, '["P1","' || customer_id || '"]' AS recommended_products,
             'Wants ' || primary_instrument AS conversation_summary,
             CASE WHEN budget_range = '2000+' THEN 'high' ELSE 'medium' END AS priority, 'new' AS status,
             CAST(NULL AS VARCHAR) AS claimed_by, CAST(NULL AS VARCHAR) AS claimed_at,
             '2024-06-01 10:00:00' AS created_at FROM raw_customers""",
    "handoff_table": shop.with_sql("raw_customers")
    + """ SELECT 'H-' || upper(substr(sha256('["handoff","' || customer_id || '"]'), 1, 16)) AS handoff_id, last_name AS customer_name,
             'new' AS status, CASE WHEN budget_range = '2000+' THEN 'high' ELSE 'medium' END AS priority, true AS made_now FROM raw_customers""",
    "handoff_queue": _QUEUE
    + f""" SELECT row_number() OVER (PARTITION BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END
                                    ORDER BY created_at DESC NULLS LAST, handoff_id) AS position,
             handoff_id, session_id, customer_name, priority,
             CAST(CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS BIGINT) AS priority_rank, status,
             claimed_by, strftime(claimed_at, {_T}) AS claimed_at, strftime(created_at, {_T}) AS created_at
           FROM agent_handoffs""",
    "handoff_metrics": _QUEUE
    + """ SELECT count(*) AS total, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'claimed') AS claimed,
             count(*) FILTER (status = 'closed') AS closed,
             count(*) FILTER (status = 'new' AND priority = 'high') AS urgent FROM agent_handoffs""",
    "handoff_latest5": _QUEUE
    + f""" SELECT handoff_id, customer_name, {_label(handoffs.PRIORITY_ICON, "priority", "'⚪'")} AS badge,
             CASE WHEN status = 'new' THEN '🆕' ELSE '👤' END AS status_icon, strftime(created_at, {_T}) AS created_at,
             conversation_summary AS summary
           FROM agent_handoffs ORDER BY agent_handoffs.created_at DESC, handoff_id LIMIT 5""",
    "handoff_cards": _QUEUE
    + f""" SELECT handoff_id, {_default("customer_name", "Unknown")} AS title_name,
             {_default("customer_name", "—")} AS customer_name, skill_level, primary_instrument, use_case, budget_range,
             {_default("existing_gear", "None mentioned")} AS existing_gear, conversation_summary AS summary,
             CASE WHEN recommended_products LIKE '[%' THEN
               array_to_string(CAST(json(recommended_products) AS VARCHAR[]), ', ') ELSE '' END AS recommended,
             {_label(handoffs.PRIORITY_ICON, "priority", "'⚪'")} AS icon,
             {_label(handoffs.PRIORITY_COLOR, "priority", "'#888'")} AS color,
             {_label(handoffs.STATUS_LABEL, "status", "status")} AS status_label,
             status = 'new' AND priority = 'high' AS expanded FROM agent_handoffs""",
    "handoff_updates": _QUEUE
    + f""" SELECT handoff_id, CASE WHEN status = 'claimed' THEN 'closed'
                    WHEN status = 'new' AND priority = 'high' THEN 'claimed' ELSE status END AS status,
             CASE WHEN status = 'new' AND priority = 'high' THEN 'Engineer X' ELSE claimed_by END AS claimed_by,
             strftime(CASE WHEN status = 'new' AND priority = 'high' THEN created_at ELSE claimed_at END, {_T}) AS claimed_at,
             CASE WHEN status = 'claimed' OR (status = 'new' AND priority = 'high') THEN 2 ELSE 1 END AS version
           FROM agent_handoffs""",
    "queue_with_transcripts": _QUEUE
    + f""", stored AS (
        SELECT 'S' || CAST(conv_id AS VARCHAR) AS session_id, turn // 1000 AS page_no,
               length('[' || string_agg(CASE WHEN role = 'assistant'
                 THEN CAST(json_object('role', role, 'content', text, 'product_ids', [{shop.sql_product_key("turn")}]) AS VARCHAR)
                 ELSE CAST(json_object('role', role, 'content', text) AS VARCHAR) END, ',') || ']') AS n_chars
        FROM conversations GROUP BY ALL)
      SELECT handoff_id, h.session_id, page_no, n_chars FROM agent_handoffs h LEFT JOIN stored USING (session_id)""",
    "handoff_state_fold": STATE_SQL,
    "workload_by_day": f"""
      SELECT assigned_se, priority, day, count(*) AS n_handoffs FROM (
        SELECT 'Engineer ' || CAST(o_custkey % 7 AS VARCHAR) AS assigned_se,
               {shop._sql_map(shop.HANDOFF_PRIORITY, "o_orderpriority")} AS priority,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders)
      GROUP BY ROLLUP (assigned_se, priority, day)""",
}
