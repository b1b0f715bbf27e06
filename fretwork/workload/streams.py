"""Streams over the given event and conversation tables, run to their end and read back."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fretwork.plans import staging
from fretwork.session import conf_scope, materialize, remove_folder, run_together, scratch_dir
from fretwork.sources.raw_files import write_csv
from fretwork.streaming import conversion, state
from fretwork.streaming import events as live
from fretwork.streaming.arrivals import file_audit, load_arrivals, read_arrivals
from fretwork.streaming.files import read_parquet_stream
from fretwork.workload import chat, checks, handoffs, shop

TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
# Rows of both conversion streams in one batch, about: they all stand in its state, at some 700 bytes each.
PART_ROWS = 500_000
# Rows of both conversion streams that one slice of the pairs may get within the horizon and the delay, about: a stream holds up to so many beside its batches.
HELD_ROWS = 500_000
# Cores for each slice that runs at the same time: the slices fill the gaps between each other's stages.
SLICE_CORES = 2
# Tasks of a slice's state, each with six stores to commit in a batch, however few rows they got.
SLICE_TASKS = 3
DAY = 24 * 3600 * 1_000_000
# Size of a row group in the files of a part, so that several tasks read one file.
BLOCK_BYTES = 4 * 1024 * 1024


def event_stream(spark, sf_dir):
    return read_parquet_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _dirs(spark, name):
    base = scratch_dir(spark, name)
    return f"{base}/table", f"{base}/checkpoint"


def stream_events_dedup(spark, sf_dir):
    """Every event delivered twice; each must be kept once."""
    path, checkpoint = _dirs(spark, "dedup")
    twice = event_stream(spark, sf_dir).unionByName(event_stream(spark, sf_dir))
    live.stream_dedup(twice, ["event_id"], "ts", "1 hour", path, checkpoint)
    kept = spark.read.parquet(path)
    return kept.select("event_id", "user_id", "event_type", "value", F.date_format("ts", TIME).alias("ts"))


def queue_events(rows):
    """Events as queue rows: the type gives the state, the value the priority."""
    status = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "click", "claimed").otherwise("closed")
    return rows.select("ts", status.alias("status"), F.when(F.col("value") >= 20, "high").otherwise("low").alias("priority"))


def stream_queue_metrics(spark, sf_dir):
    path, checkpoint = _dirs(spark, "metrics")
    live.stream_queue_metrics(queue_events(event_stream(spark, sf_dir)), "ts", "1 hour", "10 minutes", path, checkpoint)
    last = state.latest(spark.read.parquet(path), ["window_start"], ["batch_id"])
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ["window_start", "window_end"]}
    return last.drop("batch_id").withColumns(times)


def stream_lifecycle(spark, sf_dir):
    """All moves in two deliveries, each up to 20 hours late and so out of order over them; the stream runs after each one.

    A day's delay passes them all, and the watermark passes most of the table, so that closed handoffs leave the state.
    """
    path, checkpoint = _dirs(spark, "lifecycle")
    arriving = scratch_dir(spark, "moves")
    late = F.make_dt_interval(secs=F.pmod(F.xxhash64("seq"), F.lit(20 * 3600)).cast("decimal(18,6)"))
    moves = handoffs.lifecycle_events(spark, sf_dir).withColumn("event_at", F.col("event_at").cast("timestamp"))
    moves = moves.withColumn("_at", F.unix_micros(F.col("event_at") + late))
    borders = moves.agg(F.percentile_approx("_at", [0.6]).alias("b")).first()["b"] or []
    part = sum((F.col("_at") > b).cast("int") for b in borders) if borders else F.lit(0)
    for i in range(len(borders) + 1):
        moves.where(part == i).drop("_at").write.mode("append").parquet(arriving)
        state.stream_lifecycle(read_parquet_stream(spark, arriving), path, checkpoint, "1 day")
    return handoffs.state_text(state.read_lifecycle(spark.read.parquet(path)))


def stream_sessions(spark, sf_dir):
    """Sessions of a user with a gap of two hours; those still open at the end of the stream are not out yet."""
    path, checkpoint = _dirs(spark, "sessions")
    live.stream_sessions(event_stream(spark, sf_dir), "user_id", "ts", "2 hours", "1 hour", path, checkpoint)
    return _session_text(spark.read.parquet(path))


def sessions_batch(spark, sf_dir):
    """All sessions, from the table."""
    rows = shop.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _session_text(live.sessions(rows, "user_id", "ts", "2 hours", "1 hour"))


def _session_text(rows):
    times = {c: F.date_format(c, TIME) for c in ["session_start", "session_end", "last_event"]}
    return rows.withColumns(times)


def stream_transcripts(spark, sf_dir):
    """Two versions of the transcripts arrive as a stream in four batches, the shorter one first; the later one stays."""
    path, checkpoint = _dirs(spark, "transcripts")
    arriving = scratch_dir(spark, "arriving")
    for hour, version in reversed(list(enumerate(chat.transcript_versions(spark, sf_dir)))):
        at = F.to_timestamp(F.lit(f"2024-01-01 0{hour}:00:00"))
        # Two files, so that the pages of a session come in different batches.
        version.withColumn("updated_at", at).repartition(2, "page_no").write.mode("append").parquet(arriving)
    state.stream_transcripts(read_parquet_stream(spark, arriving, max_files=1), path, checkpoint)
    return chat.transcript_totals(state.read_transcripts(spark.read.parquet(path)))


def _per_day(arrivals, border, *keys):
    """Rows a day of arrival (``_at``) up to the border (``_side`` 0) and after it (1), for each of the keys."""
    side = F.lit(0) if border is None else (F.col("_at") > border).cast("int")
    groups = [*keys, side.alias("_side"), F.floor(F.col("_at") / DAY).alias("_day")]
    return materialize(arrivals.where("_at is not null").groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")), "days")


def slices_needed(per_day, days):
    """Slices of the pairs, so that none gets more than about ``HELD_ROWS`` rows within so many days."""
    totals = per_day.groupBy("_day").agg(F.sum("_n").alias("_n"))
    within = F.sum("_n").over(Window.orderBy("_day").rangeBetween(-days, Window.currentRow))
    return -(-(totals.select(within.alias("_n")).agg(F.max("_n").alias("m")).first()["m"] or 1) // HELD_ROWS)


def day_cuts(per_day, border):
    """Times of arrival that end parts of about ``PART_ROWS`` rows each, in order; ``border`` is one of them unless it is None."""
    counts = {r["_side"]: r["n"] for r in per_day.groupBy("_side").agg(F.sum("_n").alias("n")).collect()}
    parts = {side: -(-n // PART_ROWS) for side, n in counts.items()}
    shares = {side: [i / n for i in range(1, n)] for side, n in parts.items() if n > 1}
    inner = [F.percentile(F.when(F.col("_side") == side, F.col("_day")), share, F.col("_n")).alias(f"c{side}") for side, share in shares.items()]
    found = per_day.agg(*inner).first() if inner else []
    cuts = {(math.floor(day) + 1) * DAY - 1 for share in found for day in share}
    if border is None:
        return sorted(cuts)
    # The border may stand within a day, whose end is then no cut before it.
    return sorted({border, *[min(c, border) for c in cuts if c - DAY < border], *[c for c in cuts if c > border]})


def arrival_cuts(arrivals, border):
    """Cuts of ``day_cuts`` for rows that all belong to one slice."""
    return day_cuts(_per_day(arrivals, border), border)


def in_slices(rows, time, slices):
    """The rows with the slice of their pair and, in each slice, the last of all rows, so that the watermark of every slice comes as far as the whole stream.

    A pair's rows are all in its own slice; the one that is repeated in another finds there what it finds here or nothing.
    """
    own = rows.withColumn("_slice", F.pmod(F.xxhash64(F.lit("slice"), *conversion.PAIR), F.lit(slices)).cast("int"))
    end = rows.agg(F.max(time).alias("end")).first()["end"] if slices > 1 else None
    if end is None:
        return own
    last = materialize(rows.where(time == end).limit(1), "last")
    return own.unionByName(last.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))


def _arrive(rows, part, path):
    """One part as one file, also where it has no rows, so that the parts of both streams come in step."""
    rows = rows.where(F.col("_part") == part).drop("_slice", "_part")
    rows.coalesce(1).write.option("parquet.block.size", BLOCK_BYTES).mode("append").parquet(path)


def _convert(spark, parted, deliveries, path, checkpoint):
    """Both streams of one slice, run to their end after each delivery; its files and its state are not kept longer."""
    arrivals = [scratch_dir(spark, "arriving") for _ in parted]
    for delivery in deliveries:
        for part in delivery:
            run_together(*[functools.partial(_arrive, rows, part, folder) for rows, folder in zip(parted, arrivals, strict=True)])
        streams = [read_parquet_stream(spark, folder, max_files=1) for folder in arrivals]
        conversion.stream_conversions(*streams, "90 days", "1 day", path, checkpoint)
    for folder in (*arrivals, checkpoint):
        remove_folder(spark, folder)
    return spark.read.parquet(path)


def stream_conversion(spark, sf_dir):
    """Recommendations and orders as two streams in two deliveries, rows up to 20 hours late; those whose 90 days have passed.

    The split is by time of arrival, so a day's delay passes all rows. A large delivery comes as several files of either stream in that
    order, a file of each per batch, so that the state never holds a whole delivery. Where the rows of 90 days are too many to hold, the
    pairs are dealt out into slices, each a pair of streams with a state of its own; a few of them run at the same time.
    """
    path, checkpoint = _dirs(spark, "conversion")
    asked = materialize(checks.recommendations(spark, sf_dir), "recommendations")
    bought = materialize(staging.stg_orders(shop.raw_orders(spark, sf_dir)).select("order_id", *conversion.PAIR, "order_date"), "bought")
    border = asked.agg(F.percentile_approx(F.unix_micros("created_at"), 0.6).alias("b")).first()["b"]
    late = F.pmod(F.xxhash64(*conversion.PAIR), F.lit(20 * 3600)) * 1_000_000
    times = {"asked": F.unix_micros("created_at"), "bought": F.unix_micros(F.col("order_date").cast("timestamp"))}
    rows = {name: frame.withColumn("_at", times[name] + late) for name, frame in [("asked", asked), ("bought", bought)]}
    per_day = _per_day(rows["asked"].select("_at").unionByName(rows["bought"].select("_at")), border)
    slices = slices_needed(per_day, 91)
    rows = {name: in_slices(frame, times[name], slices) for name, frame in rows.items()}
    if slices > 1:
        of_slices = _per_day(rows["asked"].select("_slice", "_at").unionByName(rows["bought"].select("_slice", "_at")), border, "_slice")
        # The largest count of any slice on a day, so that no slice has a part much larger than the others.
        per_day = materialize(of_slices.groupBy("_side", "_day").agg(F.max("_n").alias("_n")), "days")
    cuts = day_cuts(per_day, border)
    part = sum((F.coalesce(F.col("_at") > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    parted = []
    for name, frame in [("asked", asked), ("bought", bought)]:
        folder = scratch_dir(spark, f"{name}-parts")
        rows[name].withColumn("_part", part).drop("_at").repartition("_slice", "_part").write.partitionBy("_slice", "_part").parquet(folder)
        places = [StructField(n, IntegerType()) for n in ("_slice", "_part")]
        parted.append(spark.read.schema(StructType([*frame.schema, *places])).parquet(folder))
    first = 0 if border is None else cuts.index(border)
    deliveries = [range(first + 1), range(first + 1, max(len(cuts), first + 1) + 1)]
    jobs = [
        functools.partial(_convert, spark, [p.where(F.col("_slice") == i) for p in parted], deliveries, f"{path}/{i}", f"{checkpoint}/{i}") for i in range(slices)
    ]
    # Few tasks for the small state of a slice, which is kept in memory once only; a single slice has all cores of a small cluster.
    cores = spark.sparkContext.defaultParallelism
    tasks = min(max(SLICE_TASKS, min(cores // slices, 2 * SLICE_TASKS)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    with conf_scope(spark, {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.streaming.maxBatchesToRetainInMemory": "1"}):
        tables = run_together(*jobs, at_once=max(1, cores // SLICE_CORES))
    settled = conversion.settled_before(asked, bought, "90 days", "1 day").first()["settled"]
    found = conversion.first_conversions(functools.reduce(DataFrame.unionByName, tables)).where(F.col("created_at") < F.lit(settled))
    return found.select(
        "customer_id", "product_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), F.col("converted_on").cast("string").alias("converted_on")
    )


def arriving_files(spark, sf_dir):
    """Order lines as CSV files in three deliveries by date; two runs of the load, the second after the third delivery has come."""
    arriving, out, checkpoint = (scratch_dir(spark, n) for n in ("csv-arriving", "arrived", "arrivals-checkpoint"))
    lines = shop.raw_orders(spark, sf_dir)
    parts = ["order_date < '1994-01-01'", "order_date >= '1994-01-01' and order_date < '1996-01-01'", "order_date >= '1996-01-01'"]
    for i, part in enumerate(parts, start=1):
        write_csv(lines.where(part), f"{arriving}/d{i}", "orders")
        if i > 1:
            load_arrivals(spark, f"{arriving}/*", "orders", out, checkpoint)
    delivery = F.regexp_extract("source_file", "/(d\\d)/[^/]+$", 1).alias("delivery")
    rows = staging.stg_orders(read_arrivals(spark, out, "orders").where("order_id is not null"))
    audited = file_audit(spark, out, "orders").groupBy(delivery).agg(F.sum("row_count").alias("n_audited"))
    loaded = read_arrivals(spark, out, "orders").groupBy(delivery).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("quantity").cast("bigint")).alias("pieces"))
    total = rows.groupBy(F.year("order_date").alias("year")).agg(F.sum("line_total").cast("double").alias("total"))
    by_year = total.select(F.concat(F.lit("y"), F.col("year").cast("string")).alias("part"), F.lit(0).cast("bigint").alias("n_audited"), F.lit(0).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("pieces"), "total")
    return loaded.join(audited, "delivery").select(F.col("delivery").alias("part"), "n_audited", "n_lines", "pieces", F.lit(0.0).alias("total")).unionByName(by_year)


QUERIES = {
    "stream_events_dedup": stream_events_dedup,
    "stream_queue_metrics": stream_queue_metrics,
    "stream_lifecycle": stream_lifecycle,
    "stream_sessions": stream_sessions,
    "sessions_batch": sessions_batch,
    "stream_transcripts": stream_transcripts,
    "stream_conversion": stream_conversion,
    "arriving_files": arriving_files,
}

_T = "'%Y-%m-%d %H:%M:%S.%f'"
_SESSIONS = f"""WITH steps AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh
  FROM events),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM steps),
 sessions AS (SELECT user_id, n, min(ts) AS a, max(ts) AS z, count(*) AS n_events FROM numbered GROUP BY ALL)
 SELECT user_id, strftime(a, {_T}) AS session_start, strftime(z + INTERVAL 2 HOUR, {_T}) AS session_end, n_events,
        strftime(z, {_T}) AS last_event FROM sessions"""

ORACLE = {
    "stream_events_dedup": f"SELECT event_id, user_id, event_type, value, strftime(ts, {_T}) AS ts FROM events",
    "stream_queue_metrics": """
      SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
             strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS total,
             count(*) FILTER (event_type = 'signup') AS new, count(*) FILTER (event_type = 'click') AS claimed,
             count(*) FILTER (event_type NOT IN ('signup', 'click')) AS closed,
             count(*) FILTER (event_type = 'signup' AND value >= 20) AS urgent FROM events GROUP BY ALL""",
    "stream_lifecycle": handoffs.STATE_SQL,
    "stream_sessions": _SESSIONS
    + " WHERE z + INTERVAL 2 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)",
    "sessions_batch": _SESSIONS,
    "stream_transcripts": chat.TRANSCRIPTS_SQL,
    "stream_conversion": shop.with_sql("stg_orders")
    + checks.RECS_SQL
    + """, ends AS (SELECT least((SELECT max(created_at) FROM recs), (SELECT max(CAST(order_date AS TIMESTAMP)) FROM stg_orders))
                           - INTERVAL 1 DAY - INTERVAL 90 DAY AS settled)
          SELECT r.customer_id, r.product_id, strftime(r.created_at, '%Y-%m-%d') AS created_on,
                 CAST(min(s.order_date) AS VARCHAR) AS converted_on
          FROM recs r JOIN ends ON r.created_at < settled
          LEFT JOIN stg_orders s ON s.customer_id = r.customer_id AND s.product_id = r.product_id
           AND s.order_date >= r.created_at AND s.order_date <= r.created_at + INTERVAL 90 DAY
          GROUP BY r.customer_id, r.product_id, r.created_at""",
    "arriving_files": shop.with_sql("stg_orders")
    + """ SELECT CASE WHEN order_date < DATE '1994-01-01' THEN 'd1' WHEN order_date < DATE '1996-01-01' THEN 'd2' ELSE 'd3' END AS part,
                 count(*) AS n_audited, count(*) AS n_lines, CAST(sum(quantity) AS BIGINT) AS pieces, CAST(0 AS DOUBLE) AS total
          FROM stg_orders GROUP BY 1
          UNION ALL SELECT 'y' || CAST(year(order_date) AS VARCHAR), 0, 0, 0, CAST(sum(line_total) AS DOUBLE) FROM stg_orders GROUP BY 1""",
}
