"""Registered queries: streams over the event and ticket files, run to the end of the input.

Windows are written whenever they change, so the last ones appear too and the result is that of the batch query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import normalize as N
from ticketloom.plans import reports
from ticketloom.plans import sql_parts as P
from ticketloom.plans.analytics_queries import LAST_ORDER_DAY
from ticketloom.plans.registry import query
from ticketloom.session import scratch_path
from ticketloom.sources import sinks
from ticketloom.sources import standins as S
from ticketloom.streaming import jobs, sla


def log_stream(spark, folder):
    """Events as a stream of one file, under the names of the request log."""
    schema = S.table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return events.select(
        F.col("event_id").alias("log_id"), F.col("event_type").alias("endpoint"), F.col("value").alias("latency_ms"),
        F.col("user_id").alias("session_user"), F.col("ts").alias("created_at"),
    )


@query(
    "stream_daily_endpoint_metrics", "T1",
    f"""WITH {P.LOGS} SELECT CAST(created_at AS DATE) AS day, endpoint, count(*) AS requests, round(avg(latency_ms), 6) AS mean_latency_ms
    FROM logs GROUP BY 1, 2""",
)
def stream_daily_endpoint_metrics(spark, folder):
    out = jobs.run_to_latest(jobs.daily_endpoint_metrics(log_stream(spark, folder)), ["day", "endpoint"], "daily-endpoints")
    return out.select(
        F.col("day").cast("date").alias("day"), "endpoint", "requests", F.round("mean_latency_ms", 6).alias("mean_latency_ms")
    )


@query(
    "stream_weekly_volume", "T2",
    f"""WITH {P.LOGS}, w AS (SELECT CAST(min(created_at) AS DATE) AS lo, CAST(max(created_at) AS DATE) AS hi FROM logs),
    s AS (SELECT CAST(unnest(generate_series(lo - INTERVAL 6 DAY, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS start FROM w)
    SELECT start, count(*) AS requests FROM s JOIN logs ON created_at >= start AND created_at < start + INTERVAL 7 DAY
    GROUP BY start""",
)
def stream_weekly_volume(spark, folder):
    out = jobs.run_to_latest(jobs.sliding_weekly_volume(log_stream(spark, folder)), ["start"], "weekly-volume")
    return out.select(F.col("start").cast("date").alias("start"), "requests")


@query(
    "stream_deduplicated_users", "T3",
    "SELECT endpoint, count(DISTINCT session_user) AS users FROM (SELECT event_type AS endpoint, user_id AS session_user FROM events) GROUP BY endpoint",
)
def stream_deduplicated_users(spark, folder):
    """One row per user and endpoint: within a single micro-batch every repeat is a duplicate."""
    key = F.concat_ws("-", "endpoint", "session_user")
    stream = log_stream(spark, folder).withColumn("external_id", key).select("external_id", "endpoint", "created_at")
    out = jobs.run_to_table(jobs.deduplicated(stream, "external_id", watermark="60 days"), "deduplicated")
    return out.groupBy("endpoint").agg(F.count(F.lit(1)).alias("users"))


@query(
    "stream_deduplicated_unkeyed", "T3",
    """SELECT event_type AS endpoint, CASE WHEN event_type = 'view' THEN count(*) ELSE count(DISTINCT user_id) END AS kept
    FROM events GROUP BY event_type""",
)
def stream_deduplicated_unkeyed(spark, folder):
    """As above, but views carry no key: all of them stay, also where their rows are equal."""
    key = F.when(F.col("endpoint") != "view", F.concat_ws("-", "endpoint", "session_user"))
    stream = log_stream(spark, folder).withColumn("external_id", key).select("external_id", "endpoint", "created_at")
    out = jobs.run_to_table(jobs.deduplicated(stream, "external_id", watermark="60 days"), "unkeyed")
    return out.groupBy("endpoint").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "stream_triage", "T4 B4",
    f"""WITH {P.TICKETS} SELECT ticket_id, 'open' AS status, CASE category WHEN 'BUILDING' THEN 'Billing' WHEN 'MACHINERY' THEN 'Technical' ELSE 'General' END AS predicted_category,
    priority AS predicted_priority, {P.case("CASE category WHEN 'BUILDING' THEN 'Billing' WHEN 'MACHINERY' THEN 'Technical' ELSE 'General' END", vocab.QUEUES, "'general-support'")} AS assignee_queue FROM tickets""",
)
def stream_triage(spark, folder):
    """Rule triage over ticket files arriving two at a time."""
    path = scratch_path(spark, "ticket-files")
    tickets = S.tickets(spark, folder).select("ticket_id", "category", "raw_priority")
    tickets.repartition(4, "ticket_id").write.parquet(path)
    stream = jobs.file_stream(spark, path, tickets.schema, files_per_trigger=2)

    def triage(batch):
        category = N.lookup(F.col("category"), {"BUILDING": "Billing", "MACHINERY": "Technical"}, "General")
        scored = batch.select(
            "ticket_id", category.alias("predicted_category"),
            N.normalize_priority(F.col("raw_priority")).alias("predicted_priority"), F.lit(0.5).alias("predicted_confidence"),
        )
        return scored.withColumn("assignee_queue", N.queue_for(F.col("predicted_category")))

    return jobs.triage_stream(stream, triage).drop("predicted_confidence")


@query(
    "stream_sla_alerts", "T5",
    f"""WITH {P.RESOLVED}, a AS (
      SELECT ticket_id, resolved_at, 'at_risk' AS alert, created_at + to_minutes(CAST({P.SLA_HOURS} * 45 AS BIGINT)) AS "at" FROM resolved
      UNION ALL SELECT ticket_id, resolved_at, 'breach', created_at + to_hours(CAST({P.SLA_HOURS} AS BIGINT)) FROM resolved),
    w AS (SELECT greatest(max(created_at), max(resolved_at)) - INTERVAL 1 DAY AS passed FROM resolved)
    SELECT ticket_id, alert, "at" FROM a, w WHERE resolved_at > "at" OR resolved_at IS NULL AND "at" <= passed""",
)
def stream_sla_alerts(spark, folder):
    """Tickets and their resolutions as two streams of files; one stretch of time arrives after the other."""
    path = scratch_path(spark, "sla-events")
    tickets = sinks.stored(S.resolved_tickets(spark, folder).select("ticket_id", "priority", "created_at", "resolved_at"), "sla-tickets")
    opened = tickets.select("ticket_id", "priority", "created_at")
    resolved = tickets.where("resolved_at IS NOT NULL").select("ticket_id", "resolved_at")
    first, last = tickets.agg(F.min("created_at"), F.max("created_at")).first()
    ends = [first + (last - first) * i / 4 for i in range(1, 4)]
    for start, end in zip([None, *ends], [*ends, None]):
        for part, at, name in ((opened, "created_at", "opened"), (resolved, "resolved_at", "resolved")):
            after = F.lit(True) if start is None else F.col(at) >= F.lit(start)
            before = F.lit(True) if end is None else F.col(at) < F.lit(end)
            part.where(after & before).write.mode("append").parquet(f"{path}/{name}")
        # All files of the stretch are one batch; the run goes on where the last one ended.
        found = sla.run_alerts(
            jobs.file_stream(spark, f"{path}/opened", opened.schema), jobs.file_stream(spark, f"{path}/resolved", resolved.schema),
            f"{path}/alerts", f"{path}/progress",
        )
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "stream_sla_deadlines", "T5",
    f"""WITH {P.RESOLVED}, d AS (SELECT *, created_at + to_hours(CAST({P.SLA_HOURS} AS BIGINT)) AS deadline FROM resolved)
    SELECT ticket_id, priority, deadline, coalesce(resolved_at, TIMESTAMP '{LAST_ORDER_DAY}') > deadline AS breached,
      resolved_at IS NULL AND deadline >= TIMESTAMP '{LAST_ORDER_DAY}' AND deadline <= TIMESTAMP '{LAST_ORDER_DAY}' + INTERVAL 24 HOUR AS at_risk
    FROM d""",
)
def stream_sla_deadlines(spark, folder):
    """Every ticket as it arrives: deadline, breach and the at-risk flag. No state is kept, so no watermark is needed."""
    path = scratch_path(spark, "dated-tickets")
    tickets = S.resolved_tickets(spark, folder).select("ticket_id", "priority", "created_at", "resolved_at")
    tickets.write.parquet(path)
    stream = jobs.file_stream(spark, path, tickets.schema)
    return jobs.run_to_table(reports.sla_deadlines(stream, LAST_ORDER_DAY), "sla-alerts")
