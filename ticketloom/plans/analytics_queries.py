"""Registered queries: volumes, ratings, SLA, metrics, quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import normalize as N
from ticketloom.operators import aggregates as A
from ticketloom.operators import quality as Q
from ticketloom.operators import ranking as R
from ticketloom.operators import relational as L
from ticketloom.plans import reports
from ticketloom.plans import sql_parts as P
from ticketloom.plans.registry import query
from ticketloom.sources import sinks
from ticketloom.sources import standins as S

LAST_ORDER_DAY = "2001-08-01 00:00:00"
LAST_EVENT_DAY = "2024-01-30 00:00:00"


@query(
    "daily_volume_by_category", "E1 G4 S13",
    f"""WITH {P.TICKETS} SELECT CAST(created_at AS DATE) AS date, category, count(*) AS ticket_count
    FROM tickets GROUP BY ALL ORDER BY date DESC, ticket_count DESC, category""",
)
def daily_volume_by_category(spark, folder):
    return A.daily_volume(S.tickets(spark, folder))


@query(
    "routing_accuracy_by_category", "E2 E19",
    """SELECT lang AS category, count(*) AS total,
    CAST(sum(CASE WHEN lang = CASE WHEN quality = 1 THEN 'en' ELSE 'de' END THEN 1 ELSE 0 END) AS BIGINT) AS correct,
    round(avg(CASE WHEN lang = CASE WHEN quality = 1 THEN 'en' ELSE 'de' END THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy_pct
    FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def routing_accuracy_by_category(spark, folder):
    documents = S.table(spark, folder, "documents").select("doc_id", "lang")
    guess = S.table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, "en").otherwise("de").alias("guess"))
    return A.accuracy_by(documents.join(guess, "doc_id"), "lang", "guess")


def _count_fallback_sql(as_of):
    return f"""WITH {P.TICKETS}, {P.LOGS}
    SELECT CASE WHEN t.n > 0 THEN t.n ELSE l.n END AS total_tickets
    FROM (SELECT count(*) AS n FROM tickets WHERE created_at >= TIMESTAMP '{as_of}' - INTERVAL 7 DAY) t,
         (SELECT count(*) AS n FROM logs WHERE created_at >= TIMESTAMP '{as_of}' - INTERVAL 7 DAY AND endpoint = 'click') l"""


def _count_fallback(spark, folder, as_of):
    mine = S.tickets(spark, folder).where(L.trailing_period(F.col("created_at"), "week", as_of))
    logs = S.request_logs(spark, folder).where(L.trailing_period(F.col("created_at"), "week", as_of))
    return A.count_or_fallback(mine, logs.where(F.col("endpoint") == "click"), "total_tickets")


@query("ticket_count_in_period", "E3 C5", _count_fallback_sql(LAST_ORDER_DAY))
def ticket_count_in_period(spark, folder):
    return _count_fallback(spark, folder, LAST_ORDER_DAY)


@query("ticket_count_from_log_fallback", "E3 C5", _count_fallback_sql(LAST_EVENT_DAY))
def ticket_count_from_log_fallback(spark, folder):
    return _count_fallback(spark, folder, LAST_EVENT_DAY)


@query(
    "rating_and_latency_in_period", "E4",
    f"""WITH {P.LOGS}, {P.FEEDBACK}
    SELECT (SELECT round(nullif(avg(rating), 0), 6) FROM feedback WHERE created_at >= TIMESTAMP '{LAST_EVENT_DAY}' - INTERVAL 30 DAY) AS avg_rating,
           (SELECT round(nullif(avg(latency_ms), 0), 6) FROM logs WHERE endpoint = 'view' AND created_at >= TIMESTAMP '{LAST_EVENT_DAY}' - INTERVAL 30 DAY) AS avg_latency_ms""",
)
def rating_and_latency_in_period(spark, folder):
    recent = L.trailing_period(F.col("created_at"), "month", LAST_EVENT_DAY)
    rating = S.feedback(spark, folder).where(recent).agg(F.round(A.mean_or_null(F.col("rating")), 6)).scalar()
    logs = S.request_logs(spark, folder).where(recent & (F.col("endpoint") == "view"))
    return logs.agg(F.round(A.mean_or_null(F.col("latency_ms")), 6).alias("avg_latency_ms")).withColumn("avg_rating", rating)


@query(
    "category_count_map", "E5",
    f"""WITH {P.TICKETS}, c AS (SELECT category, count(*) AS n FROM tickets GROUP BY category)
    SELECT string_agg(category || '=' || n, ',' ORDER BY category) AS counts FROM c""",
)
def category_count_map(spark, folder):
    one = L.count_map(S.tickets(spark, folder), "category", "by_category")
    entries = F.array_sort(F.map_entries("by_category"))
    return one.select(
        F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts")
    )


@query(
    "label_counts_from_log_body", "E6 S23",
    f"""WITH {P.LOGS} SELECT json_extract_string(response_body, '$.k') AS label, count(*) AS n FROM logs
    WHERE endpoint = 'click' AND json_extract_string(response_body, '$.k') IS NOT NULL GROUP BY 1""",
)
def label_counts_from_log_body(spark, folder):
    logs = S.request_logs(spark, folder).where(F.col("endpoint") == "click")
    return A.label_counts(logs, F.get_json_object("response_body", "$.k"))


@query(
    "label_counts_with_fallback", "E5 E6 C6",
    f"""WITH {P.LOGS} SELECT json_extract_string(response_body, '$.k') AS label, count(*) AS n FROM logs
    WHERE endpoint = 'click' AND created_at >= TIMESTAMP '{LAST_EVENT_DAY}' - INTERVAL 30 DAY GROUP BY 1""",
)
def label_counts_with_fallback(spark, folder):
    return reports.period_label_counts(
        S.tickets(spark, folder), S.request_logs(spark, folder), F.col("category"),
        F.get_json_object("response_body", "$.k"), "month", LAST_EVENT_DAY, "click",
    )


@query(
    "page_count", "E7 C1",
    f"""WITH {P.TICKETS} SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
    FROM tickets WHERE priority = 'P2' AND status = 'open'""",
)
def page_count(spark, folder):
    return L.page_counts(L.list_rows(S.tickets(spark, folder), category=None, priority="P2", status="open"), 20)


@query(
    "ingest_summary", "E8",
    f"""WITH {P.TICKETS} SELECT count(*) AS total, count(DISTINCT category) AS categories,
    count(DISTINCT customer_id) AS customers FROM tickets""",
)
def ingest_summary(spark, folder):
    return A.ingest_summary(S.tickets(spark, folder), "category", "customer_id")


@query(
    "volume_summary", "E9",
    f"""WITH {P.TICKETS}, d AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS n FROM tickets GROUP BY 1)
    SELECT count(*) AS active_days, round(avg(n), 6) AS mean_per_day,
    (SELECT date FROM d ORDER BY n DESC, date LIMIT 1) AS peak_day, max(n) AS peak_count FROM d""",
)
def volume_summary(spark, folder):
    return A.volume_summary(S.tickets(spark, folder))


@query(
    "weekday_counts", "E10",
    f"""WITH {P.TICKETS}, w AS (SELECT dayname(created_at) AS weekday, count(*) AS n FROM tickets GROUP BY 1)
    SELECT CAST(c.position AS INTEGER) AS position, c.weekday, coalesce(w.n, 0) AS n
    FROM (VALUES {", ".join(f"({i}, '{d}')" for i, d in enumerate(vocab.WEEKDAYS))}) c(position, weekday)
    LEFT JOIN w ON w.weekday = c.weekday
    WHERE (SELECT count(DISTINCT CAST(created_at AS DATE)) FROM tickets) >= 7 ORDER BY position""",
)
def weekday_counts(spark, folder):
    return A.weekday_counts(S.tickets(spark, folder))


@query(
    "category_share", "E11",
    f"""WITH {P.TICKETS} SELECT category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
    FROM tickets GROUP BY category""",
)
def category_share(spark, folder):
    return A.share_by(S.tickets(spark, folder), "category")


@query(
    "priority_distribution", "E12",
    f"""WITH {P.TICKETS} SELECT p.priority, count(t.ticket_id) AS n
    FROM (VALUES ('P1'), ('P2'), ('P3'), ('P4')) p(priority) LEFT JOIN tickets t ON t.priority = p.priority GROUP BY p.priority""",
)
def priority_distribution(spark, folder):
    return A.priority_distribution(S.tickets(spark, folder))


@query(
    "priority_pivot", "E13",
    f"""WITH {P.TICKETS} SELECT category, count(*) FILTER (priority = 'P1') AS p1_count, count(*) FILTER (priority = 'P2') AS p2_count,
    count(*) FILTER (priority = 'P3') AS p3_count, count(*) FILTER (priority = 'P4') AS p4_count FROM tickets GROUP BY category""",
)
def priority_pivot(spark, folder):
    return A.priority_pivot(S.tickets(spark, folder), by=["category"])


@query(
    "top_category", "E14",
    f"""WITH {P.TICKETS} SELECT category, count(*) AS n FROM tickets GROUP BY category ORDER BY n DESC, category LIMIT 1""",
)
def top_category(spark, folder):
    return A.top_label(S.tickets(spark, folder), "category")


@query(
    "resolution_statistics", "E15 S14",
    f"""WITH {P.RESOLVED} SELECT count(*) AS total, count(resolution_hours) AS resolved,
    round(count(resolution_hours) * 100.0 / count(*), 6) AS resolved_pct, round(avg(resolution_hours), 6) AS mean_hours,
    round(quantile_cont(resolution_hours, 0.5), 6) AS median_hours, round(quantile_cont(resolution_hours, 0.9), 6) AS p90_hours
    FROM resolved""",
)
def resolution_statistics(spark, folder):
    return A.resolution_statistics(S.resolved_tickets(spark, folder))


@query(
    "resolution_histogram", "E15",
    f"""WITH {P.RESOLVED}, b AS (SELECT min(resolution_hours) AS lo, max(resolution_hours) AS hi FROM resolved),
    h AS (SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((resolution_hours - lo) * 20 / (hi - lo)) + 1, 20) END AS INTEGER) AS bin
          FROM resolved, b WHERE resolution_hours IS NOT NULL)
    SELECT CAST(r.bin AS INTEGER) AS bin, count(h.bin) AS n FROM range(1, 21) r(bin) LEFT JOIN h ON h.bin = r.bin GROUP BY r.bin""",
)
def resolution_histogram(spark, folder):
    return A.histogram(S.resolved_tickets(spark, folder), "resolution_hours", 20)


@query(
    "sla_compliance_by_priority", "E16 D9",
    f"""WITH {P.RESOLVED} SELECT priority, count(*) AS resolved,
    round(avg(CASE WHEN resolution_hours <= {P.SLA_HOURS} THEN 1.0 ELSE 0.0 END) * 100, 6) AS sla_pct
    FROM resolved WHERE resolution_hours IS NOT NULL GROUP BY priority""",
)
def sla_compliance_by_priority(spark, folder):
    return A.sla_compliance(S.resolved_tickets(spark, folder))


@query(
    "latency_quantiles_by_endpoint", "E17",
    f"""WITH {P.LOGS} SELECT endpoint, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms,
    round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM logs GROUP BY endpoint""",
)
def latency_quantiles_by_endpoint(spark, folder):
    out = R.quantile_columns(S.request_logs(spark, folder), ["endpoint"], "latency_ms", {"p50_ms": (0.5, "linear"), "p95_ms": (0.95, "linear")})
    return out.select("endpoint", F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"))


@query(
    "latency_in_period_from_sketches", "E17 M8 M11",
    f"""WITH {P.LOGS} SELECT endpoint, count(latency_ms) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms,
    round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM logs, (SELECT max(created_at) AS last FROM logs)
    WHERE CAST(created_at AS DATE) > CAST(last AS DATE) - 7 GROUP BY endpoint""",
)
def latency_in_period_from_sketches(spark, folder):
    """One stored sketch per day and endpoint; a week's quantiles come from seven of them, made exact by its rows."""
    logs = S.request_logs(spark, folder).select("endpoint", "latency_ms", F.col("created_at").cast("date").alias("date"))
    daily = sinks.stored(R.quantile_sketches(logs, ["date", "endpoint"], "latency_ms"), "daily-sketches")
    week = F.col("date") > F.date_sub(daily.agg(F.max("date")).scalar(), 7)
    wanted = {"p50_ms": (0.5, "linear"), "p95_ms": (0.95, "linear")}
    exact = R.quantile_columns(logs.where(week), ["endpoint"], "latency_ms", wanted, sketches=daily.where(week))
    counts = daily.where(week).groupBy("endpoint").agg(F.sum("n").alias("n"))
    return exact.join(counts, "endpoint").select("endpoint", "n", *[F.round(c, 6).alias(c) for c in wanted])


@query(
    "latency_nearest_rank_p95", "E18",
    f"""WITH {P.LOGS}, r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS i, count(*) OVER () AS n FROM logs)
    SELECT latency_ms AS p95_ms FROM r WHERE i = CAST(floor(n * 0.95) AS BIGINT) + 1""",
)
def latency_nearest_rank_p95(spark, folder):
    return R.quantile_columns(S.request_logs(spark, folder), [], "latency_ms", {"p95_ms": (0.95, "nearest")})


@query(
    "dataset_inventory", "E20",
    f"""SELECT 'tickets' AS dataset, count(*) AS rows, count(DISTINCT c_mktsegment) AS categories FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'articles', count(*), count(DISTINCT source) FROM documents
    UNION ALL SELECT 'logs', count(*), count(DISTINCT event_type) FROM events
    UNION ALL SELECT 'samples', count(*), count(DISTINCT lang) FROM documents JOIN labels USING (doc_id)""",
)
def dataset_inventory(spark, folder):
    return A.inventory(
        {
            "tickets": (S.tickets(spark, folder), "category"),
            "articles": (S.articles(spark, folder), "category"),
            "logs": (S.request_logs(spark, folder), "endpoint"),
            "samples": (S.labelled_tickets(spark, folder), "category"),
        }
    )


@query(
    "class_coverage", "E22 N4",
    """SELECT a.lang, count(l.doc_id) AS n, count(l.doc_id) >= 60 AS covered
    FROM documents a LEFT JOIN labels l ON l.doc_id = a.doc_id AND l.quality = 1 GROUP BY a.lang""",
)
def class_coverage(spark, folder):
    documents = S.table(spark, folder, "documents").select("doc_id", "lang")
    good = S.table(spark, folder, "labels").where(F.col("quality") == 1).select("doc_id")
    return A.coverage(documents.join(good, "doc_id"), "lang", 60, documents)


@query(
    "weekly_volume_change", "F9",
    f"""WITH {P.TICKETS}, c AS (SELECT CAST(date_trunc('week', created_at) AS DATE) AS period, count(*) AS n FROM tickets GROUP BY 1)
    SELECT period, n, lag(n) OVER (ORDER BY period) AS previous, n - lag(n) OVER (ORDER BY period) AS change FROM c""",
)
def weekly_volume_change(spark, folder):
    return R.period_change(S.tickets(spark, folder), "created_at", "week")


@query(
    "monthly_volume_change", "F9",
    f"""WITH {P.TICKETS}, c AS (SELECT CAST(date_trunc('month', created_at) AS DATE) AS period, count(*) AS n FROM tickets GROUP BY 1)
    SELECT period, n, lag(n) OVER (ORDER BY period) AS previous, n - lag(n) OVER (ORDER BY period) AS change FROM c""",
)
def monthly_volume_change(spark, folder):
    return R.period_change(S.tickets(spark, folder), "created_at", "month")


@query(
    "customer_trend", "F8",
    f"""WITH {P.TICKETS}, c AS (
      SELECT customer_id,
        count(*) FILTER (created_at >= TIMESTAMP '{LAST_ORDER_DAY}' - INTERVAL 365 DAY) AS recent,
        count(*) FILTER (created_at >= TIMESTAMP '{LAST_ORDER_DAY}' - INTERVAL 730 DAY AND created_at < TIMESTAMP '{LAST_ORDER_DAY}' - INTERVAL 365 DAY) AS earlier,
        CAST(min(created_at) AS DATE) AS first_seen
      FROM tickets WHERE created_at < TIMESTAMP '{LAST_ORDER_DAY}' GROUP BY customer_id)
    SELECT *, CASE WHEN earlier = 0 AND recent > 0 THEN 'emerging' WHEN earlier = 0 THEN 'stable'
      WHEN recent / earlier::DOUBLE > 1.2 THEN 'emerging' WHEN recent / earlier::DOUBLE < 0.8 THEN 'declining' ELSE 'stable' END AS trend FROM c""",
)
def customer_trend(spark, folder):
    return R.trend_labels(S.ticket_dates(spark, folder), "customer_id", "created_at", LAST_ORDER_DAY, days=365)


@query(
    "endpoint_latency_summary", "M11 E17 E18",
    f"""WITH {P.LOGS}, r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY latency_ms) AS i,
      count(*) OVER (PARTITION BY endpoint) AS n FROM logs)
    SELECT endpoint, count(*) AS requests, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms,
    round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
    max(latency_ms) FILTER (i = CAST(floor(n * 0.95) AS BIGINT) + 1) AS p95_nearest_ms FROM r GROUP BY endpoint""",
)
def endpoint_latency_summary(spark, folder):
    return reports.latency_summary(S.request_logs(spark, folder))


ROLLUP = f"""{P.RESOLVED}, {P.LOGS}, {P.FEEDBACK},
    t AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS total_tickets, count(*) FILTER (priority = 'P1') AS p1_tickets,
      count(*) FILTER (priority = 'P2') AS p2_tickets, count(*) FILTER (priority = 'P3') AS p3_tickets,
      count(*) FILTER (priority = 'P4') AS p4_tickets, count(*) FILTER (resolution_hours > {P.SLA_HOURS}) AS sla_breaches,
      count(*) FILTER (resolution_hours IS NULL AND priority IN ('P1', 'P2')) AS sla_at_risk,
      round(avg(CASE WHEN category = 'BUILDING' OR priority IN ('P1', 'P2') THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 6) AS routing_accuracy
      FROM resolved GROUP BY 1),
    l AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS requests, round(avg(latency_ms), 6) AS avg_latency_ms,
      sum(length(response_body) // 4)::BIGINT AS tokens_total FROM logs GROUP BY 1),
    f AS (SELECT CAST(created_at AS DATE) AS date, round(avg(rating), 6) AS avg_draft_rating,
      round(avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END), 6) AS draft_acceptance FROM feedback GROUP BY 1),
    m AS (SELECT date, string_agg(category || ':' || n, '|' ORDER BY category) AS by_category
      FROM (SELECT CAST(created_at AS DATE) AS date, category, count(*) AS n FROM resolved GROUP BY ALL) GROUP BY date),
    rollup_rows AS (SELECT date, coalesce(total_tickets, 0) AS total_tickets, coalesce(p1_tickets, 0) AS p1_tickets, coalesce(p2_tickets, 0) AS p2_tickets,
      coalesce(p3_tickets, 0) AS p3_tickets, coalesce(p4_tickets, 0) AS p4_tickets, coalesce(sla_breaches, 0) AS sla_breaches,
      coalesce(sla_at_risk, 0) AS sla_at_risk, routing_accuracy, coalesce(requests, 0) AS requests, avg_latency_ms, tokens_total,
      avg_draft_rating, draft_acceptance, by_category
    FROM t FULL JOIN l USING (date) FULL JOIN f USING (date) LEFT JOIN m USING (date))"""


@query("daily_metrics_rollup", "M12 B13", f"WITH {ROLLUP} SELECT * FROM rollup_rows")
def daily_metrics_rollup(spark, folder):
    """All metrics by date; urgent tickets are taken as routed right, others as sent to BUILDING."""
    tickets = S.resolved_tickets(spark, folder)
    guess = F.when(F.col("priority").isin("P1", "P2"), F.col("category")).otherwise("BUILDING")
    logs = S.request_logs(spark, folder).withColumn("tokens", F.floor(F.length("response_body") / 4))
    rows = reports.daily_rollup(tickets.withColumn("predicted_category", guess), logs, S.feedback(spark, folder))
    entries = F.transform(F.array_sort(F.map_entries("by_category")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return rows.withColumn("by_category", F.array_join(entries, "|"))


@query(
    "daily_category_maps", "M12 E5",
    f"""WITH {P.TICKETS} SELECT CAST(created_at AS DATE) AS date, category, count(*) AS n FROM tickets GROUP BY ALL""",
)
def daily_category_maps(spark, folder):
    maps = reports.daily_label_maps(S.tickets(spark, folder), "category")
    return maps.select("date", F.explode("by_category").alias("category", "n"))


@query(
    "period_metrics_row", "M13 E3 E4",
    f"""WITH {P.TICKETS}, {P.LOGS}, {P.FEEDBACK}, {P.DRAFTS}, w AS (SELECT TIMESTAMP '{LAST_EVENT_DAY}' - INTERVAL 7 DAY AS lo)
    SELECT 'week' AS period,
      (SELECT CASE WHEN (SELECT count(*) FROM tickets, w WHERE created_at >= lo) > 0 THEN (SELECT count(*) FROM tickets, w WHERE created_at >= lo)
              ELSE (SELECT count(*) FROM logs, w WHERE created_at >= lo AND endpoint = 'click') END) AS total_tickets,
      (SELECT count(*) FROM feedback, w WHERE created_at >= lo) AS total_drafts,
      (SELECT round(nullif(avg(rating), 0), 6) FROM feedback, w WHERE created_at >= lo) AS avg_draft_rating,
      (SELECT round(nullif(avg(latency_ms), 0), 6) FROM logs, w WHERE created_at >= lo AND endpoint = 'view') AS avg_latency_ms""",
)
def period_metrics_row(spark, folder):
    rated = S.feedback(spark, folder)
    return reports.period_metrics(
        S.tickets(spark, folder), rated, rated, S.request_logs(spark, folder), "week", LAST_EVENT_DAY, "click", "view"
    )


@query(
    "insight_rules", "K14",
    f"""WITH {P.TICKETS}, n AS (SELECT count(*) AS total FROM tickets),
    p AS (SELECT 'warning' AS kind, 'P1' AS subject, count(*) FILTER (priority = 'P1') AS n, 10.0 AS lim FROM tickets),
    c AS (SELECT 'trend' AS kind, category AS subject, count(*) AS n, 15.0 AS lim FROM tickets GROUP BY category ORDER BY n DESC, category LIMIT 1),
    s AS (SELECT 'emerging' AS kind, status AS subject, count(*) AS n, 30.0 AS lim FROM tickets GROUP BY status ORDER BY n DESC, status LIMIT 1)
    SELECT kind, subject, u.n, round(u.n * 100.0 / total, 6) AS share_pct
    FROM (SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM s) u, n WHERE u.n * 100.0 / total > lim""",
)
def insight_rules(spark, folder):
    mine = S.tickets(spark, folder)
    return reports.insight_rows(mine, mine.select(F.col("status").alias("cluster")), category_limit=15.0)


@query(
    "ticket_constraint_check", "N1",
    f"""WITH {P.TICKETS}
    SELECT rule, checked, violations, sample FROM (
      SELECT 'priority_allowed' AS rule, count(*) AS checked, count(*) FILTER (NOT coalesce(priority IN ('P1','P2','P3'), false)) AS violations,
        CAST(min(ticket_id) FILTER (NOT coalesce(priority IN ('P1','P2','P3'), false)) AS VARCHAR) AS sample FROM tickets
      UNION ALL SELECT 'status_allowed', count(*), count(*) FILTER (NOT coalesce(status IN ('open','pending','resolved','closed'), false)),
        CAST(min(ticket_id) FILTER (NOT coalesce(status IN ('open','pending','resolved','closed'), false)) AS VARCHAR) FROM tickets
      UNION ALL SELECT 'category_length', count(*), count(*) FILTER (NOT length(trim(category)) BETWEEN 5 AND 9),
        CAST(min(ticket_id) FILTER (NOT length(trim(category)) BETWEEN 5 AND 9) AS VARCHAR) FROM tickets
      UNION ALL SELECT 'created_at_present', count(*), count(*) FILTER (created_at IS NULL),
        CAST(min(ticket_id) FILTER (created_at IS NULL) AS VARCHAR) FROM tickets)""",
)
def ticket_constraint_check(spark, folder):
    rules = {
        "priority_allowed": Q.allowed("priority", ["P1", "P2", "P3"]),
        "status_allowed": Q.allowed("status", vocab.TICKET_STATUSES),
        "category_length": Q.length_between("category", 5, 9),
        "created_at_present": F.col("created_at").isNotNull(),
    }
    return Q.check_rules(S.tickets(spark, folder), rules, "ticket_id")


@query(
    "required_fields_and_rows", "N2",
    """SELECT 'documents' AS dataset, count(*) AS rows, count(*) FILTER (doc_id IS NULL OR text IS NULL) AS incomplete,
      '' AS missing_fields, count(*) >= 100 AS enough_rows FROM documents
    UNION ALL SELECT 'benchmark', count(*), count(*) FILTER (item_id IS NULL), 'relevant_docs', count(*) >= 100000 FROM benchmark""",
)
def required_fields_and_rows(spark, folder):
    return Q.required_fields(
        {
            "documents": (S.table(spark, folder, "documents"), ["doc_id", "text"], 100),
            "benchmark": (S.table(spark, folder, "benchmark"), ["item_id", "relevant_docs"], 100000),
        }
    )


@query(
    "category_consistency", "N3 H4",
    """SELECT 'labelled' AS dataset, lang AS category FROM documents JOIN labels USING (doc_id)
       WHERE lang NOT IN (SELECT lang FROM documents WHERE source = 'src0' AND lang <> 'fr') GROUP BY lang
    UNION ALL SELECT 'all', lang FROM documents
       WHERE lang NOT IN (SELECT lang FROM documents WHERE source = 'src0' AND lang <> 'fr') GROUP BY lang""",
)
def category_consistency(spark, folder):
    documents = S.table(spark, folder, "documents")
    declared = documents.where((F.col("source") == "src0") & (F.col("lang") != "fr")).select(F.col("lang").alias("category"))
    labelled = documents.join(S.table(spark, folder, "labels").select("doc_id"), "doc_id")
    return Q.unknown_labels({"labelled": (labelled, "lang"), "all": (documents, "lang")}, declared, "category")


@query(
    "article_length_rules", "N5 C10",
    f"""WITH {P.ARTICLES}, w AS (SELECT *, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS words FROM articles)
    SELECT 'title_at_least_5' AS rule, count(*) AS checked, count(*) FILTER (length(trim(title)) NOT BETWEEN 5 AND 500) AS violations,
      CAST(min(article_id) FILTER (length(trim(title)) NOT BETWEEN 5 AND 500) AS VARCHAR) AS sample FROM w
    UNION ALL SELECT 'body_10_to_10000', count(*), count(*) FILTER (length(trim(content)) NOT BETWEEN 10 AND 10000),
      CAST(min(article_id) FILTER (length(trim(content)) NOT BETWEEN 10 AND 10000) AS VARCHAR) FROM w
    UNION ALL SELECT 'at_least_50_words', count(*), count(*) FILTER (words < 50), CAST(min(article_id) FILTER (words < 50) AS VARCHAR) FROM w""",
)
def article_length_rules(spark, folder):
    rules = {
        "title_at_least_5": Q.length_between("title", 5, 500),
        "body_10_to_10000": Q.length_between("content", 10, 10000),
        "at_least_50_words": Q.word_count("content") >= 50,
    }
    return Q.check_rules(S.articles(spark, folder), rules, "article_id")


@query(
    "text_length_spread", "N5",
    """SELECT CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest,
    max(length(text)) > 2 * min(length(text)) AS varied FROM documents""",
)
def text_length_spread(spark, folder):
    return Q.length_spread(S.table(spark, folder, "documents"), "text")


@query(
    "referential_integrity", "N6 D10",
    """SELECT 'line_of_order' AS relation, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'event_of_customer', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'vector_of_label', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""",
)
def referential_integrity(spark, folder):
    def key(name, column):
        return S.table(spark, folder, name).select(F.col(column).alias("key"))

    return (
        Q.orphans(key("lineitem", "l_orderkey"), key("orders", "o_orderkey"), "key", "line_of_order")
        .unionByName(Q.orphans(key("events", "user_id"), key("customer", "c_custkey"), "key", "event_of_customer"))
        .unionByName(Q.orphans(key("embeddings", "vec_id"), key("labels", "doc_id"), "key", "vector_of_label"))
    )


@query(
    "sla_deadlines", "T5",
    f"""WITH {P.RESOLVED}, d AS (SELECT *, created_at + to_hours(CAST({P.SLA_HOURS} AS BIGINT)) AS deadline FROM resolved)
    SELECT ticket_id, priority, deadline, coalesce(resolved_at, TIMESTAMP '{LAST_ORDER_DAY}') > deadline AS breached,
      resolved_at IS NULL AND deadline >= TIMESTAMP '{LAST_ORDER_DAY}' AND deadline <= TIMESTAMP '{LAST_ORDER_DAY}' + INTERVAL 24 HOUR AS at_risk
    FROM d""",
)
def sla_deadlines(spark, folder):
    return reports.sla_deadlines(S.resolved_tickets(spark, folder), LAST_ORDER_DAY)
