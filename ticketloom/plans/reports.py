"""Reports made of several operators: metrics per period, daily rollup, weekly insights."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import normalize as N
from ticketloom.operators import aggregates, ranking, relational


def period_metrics(
    tickets: DataFrame,
    drafts: DataFrame,
    feedback: DataFrame,
    logs: DataFrame,
    period: str,
    as_of: str,
    triage_endpoint: str = "/triage",
    draft_endpoint: str = "/draft",
) -> DataFrame:
    """One row of metrics for the trailing period.

    Counts fall back to the request log when their table has no row in the period. Each table is scanned once,
    with conditional aggregates.
    """
    def recent(df: DataFrame) -> DataFrame:
        return df.where(relational.trailing_period(F.col("created_at"), period, as_of))

    log = recent(logs).agg(
        F.count_if(F.col("endpoint") == triage_endpoint).alias("triage_requests"),
        F.count_if(F.col("endpoint") == draft_endpoint).alias("draft_requests"),
        aggregates.mean_or_null(F.when(F.col("endpoint") == draft_endpoint, F.col("latency_ms"))).alias("avg_latency_ms"),
    )
    n_tickets = recent(tickets).agg(aggregates.rows()).scalar()
    n_drafts = recent(drafts).agg(aggregates.rows()).scalar()
    rating = recent(feedback).agg(F.round(aggregates.mean_or_null(F.col("rating")), 6)).scalar()
    return log.select(
        F.lit(period).alias("period"),
        F.when(n_tickets > 0, n_tickets).otherwise(F.col("triage_requests")).alias("total_tickets"),
        F.when(n_drafts > 0, n_drafts).otherwise(F.col("draft_requests")).alias("total_drafts"),
        rating.alias("avg_draft_rating"),
        F.round("avg_latency_ms", 6).alias("avg_latency_ms"),
    )


def period_label_counts(
    tickets: DataFrame, logs: DataFrame, label: Column, log_label: Column, period: str, as_of: str,
    triage_endpoint: str = "/triage",
) -> DataFrame:
    """(label, n) over the period's tickets, else over the labels found in the request log bodies."""
    mine = tickets.where(relational.trailing_period(F.col("created_at"), period, as_of))
    logged = logs.where(relational.trailing_period(F.col("created_at"), period, as_of)).where(
        F.col("endpoint") == triage_endpoint
    )
    return aggregates.label_counts_or_fallback(
        aggregates.label_counts(mine, label), aggregates.label_counts(logged, log_label)
    )


def daily_rollup(tickets: DataFrame, logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row per date over all sources: volume, priorities, resolution against SLA, latency, rating, and, where the
    columns ``predicted_category`` and ``tokens`` are given, routing accuracy and token total; ``by_category`` counts the
    day's tickets per category.

    Every source is first reduced to one row per date; the small results are stacked and summed by date, which
    equals a full outer join on date.
    """
    day = F.col("created_at").cast("date").alias("date")
    late = F.col("resolution_hours") > N.sla_hours(F.col("priority"))
    right = F.col("category") == F.col("predicted_category")
    ticket_part = tickets.groupBy(day).agg(
        aggregates.rows().alias("total_tickets"),
        F.count_if(F.col("priority") == "P1").alias("p1_tickets"),
        F.count_if(F.col("priority") == "P2").alias("p2_tickets"),
        F.count_if(F.col("priority") == "P3").alias("p3_tickets"),
        F.count_if(F.col("priority") == "P4").alias("p4_tickets"),
        F.count_if(late).alias("sla_breaches"),
        F.count_if(F.col("resolution_hours").isNull() & F.col("priority").isin("P1", "P2")).alias("sla_at_risk"),
        *([F.round(F.avg(right.cast("int")) * 100, 6).alias("routing_accuracy")] if "predicted_category" in tickets.columns else []),
    )
    log_part = logs.groupBy(day).agg(
        aggregates.rows().alias("requests"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        *([F.sum("tokens").alias("tokens_total")] if "tokens" in logs.columns else []),
    )
    rating_part = feedback.groupBy(day).agg(
        F.round(F.avg("rating"), 6).alias("avg_draft_rating"),
        F.round(F.avg((F.col("rating") >= 4).cast("int")), 6).alias("draft_acceptance"),
    )
    parts = [ticket_part, log_part, rating_part]
    columns = [c for part in parts for c in part.columns if c != "date"]
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = {"total_tickets", "p1_tickets", "p2_tickets", "p3_tickets", "p4_tickets", "sla_breaches", "sla_at_risk", "requests"}
    rows = stacked.groupBy("date").agg(
        *[(F.coalesce(F.max(c), F.lit(0)) if c in counts else F.max(c)).alias(c) for c in columns]
    )
    return rows.join(daily_label_maps(tickets, "category"), "date", "left")


def daily_label_maps(tickets: DataFrame, label: str) -> DataFrame:
    """(date, label map) for the rollup's map columns: at most one entry per label of the vocabulary."""
    counts = tickets.groupBy(F.col("created_at").cast("date").alias("date"), label).agg(aggregates.rows().alias("n"))
    return counts.groupBy("date").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias(f"by_{label}")
    )


def insight_rows(
    tickets: DataFrame, clusters: DataFrame | None = None, p1_limit: float = 10.0, category_limit: float = 40.0,
    cluster_limit: float = 30.0,
) -> DataFrame:
    """(kind, subject, n, share_pct) for every rule whose threshold is exceeded."""
    total = aggregates.rows()
    p1 = tickets.agg(F.count_if(F.col("priority") == "P1").alias("n"), total.alias("total")).select(
        F.lit("warning").alias("kind"), F.lit("P1").alias("subject"), "n", "total", F.lit(p1_limit).alias("limit")
    )

    def leader(df: DataFrame, label: str, kind: str, limit: float) -> DataFrame:
        counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(total.alias("n"))
        return (
            counts.orderBy(F.col("n").desc(), label).limit(1)
            .select(
                F.lit(kind).alias("kind"),
                F.col(label).cast("string").alias("subject"),
                "n",
                df.agg(total).scalar().alias("total"),
                F.lit(limit).alias("limit"),
            )
        )

    out = p1.unionByName(leader(tickets, "category", "trend", category_limit))
    if clusters is not None:
        out = out.unionByName(leader(clusters, "cluster", "emerging", cluster_limit))
    share = F.col("n") * 100.0 / F.col("total")
    return out.where(share > F.col("limit")).select("kind", "subject", "n", F.round(share, 6).alias("share_pct"))


def weekly_report(tickets: DataFrame, start: str, end: str, insights: DataFrame) -> DataFrame:
    """The Markdown text of the period as one row: summary, category table, insights.

    Only aggregated lines are joined to text: one per category and one per insight.
    """
    period = tickets.where(F.col("created_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    shares = aggregates.share_by(period, "category")
    table = shares.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("category"), F.col("share_pct")))),
                lambda r: F.concat(
                    F.lit("| "), r["category"], F.lit(" | "), (-r["o"]).cast("string"), F.lit(" | "),
                    F.format_number(r["share_pct"], 1), F.lit("% |"),
                ),
            ),
            "\n",
        )
    ).scalar()
    notes = insights.agg(
        F.array_join(
            F.array_sort(
                F.collect_list(
                    F.concat(F.lit("- "), F.col("kind"), F.lit(": "), F.col("subject"), F.lit(" ("),
                             F.format_number("share_pct", 1), F.lit("%)"))
                )
            ),
            "\n",
        )
    ).scalar()
    summary = period.agg(
        aggregates.rows().alias("total"), F.count_if(F.col("priority") == "P1").alias("p1")
    )
    return summary.select(
        F.concat_ws(
            "\n",
            F.lit("# Support report"),
            F.concat(F.lit("Period: "), F.lit(start), F.lit(" to "), F.lit(end)),
            F.lit(""),
            F.concat(F.lit("Tickets: "), F.col("total").cast("string")),
            F.concat(F.lit("P1 tickets: "), F.col("p1").cast("string")),
            F.lit(""),
            F.lit("| Category | Tickets | Share |"),
            F.lit("|---|---|---|"),
            table,
            F.lit(""),
            F.lit("## Insights"),
            F.coalesce(notes, F.lit("")),
        ).alias("report")
    )


def latency_summary(logs: DataFrame) -> DataFrame:
    """Requests, mean, interpolated p50 / p95 and nearest-rank p95 per endpoint."""
    base = logs.groupBy("endpoint").agg(
        aggregates.rows().alias("requests"), F.round(F.avg("latency_ms"), 6).alias("mean_ms")
    )
    quantiles = ranking.quantile_columns(
        logs,
        ["endpoint"],
        "latency_ms",
        {"p50_ms": (0.5, "linear"), "p95_ms": (0.95, "linear"), "p95_nearest_ms": (0.95, "nearest")},
    )
    rounded = [F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "p95_nearest_ms")]
    return base.join(quantiles, "endpoint").select("endpoint", "requests", "mean_ms", *rounded)


def sla_deadlines(df: DataFrame, as_of: str, warn_hours: int = 24) -> DataFrame:
    """Deadline per ticket, whether it was missed, and whether an unresolved one falls due within ``warn_hours``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    deadline = F.col("created_at") + F.make_dt_interval(hours=N.sla_hours(F.col("priority")))
    due = F.col("deadline").between(now, now + F.make_dt_interval(hours=F.lit(warn_hours)))
    return df.withColumn("deadline", deadline).select(
        "ticket_id",
        "priority",
        "deadline",
        (F.coalesce("resolved_at", now) > F.col("deadline")).alias("breached"),
        (F.col("resolved_at").isNull() & due).alias("at_risk"),
    )
