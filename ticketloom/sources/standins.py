"""Support-desk tables derived from the given parquet tables.

Each function reads only the columns it needs and returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import normalize as N
from ticketloom.functions import text as T
from ticketloom.sources.layout import spread

STATUS_OF_FLAG = {"O": "open", "P": "pending", "F": "resolved"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for text work, spread over the cores."""
    return spread(table(spark, folder, "documents"), "doc_id")


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    """(ticket_id, customer_id, category, raw_priority, priority, status, created_at) from orders and customer."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("ticket_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("raw_priority"),
        N.normalize_priority(F.col("o_orderpriority")).alias("priority"),
        N.lookup(F.col("o_orderstatus"), STATUS_OF_FLAG).alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )
    segments = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("category")
    )
    return orders.join(segments, "customer_id")


def resolved_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets with ``resolved_at``, the first ship date on or after the order date, and ``resolution_hours``; both NULL
    while unresolved.

    Lines are reduced to distinct (order, ship date) pairs first, so an order with a third of all lines reaches the
    join as one row per calendar day. The grouping reuses the partitioning of the join.
    """
    opened = tickets(spark, folder)
    shipped = (
        table(spark, folder, "lineitem")
        .select(F.col("l_orderkey").alias("_order"), F.col("l_shipdate").alias("_shipped"))
        .distinct()
    )
    later = (F.col("ticket_id") == F.col("_order")) & (F.col("_shipped") >= F.col("created_at"))
    return (
        opened.join(shipped, later, "left")
        .groupBy(*opened.columns)
        .agg(F.min("_shipped").alias("resolved_at"))
        .withColumn("resolution_hours", N.hours_between(F.col("created_at"), F.col("resolved_at")))
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge-base articles from documents; Spanish ones play the archived part."""
    return documents(spark, folder).select(
        F.col("doc_id").alias("article_id"),
        T.first_line(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("category"),
        F.col("lang"),
        F.when(F.col("lang") == "es", "archived").otherwise("published").alias("status"),
    )


def text_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets with text: subject is the first line, body the rest, status by the quality label."""
    texts = documents(spark, folder).select(
        F.col("doc_id").alias("ticket_id"),
        T.first_line(F.col("text")).alias("subject"),
        T.after_first_line(F.col("text")).alias("body"),
        F.col("source").alias("category"),
        "lang",
    )
    quality = table(spark, folder, "labels").select(F.col("doc_id").alias("ticket_id"), "quality")
    status = F.when(F.col("quality") == 0, "open").when(F.col("quality") == 1, "resolved").otherwise("closed")
    return texts.join(quality, "ticket_id", "left").withColumn("status", status).drop("quality")


def labelled_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """(ticket_id, subject, body, category, priority) for the routing model: language and quality label as truth.

    In as many partitions as the input has: a fit makes one small job per iteration, which more partitions only slow down.
    """
    truth = table(spark, folder, "labels").select(
        F.col("doc_id").alias("ticket_id"),
        F.when(F.col("quality") == 1, "P3").otherwise("P2").alias("priority"),
    )
    texts = table(spark, folder, "documents").select(
        F.col("doc_id").alias("ticket_id"),
        T.first_line(F.col("text")).alias("subject"),
        T.after_first_line(F.col("text")).alias("body"),
        F.col("lang").alias("category"),
    )
    return texts.join(truth, "ticket_id")


def ticket_dates(spark: SparkSession, folder: str) -> DataFrame:
    """(ticket_id, customer_id, created_at) from orders alone."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("ticket_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("created_at")
    )


def request_logs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("log_id"),
        F.col("event_type").alias("endpoint"),
        F.col("value").alias("latency_ms"),
        F.col("props").alias("response_body"),
        F.col("user_id").alias("session_user"),
        F.col("ts").alias("created_at"),
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings: purchases as feedback on the draft named by the user id, rated by the size of the value."""
    return (
        table(spark, folder, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("feedback_id"),
            F.col("user_id").alias("draft_id"),
            (F.least(F.lit(4.0), F.floor(F.col("value") / 20)) + 1).cast("int").alias("rating"),
            F.col("ts").alias("created_at"),
        )
    )


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    """(ticket_id, draft_no, draft_text): the assistant turns of a conversation; a later turn is a newer draft."""
    return (
        spread(table(spark, folder, "conversations"), "conv_id")
        .where(F.col("role") == "assistant")
        .select(F.col("conv_id").alias("ticket_id"), F.col("turn").alias("draft_no"), F.col("text").alias("draft_text"))
    )


def conversation_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """(ticket_id, subject): one row per conversation, the first user turn as its subject."""
    return (
        table(spark, folder, "conversations")
        .where(F.col("role") == "user")
        .groupBy(F.col("conv_id").alias("ticket_id"))
        .agg(F.min_by("text", "turn").alias("subject"))
    )


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query_text) from benchmark."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")
