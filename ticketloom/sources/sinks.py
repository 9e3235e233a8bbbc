"""Writes with insert-or-ignore, upsert and replace rules.

Each rule is a function from the stored table and a batch to the next snapshot. ``publish`` writes a snapshot to a new
folder, so a lost executor or a failed job never damages the stored one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.operators import quality
from ticketloom.session import scratch_path


def first_per_key(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row per non-NULL key; rows without a key are all kept.

    ``min_by`` combines on the map side, so a key that fills a third of the batch costs one row per task.
    """
    return _one_per_key(batch, key, F.min_by, order)


def last_per_key(batch: DataFrame, key: str, order: Column) -> DataFrame:
    return _one_per_key(batch, key, F.max_by, order)


def _one_per_key(batch: DataFrame, key: str, pick, order: Column) -> DataFrame:
    rest = [c for c in batch.columns if c != key]
    keyed = batch.where(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*rest), order).alias("_row"))
    kept = keyed.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*batch.columns)
    return kept.unionByName(batch.where(F.col(key).isNull()))


def insert_or_ignore(stored: DataFrame, batch: DataFrame, key: str, order: Column) -> DataFrame:
    """The batch rows to append: first per key, and only keys the table lacks. NULL keys never collide."""
    fresh = first_per_key(batch, key, order)
    keyed = fresh.where(F.col(key).isNotNull()).join(stored.select(key), key, "left_anti").select(*batch.columns)
    return keyed.unionByName(fresh.where(F.col(key).isNull()))


def insert_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """(total, inserted, skipped) of an insert."""
    n = F.count(F.lit(1)).alias("n")
    return batch.agg(n).select(
        F.col("n").alias("total"), inserted.agg(n).scalar().alias("inserted")
    ).withColumn("skipped", F.col("total") - F.col("inserted"))


def upsert(stored: DataFrame, batch: DataFrame, key: str, update: list[str], order: Column) -> DataFrame:
    """The next snapshot: new keys are added whole, known keys take only the ``update`` columns from the last batch
    row of that key."""
    latest = last_per_key(batch, key, order).where(F.col(key).isNotNull())
    rest = [c for c in stored.columns if c != key]
    renamed = latest.select(key, F.lit(True).alias("_in"), *[F.col(c).alias(f"_new_{c}") for c in rest])
    marked = stored.withColumn("_old", F.lit(True)).where(F.col(key).isNotNull())
    merged = marked.join(renamed, key, "full_outer")
    known, arrived = F.col("_old").isNotNull(), F.col("_in").isNotNull()
    columns = [
        F.when(arrived & (~known | F.lit(c in update)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in rest
    ]
    out = merged.select(key, *columns).select(*stored.columns)
    unkeyed = stored.where(F.col(key).isNull()).unionByName(batch.where(F.col(key).isNull()).select(*stored.columns))
    return out.unionByName(unkeyed)


ARTICLE_UPDATES = ["title", "content", "summary", "updated_at"]
PREDICTION_UPDATES = ["predicted_category", "predicted_priority", "predicted_confidence", "assignee_queue", "updated_at"]


def replace_children(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Children of touched parents replaced by the new ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def guarded_insert(drafts: DataFrame, tickets: DataFrame, key: str) -> DataFrame:
    """Only drafts whose ticket exists."""
    return drafts.join(tickets.select(key), key, "left_semi")


def feedback_rows(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback with a repeatable id, split from rows whose rating is not 1..5: (accepted, rejected)."""
    parts = [F.col(c).cast("string") for c in ("draft_id", "agent_id", "created_at")]
    named = feedback.withColumn("feedback_id", F.md5(F.concat_ws("|", *parts)))
    valid = F.coalesce(F.col("rating").between(1, 5), F.lit(False))
    return named.where(valid), named.where(~valid)


def log_rows(requests: DataFrame, request: list[str], response: list[str]) -> DataFrame:
    """Request-log rows: the named columns as JSON bodies, beside endpoint, latency, token count and time."""
    return requests.select(
        "endpoint",
        F.to_json(F.struct(*request)).alias("request_body"),
        F.to_json(F.struct(*response)).alias("response_body"),
        "latency_ms",
        "tokens",
        "created_at",
    )


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> DataFrame:
    """Writes a snapshot as parquet and returns it as read back."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written to a new folder of the shared directory and read back; cuts the lineage."""
    return publish(df, scratch_path(df.sparkSession, label))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A run's long metric table as JSON lines."""
    metrics.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run_id string, section string, metric string, k int, value double").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row Markdown report as a text file."""
    report.select("report").write.mode("errorifexists").text(path)


def checked(df: DataFrame, rules: dict[str, Column], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every rule, and the count of violations per rule."""
    keep = F.lit(True)
    for rule in rules.values():
        keep = keep & F.coalesce(rule, F.lit(False))
    return df.where(keep), quality.check_rules(df, rules, key)
