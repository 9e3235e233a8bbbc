"""Counts, shares, ratings and resolution statistics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import normalize as N
from ticketloom.operators import ranking, relational
from ticketloom.sources import sinks


def rows() -> Column:
    return F.count(F.lit(1))


def literal_rows(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """A small constant table (position, name) for reindexing."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias("position", name))


def single_row(*parts: DataFrame) -> DataFrame:
    """Several one-row tables side by side."""
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for part in parts for c in part.columns])


def daily_volume(df: DataFrame, created_at: str = "created_at", by: str = "category") -> DataFrame:
    """Tickets per day and category, newest day first, largest count first."""
    counts = df.groupBy(F.col(created_at).cast("date").alias("date"), by).agg(rows().alias("ticket_count"))
    return counts.orderBy(F.col("date").desc(), F.col("ticket_count").desc(), by)


def accuracy_by(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Total, correct and accuracy in percent per expected label."""
    hit = (F.col(expected) == F.col(predicted)).cast("int")
    return df.groupBy(F.col(expected).alias("category")).agg(
        rows().alias("total"),
        F.sum(F.coalesce(hit, F.lit(0))).alias("correct"),
        F.round(F.avg(F.coalesce(hit, F.lit(0))) * 100, 2).alias("accuracy_pct"),
    )


def count_or_fallback(primary: DataFrame, fallback: DataFrame, name: str) -> DataFrame:
    """Rows of ``primary``; when there are none, rows of ``fallback``."""
    n = primary.agg(rows().alias("n"))
    return n.select(
        F.when(F.col("n") > 0, F.col("n")).otherwise(fallback.agg(rows().alias("n")).scalar()).alias(name)
    )


def mean_or_null(value: Column) -> Column:
    """Average; an average of 0 is reported as NULL."""
    return F.nullif(F.avg(value), F.lit(0.0))


def label_counts(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    return df.select(label.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(rows().alias("n"))


def label_counts_or_fallback(primary: DataFrame, fallback: DataFrame, name: str = "label") -> DataFrame:
    """Counts of ``primary`` (label, n); when it is empty, those of ``fallback``."""
    tagged = primary.withColumn("_src", F.lit(0)).unionByName(fallback.withColumn("_src", F.lit(1)))
    first = tagged.agg(F.min("_src")).scalar()
    return tagged.where(F.col("_src") == first).select(name, "n")


def ingest_summary(df: DataFrame, category: str, customer: str) -> DataFrame:
    return df.agg(
        rows().alias("total"),
        F.countDistinct(category).alias("categories"),
        F.countDistinct(customer).alias("customers"),
    )


def volume_summary(df: DataFrame, created_at: str = "created_at") -> DataFrame:
    """Active days, mean tickets per active day, the peak day (ties: the earliest) and its count."""
    daily = df.groupBy(F.col(created_at).cast("date").alias("date")).agg(rows().alias("n"))
    return daily.agg(
        rows().alias("active_days"),
        F.round(F.avg("n"), 6).alias("mean_per_day"),
        F.max_by("date", F.struct(F.col("n"), -F.unix_date("date"))).alias("peak_day"),
        F.max("n").alias("peak_count"),
    )


def weekday_counts(df: DataFrame, created_at: str = "created_at", min_days: int = 7) -> DataFrame:
    """Monday to Sunday with 0 for silent days; empty when fewer than ``min_days`` days are active."""
    daily = df.groupBy(F.col(created_at).cast("date").alias("date")).agg(rows().alias("n"))
    by_name = daily.groupBy(F.date_format("date", "EEEE").alias("weekday")).agg(
        F.sum("n").alias("n"), rows().alias("days")
    )
    calendar = literal_rows(df.sparkSession, "weekday", vocab.WEEKDAYS)
    days = by_name.agg(F.sum("days")).scalar()
    return (
        calendar.join(by_name, "weekday", "left")
        .where(days >= min_days)
        .select("position", "weekday", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("position")
    )


def share_by(df: DataFrame, label: str) -> DataFrame:
    """Count and percent of the total per label."""
    counts = df.groupBy(label).agg(rows().alias("n"))
    # The window runs over one row per label.
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share_pct", F.round(F.col("n") * 100.0 / total, 6))


def priority_distribution(df: DataFrame, priority: str = "priority") -> DataFrame:
    """P1..P4 in order, 0 where missing."""
    counts = df.groupBy(priority).agg(rows().alias("n"))
    listed = literal_rows(df.sparkSession, priority, vocab.PRIORITIES)
    return listed.join(counts, priority, "left").select(priority, F.coalesce("n", F.lit(0)).alias("n"))


def priority_pivot(df: DataFrame, priority: str = "priority", by: list[str] | None = None) -> DataFrame:
    """P1..P4 counts as columns."""
    picks = [F.count_if(F.col(priority) == p).alias(f"{p.lower()}_count") for p in vocab.PRIORITIES]
    return df.groupBy(*(by or [])).agg(*picks)


def top_label(df: DataFrame, label: str) -> DataFrame:
    """The most frequent label; ties go to the smallest label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(rows().alias("n"))
    return counts.orderBy(F.col("n").desc(), label).limit(1)


def resolution_statistics(df: DataFrame, hours: str = "resolution_hours") -> DataFrame:
    """Total, resolved, resolved share, mean, median and 90th percentile of hours to resolve.

    The hours are written once, because the quantiles read them more than once and they often come from a join.
    """
    df = sinks.stored(df.select(hours), "resolution-hours")
    base = df.agg(
        rows().alias("total"),
        F.count(hours).alias("resolved"),
        F.round(F.count(hours) * 100.0 / rows(), 6).alias("resolved_pct"),
        F.round(F.avg(hours), 6).alias("mean_hours"),
    )
    quantiles = ranking.quantile_columns(
        df, [], hours, {"median_hours": (0.5, "linear"), "p90_hours": (0.9, "linear")}, written=True
    )
    return single_row(base, quantiles.select(*[F.round(c, 6).alias(c) for c in quantiles.columns]))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n): equal-width bins between minimum and maximum; the maximum falls in the last bin."""
    known = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    known = sinks.stored(known, "histogram-values")
    low, high = known.agg(F.min("v")).scalar(), known.agg(F.max("v")).scalar()
    place = F.when(high == low, F.lit(1)).otherwise(
        F.least(F.floor((F.col("v") - low) * bins / (high - low)) + 1, F.lit(bins))
    )
    counts = known.select(place.cast("int").alias("bin")).groupBy("bin").agg(rows().alias("n"))
    listed = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return listed.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def sla_compliance(df: DataFrame, priority: str = "priority", hours: str = "resolution_hours") -> DataFrame:
    """Percent of resolved tickets within the target hours, per priority."""
    within = (F.col(hours) <= N.sla_hours(F.col(priority))).cast("int")
    return (
        df.where(F.col(hours).isNotNull())
        .groupBy(priority)
        .agg(rows().alias("resolved"), F.round(F.avg(within) * 100, 6).alias("sla_pct"))
    )


def rubric_means(df: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """Mean per rubric criterion (missing score counts as 3) and the weighted overall mean."""
    means = [
        F.avg(F.coalesce(scores[c], F.lit(vocab.DEFAULT_SCORE))).alias(c) for c in vocab.RUBRIC_WEIGHTS
    ]
    overall = sum((F.col(c) * w for c, w in vocab.RUBRIC_WEIGHTS.items()), F.lit(0.0))
    return df.agg(*means).withColumn("overall", overall)


def coverage(df: DataFrame, label: str, minimum: int, expected: DataFrame | None = None) -> DataFrame:
    """Samples per class and whether the minimum is met; classes that only ``expected`` lists count 0."""
    counts = df.groupBy(label).agg(rows().alias("n"))
    if expected is not None:
        counts = expected.select(label).distinct().join(counts, label, "left")
    n = F.coalesce("n", F.lit(0))
    return counts.select(label, n.alias("n"), (n >= minimum).alias("covered"))


def inventory(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row and category counts per dataset: name -> (table, category column)."""
    out = None
    for name, (df, category) in parts.items():
        line = df.agg(rows().alias("rows"), F.countDistinct(category).alias("categories")).select(
            F.lit(name).alias("dataset"), "rows", "categories"
        )
        out = line if out is None else out.unionByName(line)
    return out


def category_totals(df: DataFrame, category: str) -> DataFrame:
    return relational.count_map(df, category, "by_category")
