"""Filters, joins, top-k, paging and set operations over support-desk tables."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.sources import sinks

PERIOD_DAYS = {"day": 1, "week": 7, "month": 30}


def list_rows(df: DataFrame, **filters) -> DataFrame:
    """AND of equality on the filters that are not None."""
    conditions = [F.col(name) == value for name, value in filters.items() if value is not None]
    return df.where(functools.reduce(operator.and_, conditions)) if conditions else df


def trailing_period(created_at: Column, period: str, as_of: str) -> Column:
    """``created_at`` on or after ``as_of`` minus 1, 7 or 30 days; no upper bound."""
    if period not in PERIOD_DAYS:
        raise ValueError(f"period must be one of {sorted(PERIOD_DAYS)}, not {period!r}")
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {PERIOD_DAYS[period]} DAY")
    return created_at >= start


def observed_label(df: DataFrame, observed: str, predicted: str, name: str) -> DataFrame:
    """Observed label, else the predicted one; rows with neither are dropped."""
    return df.withColumn(name, F.coalesce(F.col(observed), F.col(predicted))).where(F.col(name).isNotNull())


def metadata_filter(df: DataFrame, conditions: dict[str, str], metadata: str = "metadata") -> DataFrame:
    """AND of equality on metadata keys."""
    for key, value in conditions.items():
        df = df.where(F.col(metadata)[key] == value)
    return df


def join_unique(facts: DataFrame, unique: DataFrame, on: str, hot_rows: int = 1_000_000, max_hot: int = 10_000) -> DataFrame:
    """Inner join of ``facts`` with a table that holds each key once, safe when one key owns a third of the facts.

    Keys with more than ``hot_rows`` facts, and more than a ``max_hot``-th of all, are joined by broadcasting their
    rows of ``unique``: at most ``max_hot`` rows by construction. All other keys are joined by shuffle.
    """
    counts = facts.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    floor = F.greatest(F.lit(hot_rows), F.floor(counts.agg(F.sum("_n")).scalar() / max_hot))
    hot = sinks.stored(counts.where(F.col("_n") > floor).select(on), "hot-keys")
    if hot.isEmpty():
        return facts.join(unique, on)
    few = unique.join(F.broadcast(hot), on, "left_semi")
    return facts.join(F.broadcast(few), on).unionByName(facts.join(F.broadcast(hot), on, "left_anti").join(unique, on))


def with_latest(parents: DataFrame, children: DataFrame, key: str, newest: str, columns: list[str]) -> DataFrame:
    """Each parent with the newest child row, or NULLs.

    ``max_by`` combines on the map side, so a parent with very many children costs one row per task.
    """
    latest = children.groupBy(key).agg(
        F.max_by(F.struct(*columns), newest).alias("_latest")
    )
    out = parents.join(latest, key, "left")
    return out.select(*parents.columns, *[F.col(f"_latest.{c}").alias(c) for c in columns])


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """One row per (parent, child) and one row for a parent without children.

    Written as inner join plus anti join, so that a parent that owns a third of all children is split over many
    tasks, which an outer join would not allow on the child side.
    """
    matched = join_unique(children, parents, key)
    bare = parents.join(children.select(key).distinct(), key, "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def top_k(df: DataFrame, k: int, score: str, *tie_break: str) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *tie_break).limit(k)


def page(df: DataFrame, number: int, size: int, newest: str, tie_break: str) -> DataFrame:
    """Page ``number`` (from 1), newest first. All rows before the page pass one task; deep pages go by ``page_after``."""
    return df.orderBy(F.col(newest).desc(), tie_break).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last_newest: Column, last_key: Column, size: int, newest: str, tie_break: str) -> DataFrame:
    """The ``size`` rows that follow the row (``last_newest``, ``last_key``), newest first, at the same cost for any depth."""
    older = F.col(newest) < last_newest
    return df.where(older | ((F.col(newest) == last_newest) & (F.col(tie_break) > last_key))).orderBy(
        F.col(newest).desc(), tie_break
    ).limit(size)


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """Total rows and number of pages."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / F.lit(size)).cast("bigint").alias("pages"))


def hash_order(key: str, seed: int) -> Column:
    """A repeatable random order: md5 of key and seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows in a repeatable random order."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def tagged_union(**parts: DataFrame) -> DataFrame:
    """Union by name with the part's name in ``source_type``."""
    frames = [df.withColumn("source_type", F.lit(name)) for name, df in parts.items()]
    return functools.reduce(DataFrame.unionByName, frames)


def missing_values(expected: DataFrame, actual: DataFrame, on: str) -> DataFrame:
    """Values of ``expected`` that ``actual`` lacks."""
    return expected.select(on).distinct().join(actual.select(on).distinct(), on, "left_anti")


def label_union(df: DataFrame, *columns: str) -> DataFrame:
    """Sorted distinct labels over several columns."""
    parts = [df.select(F.col(c).alias("label")).where(F.col(c).isNotNull()) for c in columns]
    return functools.reduce(DataFrame.union, parts).distinct().orderBy("label")


def sorted_entries(map_column: Column) -> Column:
    """Map entries by value descending, key ascending."""
    return F.array_sort(
        F.map_entries(map_column),
        lambda a, b: F.when(a["value"] > b["value"], -1)
        .when(a["value"] < b["value"], 1)
        .when(a["key"] < b["key"], -1)
        .when(a["key"] > b["key"], 1)
        .otherwise(0),
    )


def count_map(df: DataFrame, label: str, name: str) -> DataFrame:
    """``{label: n}`` as one row. The labels are a small vocabulary: the map holds one entry per distinct label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias(name))
