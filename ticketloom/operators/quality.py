"""Data-quality rules, all counted in one pass per table."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rules(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(rule, checked, violations, sample): rows for which a rule is false or NULL, and the smallest such key."""
    measures = [F.count(F.lit(1)).alias("_n")]
    for i, rule in enumerate(rules.values()):
        broken = ~F.coalesce(rule, F.lit(False))
        measures.append(F.count_if(broken).alias(f"_v{i}"))
        measures.append(F.min(F.when(broken, F.col(key))).alias(f"_s{i}"))
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.col("_n").alias("checked"),
                F.col(f"_v{i}").alias("violations"),
                F.col(f"_s{i}").cast("string").alias("sample"),
            )
            for i, name in enumerate(rules)
        ]
    )
    return df.agg(*measures).select(F.inline(lines))


def allowed(column: str, values: list[str]) -> Column:
    return F.col(column).isin(*values)


def length_between(column: str, low: int, high: int) -> Column:
    return F.length(F.trim(column)).between(low, high)


def word_count(column: str) -> Column:
    return F.size(F.filter(F.split(F.col(column), r"\s+"), lambda w: w != ""))


def required_fields(parts: dict[str, tuple[DataFrame, list[str], int]]) -> DataFrame:
    """Per dataset: rows, names of missing columns, rows with a NULL in a required column, minimum met."""
    out = None
    for name, (df, fields, minimum) in parts.items():
        missing = [f for f in fields if f not in df.columns]
        present = [f for f in fields if f in df.columns]
        incomplete = functools.reduce(lambda a, b: a | b, [F.col(f).isNull() for f in present], F.lit(False))
        line = df.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(incomplete).alias("incomplete")
        ).select(
            F.lit(name).alias("dataset"),
            "rows",
            "incomplete",
            F.lit(",".join(missing)).alias("missing_fields"),
            (F.col("rows") >= minimum).alias("enough_rows"),
        )
        out = line if out is None else out.unionByName(line)
    return out


def unknown_labels(parts: dict[str, tuple[DataFrame, str]], declared: DataFrame, label: str) -> DataFrame:
    """(dataset, label): labels used by a dataset that the declared list lacks."""
    out = None
    for name, (df, column) in parts.items():
        used = df.select(F.col(column).alias(label)).where(F.col(label).isNotNull()).distinct()
        line = used.join(declared.select(label).distinct(), label, "left_anti").select(
            F.lit(name).alias("dataset"), label
        )
        out = line if out is None else out.unionByName(line)
    return out


def orphans(children: DataFrame, parents: DataFrame, key: str, relation: str) -> DataFrame:
    """(relation, orphans): child rows whose key no parent has. Children are counted per key before the join."""
    per_key = children.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_key.join(parents.select(key).distinct(), key, "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
        .select(F.lit(relation).alias("relation"), "orphans")
    )


def length_spread(df: DataFrame, column: str) -> DataFrame:
    """Shortest and longest text, and whether the longest is more than twice the shortest."""
    size = F.length(column)
    return df.agg(F.min(size).alias("shortest"), F.max(size).alias("longest")).withColumn(
        "varied", F.col("longest") > 2 * F.col("shortest")
    )
