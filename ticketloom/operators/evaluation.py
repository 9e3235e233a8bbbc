"""Retrieval, routing and draft metrics over whole tables."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ticketloom import vocab
from ticketloom.functions import normalize as N
from ticketloom.operators import aggregates, ranking
from ticketloom.operators.topk import attach

CUTOFFS = (1, 3, 5, 10)


def judge(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, rank) with ``is_relevant`` from judgements (query_id, doc_id)."""
    known = relevant.select("query_id", "doc_id").distinct().withColumn("_r", F.lit(True))
    return hits.join(known, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", "rank", F.coalesce("_r", F.lit(False)).alias("is_relevant")
    )


def relevant_counts(relevant: DataFrame) -> DataFrame:
    """(query_id, n_relevant) over distinct judged documents."""
    distinct = relevant.select("query_id", "doc_id").distinct()
    return distinct.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))


def judge_by_label(
    hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Judged hits and relevant counts where a document is relevant to a query of the same label.

    ``queries`` is (query_id, label), ``docs`` (doc_id, label). The relevant set is counted per label; the
    (query, document) pairs themselves are never listed.
    """
    asked = hits.join(queries.withColumnRenamed("label", "_asked"), "query_id")
    judged = (
        attach(asked, docs.withColumnRenamed("label", "_found"), "doc_id", queries, k)
        .select("query_id", "doc_id", "rank", F.col("_asked").eqNullSafe(F.col("_found")).alias("is_relevant"))
    )
    per_label = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    return judged, queries.join(per_label, "label").select("query_id", "n_relevant")


def _ideal(n_relevant: Column, k: int) -> Column:
    """Best possible discounted gain: the constants 1 / log2(i + 1) summed over min(k, n) places."""
    length = F.least(F.lit(k).cast("bigint"), n_relevant)
    return functools.reduce(
        lambda a, b: a + b,
        [F.when(length >= i, 1.0 / F.log2(F.lit(i + 1.0))).otherwise(0.0) for i in range(1, k + 1)],
        F.lit(0.0),
    )


def per_query_metrics(
    judged: DataFrame, totals: DataFrame, queries: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS
) -> DataFrame:
    """(query_id, k, recall, precision, ndcg, reciprocal_rank) for every query and cutoff in one pass.

    Queries without hits or without relevant documents count as 0. Repeated hits count once for recall and precision.
    """
    hit, rank = F.col("is_relevant"), F.col("rank")
    gains = [
        F.sum(F.when(hit & (rank <= k), 1.0 / F.log2(rank + 1.0)).otherwise(0.0)).alias(f"g{k}") for k in cutoffs
    ]
    per_doc = judged.groupBy("query_id", "doc_id").agg(F.min(F.when(hit, rank)).alias("first"), *gains)
    counts = [F.count_if(F.col("first") <= k).alias(f"n{k}") for k in cutoffs]
    per_query = per_doc.groupBy("query_id").agg(
        F.min("first").alias("first"), *counts, *[F.sum(f"g{k}").alias(f"g{k}") for k in cutoffs]
    )
    full = queries.select("query_id").join(per_query, "query_id", "left").join(totals, "query_id", "left")
    n_relevant = F.coalesce("n_relevant", F.lit(0))
    full = full.withColumn("n_relevant", n_relevant)

    def share(value: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.coalesce(value, F.lit(0.0)) / whole).otherwise(0.0)

    lines = [
        F.struct(
            F.lit(k).alias("k"),
            share(F.col(f"n{k}"), F.col("n_relevant")).alias("recall"),
            share(F.col(f"n{k}"), F.lit(k)).alias("precision"),
            share(F.col(f"g{k}"), _ideal(F.col("n_relevant"), k)).alias("ndcg"),
            F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        )
        for k in cutoffs
    ]
    return full.select("query_id", F.inline(F.array(*lines)))


def retrieval_metrics(
    judged: DataFrame, totals: DataFrame, queries: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS
) -> DataFrame:
    """(metric, k, value): mean recall, precision and nDCG per cutoff, and the mean reciprocal rank (k = 0)."""
    rows = per_query_metrics(judged, totals, queries, cutoffs)
    means = rows.groupBy("k").agg(*[F.avg(m).alias(m) for m in ("recall", "precision", "ndcg", "reciprocal_rank")])
    deepest = max(cutoffs)
    lines = [
        F.struct(F.lit(m).alias("metric"), F.col("k").alias("k"), F.col(m).alias("value"))
        for m in ("recall", "precision", "ndcg")
    ] + [F.struct(F.lit("mrr").alias("metric"), F.lit(0).alias("k"), F.when(F.col("k") == deepest, F.col("reciprocal_rank")).alias("value"))]
    return means.select(F.inline(F.array(*lines))).where(F.col("value").isNotNull())


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n); every later routing metric starts from this small table."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """(actual, predicted, n) for every pair of labels, 0 where none; the labels are one small array."""
    labels = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("actual", "predicted")))))
    every = counts.agg(labels.alias("labels")).select(F.explode("labels").alias("actual"), "labels").select(
        "actual", F.explode("labels").alias("predicted")
    )
    return every.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_report(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class, then 'accuracy', 'macro avg' and 'weighted avg'."""
    n = F.col("n")
    lines = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("label"), n.alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                    F.when(F.col("actual") == F.col("predicted"), n).otherwise(0).alias("right"),
                ),
                F.struct(
                    F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), n.alias("guessed"),
                    F.lit(0).cast("bigint").alias("right"),
                ),
            )
        )
    )
    sums = lines.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "right")])
    precision, recall = _ratio(F.col("right"), F.col("guessed")), _ratio(F.col("right"), F.col("support"))
    classes = sums.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    scores = ("precision", "recall", "f1")
    support = F.sum("support").alias("support")
    accuracy = F.sum("right") / F.sum("support")
    total = classes.agg(*[accuracy.alias(c) for c in scores], support).withColumn("label", F.lit("accuracy"))
    macro = classes.agg(*[F.avg(c).alias(c) for c in scores], support).withColumn("label", F.lit("macro avg"))
    weighted = classes.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in scores], support
    ).withColumn("label", F.lit("weighted avg"))
    columns = ["label", *scores, "support"]
    return functools.reduce(DataFrame.unionByName, [d.select(columns) for d in (classes, total, macro, weighted)])


def baseline_accuracy(df: DataFrame, actual: str) -> DataFrame:
    """Accuracy of always answering the most frequent class, and expected accuracy of a uniform guess."""
    counts = df.groupBy(actual).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("majority"), (1.0 / F.count(F.lit(1))).alias("uniform"))


def draft_quality(df: DataFrame, scores: dict[str, Column] | None = None) -> DataFrame:
    """One row from drafts (draft_text, citation_count, latency_ms): citation rate, mean citations, hedging rate,
    latency p50 / p95, sample count, and rubric means when scores are given."""
    hedged = (N.hedging_count(F.col("draft_text")) > 0).cast("int")
    base = df.agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg((F.col("citation_count") > 0).cast("int")).alias("citation_rate"),
        F.avg("citation_count").alias("mean_citations"),
        F.avg(hedged).alias("hedging_rate"),
    )
    latency = ranking.quantile_columns(
        df, [], "latency_ms", {"latency_p50_ms": (0.5, "linear"), "latency_p95_ms": (0.95, "linear")}
    )
    parts = [base, latency]
    if scores is not None:
        parts.append(aggregates.rubric_means(df, scores))
    return aggregates.single_row(*parts)


def acceptance_rate(df: DataFrame, band: str = "band") -> DataFrame:
    """Share of drafts sent as they are or with minor edits."""
    return df.agg(F.avg(F.col(band).isin("as_is", "minor").cast("int")).alias("acceptance_rate"))


def long_metrics(df: DataFrame, run_id: str, section: str) -> DataFrame:
    """A one-row metric table as (run_id, section, metric, k, value)."""
    lines = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
    return df.select(F.inline(lines)).select(
        F.lit(run_id).alias("run_id"), F.lit(section).alias("section"), "metric", F.lit(0).alias("k"), "value"
    )


def compare_runs(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """(section, metric, k, baseline, target, delta) for the metrics both runs hold."""
    on = ["section", "metric", "k"]
    return (
        baseline.select(*on, F.col("value").alias("baseline"))
        .join(target.select(*on, F.col("value").alias("target")), on)
        .withColumn("delta", F.col("target") - F.col("baseline"))
    )


def evaluation_run(
    run_id: str,
    kind: str,
    routing: DataFrame | None = None,
    retrieval: DataFrame | None = None,
    drafts: DataFrame | None = None,
) -> DataFrame:
    """The long metric table of a run of kind routing, retrieval, draft or full.

    ``routing`` holds confusion counts, ``retrieval`` (metric, k, value), ``drafts`` the one-row draft quality.
    """
    sections = {"routing": ("routing",), "retrieval": ("retrieval",), "draft": ("draft",),
                "full": ("routing", "retrieval", "draft")}
    if kind not in sections:
        raise ValueError(f"kind must be one of {sorted(sections)}, not {kind!r}")
    parts = []
    if "routing" in sections[kind] and routing is not None:
        report = classification_report(routing)
        rows = report.where(F.col("label").isin("accuracy", "macro avg", "weighted avg")).select(
            F.lit(run_id).alias("run_id"),
            F.lit("routing").alias("section"),
            F.when(F.col("label") == "accuracy", "accuracy").when(F.col("label") == "macro avg", "f1_macro")
            .otherwise("f1_weighted").alias("metric"),
            F.lit(0).alias("k"),
            F.col("f1").alias("value"),
        )
        parts.append(rows)
    if "retrieval" in sections[kind] and retrieval is not None:
        parts.append(
            retrieval.select(F.lit(run_id).alias("run_id"), F.lit("retrieval").alias("section"), "metric", "k", "value")
        )
    if "draft" in sections[kind] and drafts is not None:
        parts.append(long_metrics(drafts, run_id, "draft"))
    if not parts:
        raise ValueError(f"no input for a run of kind {kind!r}")
    return functools.reduce(DataFrame.unionByName, parts)


def rubric_from_json(raw: Column) -> dict[str, Column]:
    """Rubric scores from a judge's answer: think blocks dropped, the first object read, each score limited to
    1..5; an unreadable answer scores 3 everywhere."""
    cleaned = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    parsed = F.coalesce(_object_in(cleaned), _object_in(raw))
    return {
        c: N.clamp_score(F.try_variant_get(parsed, f"$.{c}", "int")) for c in vocab.RUBRIC_WEIGHTS
    }


@F.pandas_udf(StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    def read(text):
        at = (text or "").find("{")
        try:
            return None if at < 0 else text[at : json.JSONDecoder().raw_decode(text, at)[1]]
        except ValueError:
            return None

    return texts.map(read)


def _object_in(text: Column) -> Column:
    """The first complete JSON object, as a variant; NULL when there is none."""
    return F.try_parse_json(_first_object(text))
