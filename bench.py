"""Headline queries on local Spark; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores. Each query runs once unmeasured and then
once measured, writing to the no-op sink. Searches read stored indexes, which the unmeasured run writes; ``lexical_index``
is the time of writing and reading one.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticketloom.operators import routing  # noqa: E402
from ticketloom.plans import catalogue  # noqa: E402
from ticketloom.session import build_session  # noqa: E402
from ticketloom.sources import standins  # noqa: E402

HEADLINE = [
    "daily_volume_by_category",
    "sla_compliance_by_priority",
    "resolution_statistics",
    "endpoint_latency_summary",
    "daily_metrics_rollup",
    "stratified_split",
    "ticket_constraint_check",
    "tickets_from_json_lines",
    "upsert_articles",
    "article_chunks",
    "lexical_index",
    "bm25_top_documents",
    "cover_rank_articles",
    "similar_tickets",
    "dense_topk",
    "approximate_recall",
    "quantized_neighbours",
    "hybrid_rank_fusion",
    "bm25_metric_table",
    "classification_report",
    "finished_drafts",
    "pages_to_text",
    "tfidf_weights",
    "passages_in_documents",
    "topic_projection",
    "stream_daily_endpoint_metrics",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def routing_seconds(spark, folder) -> dict[str, float]:
    """One fit of the router on all labelled tickets, and its predictions for all tickets."""
    start = time.perf_counter()
    router = routing.fit_router(routing.training_rows(standins.labelled_tickets(spark, folder)))
    fitted = time.perf_counter()
    consume(router.predict(standins.text_tickets(spark, folder)))
    return {"routing_fit": round(fitted - start, 3), "routing_predict": round(time.perf_counter() - fitted, 3)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="ticketloom-bench-"),
    }
    spark = build_session("bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    catalog = catalogue.all_queries()
    seconds = {}
    for name in HEADLINE:
        run = catalog[name].run
        consume(run(spark, folder))
        start = time.perf_counter()
        consume(run(spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
    seconds |= routing_seconds(spark, folder)
    table = {(r["metric"], r["k"]): r["value"] for r in catalog["bm25_metric_table"].run(spark, folder).collect()}
    counts = {
        "documents": spark.read.parquet(f"{folder}/documents.parquet").count(),
        "passages": spark.read.parquet(f"{folder}/benchmark.parquet").count(),
        "tickets": spark.read.parquet(f"{folder}/orders.parquet").count(),
        "vectors": spark.read.parquet(f"{folder}/embeddings.parquet").count(),
    }
    rates = {
        "tickets_checked_per_sec": counts["tickets"] / seconds["ticket_constraint_check"],
        "documents_chunked_per_sec": counts["documents"] / seconds["article_chunks"],
        "lexical_queries_per_sec": counts["passages"] / seconds["bm25_top_documents"],
        "approximate_dense_queries_per_sec": 2 * counts["vectors"] / seconds["approximate_recall"],
        "exact_dense_queries_per_sec": counts["vectors"] / 10 / seconds["quantized_neighbours"],
        "tickets_routed_per_sec": counts["documents"] / seconds["routing_predict"],
        "drafts_finished_per_sec": counts["passages"] / seconds["finished_drafts"],
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "quality": {"recall_at_5": table["recall", 5], "mrr": table["mrr", 0]},
                "rates": {k: round(v, 1) for k, v in rates.items()},
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
