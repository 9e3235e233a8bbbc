"""Fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators import ranking
from ticketloom.operators.topk import attach

#: Weight of the dense side and the rank offset.
ALPHA = 0.6
RANK_OFFSET = 60


def fuse_ranks(dense: DataFrame, sparse: DataFrame, k: int, alpha: float = ALPHA, offset: int = RANK_OFFSET) -> DataFrame:
    """(query_id, doc_id, score, dense_rank, sparse_rank, rank): alpha / (offset + dense rank) plus
    (1 - alpha) / (offset + sparse rank) over hits (query_id, doc_id, rank), each side up to rank 2k.

    Ties keep the dense order, then the sparse order.
    """
    def side(df: DataFrame, mine: str, other: str) -> DataFrame:
        return df.where(F.col("rank") <= 2 * k).select(
            "query_id", "doc_id", F.col("rank").alias(mine), F.lit(None).cast("int").alias(other)
        )

    both = side(dense, "dense_rank", "sparse_rank").unionByName(side(sparse, "sparse_rank", "dense_rank"))
    merged = both.groupBy("query_id", "doc_id").agg(
        F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank")
    )
    score = F.coalesce(alpha / (offset + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(
        (1 - alpha) / (offset + F.col("sparse_rank")), F.lit(0.0)
    )
    return ranking.rank_hits(
        merged.withColumn("score", F.round(score, 9)), "query_id", k,
        F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), F.col("doc_id"),
    )


def with_content(fused: DataFrame, dense_rows: DataFrame, sparse_rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Fused hits with the columns of ``dense_rows`` (doc_id, ...) where the dense side found the document, else those of
    ``sparse_rows``, which has the same columns. Only the hits' own rows of either table are joined; nothing is broadcast
    that is larger than the hits."""
    by_dense = F.col("dense_rank").isNotNull()
    found = attach(fused.where(by_dense), dense_rows, "doc_id", queries, k)
    return found.unionByName(attach(fused.where(~by_dense), sparse_rows.select(*dense_rows.columns), "doc_id", queries, k))
