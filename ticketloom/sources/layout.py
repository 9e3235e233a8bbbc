"""Spreading small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partitions by ``key`` when the scan has fewer splits than the cluster has cores.

    Text work is CPU-bound; a table of a few files would keep most cores idle. A table with more splits than cores
    is returned as it is, so a large corpus is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
