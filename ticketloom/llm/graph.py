"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.sources.sinks import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: the smallest node that can be reached.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest neighbour, then
    its smaller neighbours to the smallest of them. Each round shrinks every component towards a star; its edges are
    written to the shared folder, and only a count and a checksum come to the driver. Joins onto a node with very many
    neighbours are split by adaptive execution. Loops, repeated edges and NULL ends are ignored; no edges give no rows.
    """
    usable = edges.where(F.col(a) != F.col(b))
    current = usable.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current, before = stored(current, "edges"), None
    while True:
        mark = _mark(current)
        if mark == before or mark[0] == 0:
            break
        before = mark
        current = stored(_smaller(_larger(current)), "edges")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _larger(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node, tied to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u").where(F.col("v") > F.col("u"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and itself, tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").where(F.col("v") != F.col("m"))
    moved = tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
