"""Range joins as tiles of bounded size.

Rows carry a ``group`` and a whole-number ``cell``; only rows of one group in the same or in neighbouring cells can match.
A tile holds the rows of one cell and those of the cell before. Where a tile would be too large, its rows are dealt into
chunks by hash and every pair of chunks becomes a tile, so no task ever holds more than about two chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 1_500


def tiled(rows: DataFrame, group: list[str], key: str, rows_per_chunk: int | None = None) -> DataFrame:
    """``rows`` copied to their tiles, with ``own`` (the row lies in the tile's cell, not in the one before), ``chunk``
    and the tile (``group``, ``cell``, ``low``, ``high``).

    Two rows meet in exactly one tile of each cell they share: the tile of their chunks. In a tile with low < high only
    rows of different chunks are compared.
    """
    here = rows.withColumn("own", F.lit(True))
    after = rows.withColumn("cell", F.col("cell") + 1).withColumn("own", F.lit(False))
    both = here.unionByName(after)
    where = [*group, "cell"]
    counts = both.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"), F.max("own").alias("_own"))
    chunks = counts.where("_own AND _n > 1").select(*where, F.ceil(F.col("_n") / (rows_per_chunk or ROWS_PER_CHUNK)).cast("int").alias("_chunks"))
    dealt = both.join(chunks, where)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(key), F.col("_chunks")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return dealt.withColumns({"low": F.least("chunk", "_with"), "high": F.greatest("chunk", "_with")}).drop("_chunks", "_with")
