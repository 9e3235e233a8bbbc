"""A stored vector per chunk, of which a refresh encodes only what has changed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.operators import dense
from ticketloom.sources import sinks, snapshots

Encoder = Callable[[pa.ListArray], np.ndarray]
_COLUMNS = ["chunk_id", "content_hash", "embedding", "refresh"]


def _hashed(chunks: DataFrame, content: str) -> DataFrame:
    return chunks.select("chunk_id", F.col(content).alias("content"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content_hash"))


def _encoded(chunks: DataFrame, number: int | Column, encoder: Encoder | None) -> DataFrame:
    """Rows of the table for chunks (chunk_id, content, content_hash)."""
    row = F.struct("chunk_id", "content_hash")
    vectors = dense.encode_table(chunks.withColumn("_row", row), "_row", T.tokens(F.col("content")), encoder)
    return vectors.select("_row.chunk_id", "_row.content_hash", "embedding", F.lit(number).cast("int").alias("refresh"))


def build(chunks: DataFrame, root: str, content: str = "content", encoder: Encoder | None = None, buckets: int = snapshots.BUCKETS) -> snapshots.Snapshot:
    """A new table (chunk_id, content_hash, embedding, refresh) in buckets by chunk, of chunks (chunk_id, content). ``refresh``
    is the number of the refresh that encoded the chunk, 0 for the first."""
    return snapshots.create(_encoded(_hashed(chunks, content), 0, encoder), root, "chunk_id", buckets)


def refresh(table: snapshots.Snapshot, chunks: DataFrame, content: str = "content", encoder: Encoder | None = None) -> tuple[snapshots.Snapshot, dict[str, int]]:
    """The table brought up to date with all ``chunks`` as they are now, and how many were kept, encoded and removed.

    Hashes of the contents tell which chunks are new or differ from the stored ones; only those are encoded. Chunks that are
    no longer listed are removed. Only buckets with a changed or removed chunk are written again. Of the stored table the
    keys and hashes are read, not the vectors. Chunk ids are not NULL and do not repeat; a NULL content is empty.
    """
    now = sinks.stored(_hashed(chunks, content), "chunk-hashes")
    known = table.read().select("chunk_id", "content_hash")
    changed = sinks.stored(now.join(known, ["chunk_id", "content_hash"], "left_anti").select(*now.columns), "changed-chunks")
    gone = sinks.stored(known.join(now, "chunk_id", "left_anti").select("chunk_id"), "gone-chunks")
    counts = {"encoded": changed.count(), "removed": gone.count()}
    counts["kept"] = now.count() - counts["encoded"]
    if not counts["encoded"] and not counts["removed"]:
        return table, counts
    return snapshots.apply_changes(table, _encoded(changed, table.version + 1, encoder), gone), counts
