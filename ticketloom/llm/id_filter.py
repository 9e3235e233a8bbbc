"""A Bloom filter of row keys, so that texts that cannot match are left where they lie."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the smallest and of the largest filter; a filter has at least eight bits per key in between.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Bytes of one of Spark's bitmap buckets.
BUCKET = 4096


class KeyFilter:
    """Marks of the keys of a table, by Spark's bitmap aggregates; at most 16 MB, whatever the number of keys.

    It may let through keys that were not given, never the reverse. ``split`` tests rows by DataFrame operations; in a task
    ``hits`` tests the places that were sent along with the rows.
    """

    def __init__(self, keys: DataFrame, key: str, count: int):
        self.bits = min(max(LEAST_BITS, 1 << (8 * count).bit_length()), MOST_BITS)
        bit = self.place(key) + 1
        marks = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket"))
        self.marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))

    def place(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits)).cast("long")

    def sent(self):
        """The marks as one array, broadcast."""
        marked = np.zeros((self.bits // 8 // BUCKET, BUCKET), dtype=np.uint8)
        for bucket, part in self.marks.collect():
            marked[bucket - 1] = np.frombuffer(bytes(part), dtype=np.uint8)
        return self.marks.sparkSession.sparkContext.broadcast(marked.reshape(-1))

    def split(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """The rows whose key may be one of the keys, and the others; a NULL key is never one."""
        likely, others = self._marked(_packed(df, key))
        return likely.select("_row.*"), others.select("_row.*")

    def _marked(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``split`` of packed rows."""
        bit = self.place("_key") + 1
        at = F.bitmap_bit_position(bit)
        marked = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(self.marks), "_bucket", "left")
        byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)) & F.col("_key").isNotNull()
        return marked.where(hit).select("_key", "_row"), marked.where(~hit).select("_key", "_row")


def _packed(df: DataFrame, key: str) -> DataFrame:
    """The key and the whole row as one column, so that the row's columns may have any names."""
    return df.select(F.col(f"`{key}`").alias("_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def hits(marked: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The indexes of the marked places."""
    return np.flatnonzero(marked[places >> 3] >> (places & 7).astype(np.uint8) & 1)


def without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is not in the table ``keys``; rows with a NULL key stay. Other columns may have any names.

    Only rows that the filter marks are joined, so most rows are not shuffled.
    """
    listed = keys.select(F.col(f"`{key}`").alias("_key"))
    likely, others = KeyFilter(listed, "_key", listed.count())._marked(_packed(df, key))
    return others.unionByName(likely.join(listed.hint("merge"), "_key", "left_anti")).select("_row.*")
