"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal content) are sized by one aggregation. Groups above a small share of the total are packed one by
one; the rest are hashed into a fixed number of bundles, so the packing list has a proven bound whatever the input. The
list is packed on the driver, largest first, each item into the bin with the least room that still takes it; the bins are
kept in a balanced tree ordered by room.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.sources.sinks import stored

#: Bundles of small groups per shard, and rows numbered in one task.
BUNDLES_PER_SHARD = 256
ROWS_PER_SLICE = 100_000


class RoomTree:
    """A treap of (room, bin): the bin with the least room of at least some size is found in logarithmic time."""

    __slots__ = ("root", "draw")

    def __init__(self):
        self.root = None
        self.draw = random.Random(0).random

    def insert(self, key: tuple[int, int]) -> None:
        below, above = self._split(self.root, key)
        self.root = self._join(self._join(below, [key, self.draw(), None, None]), above)

    def take(self, room: int) -> tuple[int, int] | None:
        """Removes and returns the smallest key with at least ``room``."""
        below, rest = self._split(self.root, (room, -1))
        if rest is None:
            self.root = below
            return None
        first, parent = rest, None
        while first[2] is not None:
            first, parent = first[2], first
        if parent is None:
            rest = first[3]
        else:
            parent[2] = first[3]
        self.root = self._join(below, rest)
        return first[0]

    def _split(self, node, key):
        """(keys below ``key``, the others)."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], above = self._split(node[3], key)
            return node, above
        below, node[2] = self._split(node[2], key)
        return below, node

    def _join(self, below, above):
        if below is None or above is None:
            return above if below is None else below
        if below[1] < above[1]:
            below[3] = self._join(below[3], above)
            return below
        above[2] = self._join(below, above[2])
        return above


def best_fit_decreasing(sizes: Sequence[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of every item. A larger item than ``capacity`` gets a bin of its own. None if ``most`` bins don't do."""
    tree, bins, n, least = RoomTree(), [0] * len(sizes), 0, min(sizes, default=0)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[item])
        if found is None:
            found, n = (capacity, n), n + 1
            if most is not None and n > most:
                return None
        room, where = found
        bins[item] = where
        if room - sizes[item] >= least:
            tree.insert((room - sizes[item], where))
    return bins


def least_capacity(sizes: Sequence[int], shards: int) -> list[int]:
    """Bins 0 to ``shards`` - 1 for all items under the least capacity that the search finds.

    Items above an even share first get a shard each; the search goes on with the others.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins, alone, rest = [0] * len(sizes), 0, sum(sizes)
    while alone < min(len(order), shards - 1) and sizes[order[alone]] * (shards - alone) > rest:
        bins[order[alone]] = alone
        rest -= sizes[order[alone]]
        alone += 1
    others, free = order[alone:], shards - alone
    if not others:
        return bins
    small = [sizes[i] for i in others]
    low = max(small[0], -(-rest // free))
    high, placed = low, best_fit_decreasing(small, low, free)
    step = max(1, low // 10_000)
    while placed is None:
        low, high = high + 1, high + step
        step *= 2
        placed = best_fit_decreasing(small, high, free)
    while low < high and high - low > max(1, high // 100_000):
        middle = (low + high) // 2
        tried = best_fit_decreasing(small, middle, free)
        if tried is None:
            low = middle + 1
        else:
            high, placed = middle, tried
    for item, where in zip(others, placed):
        bins[item] = alone + where
    return bins


@dataclass(frozen=True)
class Grouped:
    """Rows with ``_group`` (a digest of the content), and the packing items: big groups one by one, small ones by bundle."""

    rows: DataFrame
    items: DataFrame
    bundles: int


def grouped(df: DataFrame, content: Column, size: Column, shards: int, keep: list[Column]) -> Grouped:
    """``keep`` columns, ``size`` and the group of every row. Rows with NULL content are one group."""
    digest = F.coalesce(F.md5(content.cast("binary")), F.lit(""))
    rows = df.select(*keep, size.cast("long").alias("size"), digest.alias("_group"))
    bundles = shards * BUNDLES_PER_SHARD
    groups = rows.groupBy("_group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    groups = stored(groups, "shard-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    # At most shards * BUNDLES_PER_SHARD groups can be larger than this share.
    big = F.col("bytes") * bundles > F.lit(total)
    items = groups.select(
        F.when(big, F.col("_group")).otherwise(_bundle(bundles)).alias("item"), "bytes", "rows"
    )
    return Grouped(rows, items.groupBy("item").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")), bundles)


def _bundle(bundles: int) -> Column:
    return F.concat(F.lit("#"), F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("string"))


def _placed(found: Grouped, pack) -> DataFrame:
    spark = found.rows.sparkSession
    items = found.items.collect()  # twice shards * BUNDLES_PER_SHARD rows at most
    items.sort(key=lambda r: r["item"])
    where = pack([r["bytes"] for r in items])
    names = [r["item"] for r in items]
    table = spark.createDataFrame(list(zip(names, map(int, where))), "item string, shard int")
    own = F.broadcast(table.select(F.col("item").alias("_group"), F.col("shard").alias("_own")))
    bundle = F.broadcast(table.select(F.col("item").alias("_bundle"), F.col("shard").alias("_shared")))
    rows = found.rows.withColumn("_bundle", _bundle(found.bundles))
    joined = rows.join(own, "_group", "left").join(bundle, "_bundle", "left")
    return joined.withColumn("shard", F.coalesce("_own", "_shared")).drop("_bundle", "_own", "_shared")


def _with_slots(rows: DataFrame, key: str) -> DataFrame:
    """``slot``: the place of a row inside its shard, from 0 without gaps.

    Rows are numbered inside slices of a shard, chosen by hash, and the counts of the slices before are added, so neither
    a shard nor a group of copies is numbered in one task.
    """
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-most // ROWS_PER_SLICE))
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(key, "_tie"), F.lit(slices)).cast("int"))
    counts = sliced.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_slice").orderBy(key, "_tie")
    numbered = sliced.withColumn("_place", F.row_number().over(inside) - 1)
    out = numbered.join(F.broadcast(starts), ["shard", "_slice"])  # rows / ROWS_PER_SLICE + shards rows
    return out.withColumn("slot", F.col("_start") + F.col("_place")).drop("_slice", "_start", "_place", "_tie")


def even_shards(df: DataFrame, key: str, content: str, size: Column, shards: int, keep: list[Column]) -> DataFrame:
    """Every row with ``size``, ``shard`` (0 to ``shards`` - 1) and ``slot``; rows with equal content share a shard.

    Shards get near equal sums of ``size``. A group above an even share is a shard of its own. Rows with NULL content are
    one group; an empty table gives no rows; a NULL key is an ordinary row; repeated rows are placed each. Columns of
    ``df`` other than ``keep`` are not read.
    """
    found = grouped(df, F.col(content), size, shards, [F.col(key), *keep])
    return _sharded(found, key, lambda sizes: least_capacity(sizes, shards))


def fixed_capacity_shards(
    df: DataFrame, key: str, content: str, size: Column, capacity: int, keep: list[Column]
) -> DataFrame:
    """As ``even_shards``, but with as few shards of ``capacity`` as best fit needs; a larger group fills its own."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    found = grouped(df, F.col(content), size, max(1, -(-total // capacity)), [F.col(key), *keep])
    return _sharded(found, key, lambda sizes: best_fit_decreasing(sizes, capacity))


def _sharded(found: Grouped, key: str, pack) -> DataFrame:
    placed = _placed(found, pack)
    # Rows with the same key and content are alike, so their order does not matter.
    return _with_slots(placed.withColumn("_tie", F.xxhash64("_group")), key).drop("_group")
