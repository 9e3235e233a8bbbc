"""Similarity join of texts by the Jaccard coefficient of their word shingles.

1.  Texts become sets of 64-bit shingle hashes; equal sets are one class from there on.
2.  Two sets that reach the threshold share one of their first few shingles under any fixed order. The order puts shingles
    that a sketch of fixed size shows to be frequent last, so shared passages rarely lead a set.
3.  Sets that share a leading shingle are candidates. Small groups give their pairs. Large ones are first linked to two
    pivots; what remains apart is compared in size-banded tiles.
4.  In a tile, hashed bitmaps bound the overlap from above by counting bits; only pairs that could reach the threshold
    go on to the exact intersection of the sorted hash arrays.
5.  Links become connected components.

No candidate, partner or group is capped: large groups only take the other way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import tiles
from ticketloom.llm.graph import connected_components
from ticketloom.llm.memory import tidy
from ticketloom.llm.shingles import Shingler
from ticketloom.sources.sinks import stored

#: Buckets of each of the two rows of the frequency sketch.
SKETCH = 1 << 16
#: 64-bit words of bitmaps that are combined at a time in a tile (16 MB).
WORDS_PER_STEP = 1 << 21
#: Groups of up to this many sets give all their pairs at once.
SMALL_GROUP = 8
#: Members of a group that a task takes at most.
MOST_POSTINGS = 200_000
BLOOM_BITS = 1 << 23
#: Bytes of one of Spark's bitmap buckets.
BITMAP_BYTES = 4096


@dataclass(frozen=True)
class Threshold:
    """Jaccard coefficient of at least ``over`` / ``under``, in whole numbers."""

    over: int = 75
    under: int = 100

    def leading(self, n: int) -> int:
        """How many of the first shingles of a set of ``n`` must be looked at."""
        return n - -(-self.over * n // self.under) + 1

    def overlap(self, a, b):
        """The least intersection that links sets of these sizes."""
        return -(-self.over * (a + b) // (self.over + self.under))

    def sizes_fit(self, a, b):
        return self.under * np.minimum(a, b) >= self.over * np.maximum(a, b)

    def band(self, n: Column):
        """Sizes that can link are in the same or in neighbouring bands."""
        return F.floor(F.log(n) / math.log(self.under / self.over) - 1e-9).cast("int")


def _buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(16)) & np.uint64(SKETCH - 1), (hashes >> np.uint64(40)) & np.uint64(SKETCH - 1)


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For both rows of the sketch the level of every bucket: 0 as filled by chance, else by powers of two above it.

    Each task adds up its own buckets, so what is shuffled depends on the number of tasks and not on the texts.
    """

    def run(batches):
        shingler, first, second = Shingler(), np.zeros(SKETCH, dtype=np.int64), np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for hashes in shingler.sets(batch.column(0).slice(at, 500).to_pylist()):
                    a, b = _buckets(hashes)
                    np.add.at(first, a.astype(np.int64), 1)
                    np.add.at(second, b.astype(np.int64), 1)
        for row, counts in ((0, first), (1, second)):
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used + row * SKETCH, pa.int32()), pa.array(counts[used], pa.int64())], ["bucket", "n"]
            )

    sums = texts.mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(2 * SKETCH)
    for bucket, n in sums.collect():  # 2 * SKETCH rows at most
        counts[bucket] = n
    levels = []
    for row in (counts[:SKETCH], counts[SKETCH:]):
        usual = float(np.median(row))
        chance = usual + 6 * math.sqrt(usual) + 64
        levels.append(np.where(row > chance, np.log2(np.maximum(row - usual, 1)).astype(np.int64) + 1, 0))
    return levels[0], levels[1]


def _leading(hashes: np.ndarray, levels: tuple[np.ndarray, np.ndarray], count: int) -> np.ndarray:
    """The first ``count`` hashes in the order of (level, hash)."""
    a, b = _buckets(hashes)
    level = np.minimum(levels[0][a.astype(np.int64)], levels[1][b.astype(np.int64)])
    if not level.any():
        return hashes[:count]
    return hashes[np.lexsort((hashes, level))[:count]]


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits at the hashes modulo a power of two of at least twice the set's size, from 256 to 65,536."""
    bits = min(max(256, 1 << (2 * len(hashes) + 1).bit_length()), 1 << 16)
    out = np.zeros(bits, dtype=bool)
    out[(hashes % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def _narrowed(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap folded to ``words`` 64-bit words."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), axis=0)


def _sets(docs: DataFrame, levels, limit: Threshold) -> DataFrame:
    """(id, n, d1, d2, bitmap, leading): size, digest, bitmap and leading shingles of every row's set."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 500):
                sets = shingler.sets(batch.column(1).slice(at, 500).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, 500),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.int64()),
                        pa.array([_bitmap(s).tobytes() for s in sets], pa.binary()),
                        pa.array(
                            [_leading(s, sent.value, limit.leading(len(s)) if len(s) else 0).view(np.int64) for s in sets],
                            pa.list_(pa.int64()),
                        ),
                    ],
                    ["id", "n", "d1", "d2", "bitmap", "leading"],
                )

    return docs.mapInArrow(tidy(run), "id long, n int, d1 long, d2 long, bitmap binary, leading array<long>")


def _digest(hashes: np.ndarray) -> int:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return int(np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(32))).view(np.int64)) if len(hashes) else 0


PAIR = "a long, b long, n_a int, n_b int"
GROUPS = f"tile long, {PAIR}"


def _groups(classes: DataFrame, limit: Threshold) -> DataFrame:
    """Candidates from classes that share a leading shingle: pairs (a, b) of small groups with a NULL tile, and members b
    of large groups with the tile and its pivot a; n_a and n_b are their sizes. A tile is named by its members, so equal
    groups are one tile.

    A group of up to MOST_POSTINGS lies in one task. The members of a larger one stay where they are: its pivot and name are
    added up in the tasks and sent to them.
    """
    postings = classes.select(F.explode("leading").alias("shingle"), "id", "n")
    hot = _hot(postings)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usual = postings if hot is None else postings.join(F.broadcast(hot), "shingle", "left_anti")
    sorted_postings = usual.repartition(parts, "shingle").sortWithinPartitions("shingle", "id")

    def run(batches):
        held = []
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(3)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last group may go on
            if cut or held and held[-1][0][-1] != columns[0][0]:
                held.append([c[:cut] for c in columns])
                yield from _emit([np.concatenate(c) for c in zip(*held)], limit)
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield from _emit([np.concatenate(c) for c in zip(*held)], limit)

    found = sorted_postings.mapInArrow(tidy(run), GROUPS)
    return (found if hot is None else found.unionByName(_members(postings, hot))).distinct()


def _hot(postings: DataFrame) -> DataFrame | None:
    """(shingle) of the groups with more than MOST_POSTINGS members; None without any. Buckets of shingles are counted first,
    of which there are SKETCH whatever the input, then the shingles of large buckets."""
    bucket = F.pmod("shingle", F.lit(SKETCH))
    sizes = postings.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    large = [r["bucket"] for r in sizes.where(F.col("n") > MOST_POSTINGS).collect()]
    if not large:
        return None
    counts = postings.where(bucket.isin(large)).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(counts.where(F.col("n") > MOST_POSTINGS).select("shingle"), "hot-shingles")
    return None if hot.isEmpty() else hot


def _members(postings: DataFrame, hot: DataFrame) -> DataFrame:
    """The members of large groups beside the tile and its pivot."""
    mine = postings.join(F.broadcast(hot), "shingle")
    name = F.xxhash64(F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64(F.lit(1), "id")), F.count(F.lit(1)))
    groups = stored(mine.groupBy("shingle").agg(name.alias("tile"), F.min(F.struct("id", "n")).alias("p")), "hot-groups")
    return mine.join(F.broadcast(groups), "shingle").select(
        "tile", F.col("p.id").alias("a"), F.col("id").alias("b"), F.col("p.n").alias("n_a"), F.col("n").alias("n_b")
    )


def _emit(columns: list[np.ndarray], limit: Threshold):
    shingle, ids, sizes = columns
    edges = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1], [True]]))
    counts = np.diff(edges)
    tile, left, right = [], [], []
    for m in range(2, SMALL_GROUP + 1):
        heads = edges[:-1][counts == m]
        for i in range(m):
            for j in range(i + 1, m):
                fit = limit.sizes_fit(sizes[heads + i], sizes[heads + j]) & (ids[heads + i] != ids[heads + j])
                left.append(heads[fit] + i)
                right.append(heads[fit] + j)
                tile.append(np.zeros(len(left[-1]), dtype=np.int64))
    small = sum(map(len, tile))
    for head, end in zip(edges[:-1][counts > SMALL_GROUP], edges[1:][counts > SMALL_GROUP]):
        mixed = ids[head:end].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        name = np.sum((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64).view(np.int64)
        tile.append(np.full(end - head, name))
        left.append(np.full(end - head, head))
        right.append(np.arange(head, end))
    if not sum(map(len, tile)):
        return
    tile, left, right = np.concatenate(tile), np.concatenate(left), np.concatenate(right)
    columns = [pa.array(tile, mask=np.arange(len(tile)) < small), ids[left], ids[right], sizes[left], sizes[right]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tile", "a", "b", "n_a", "n_b"])


def _bits_allow(pairs: DataFrame, known: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps could reach the threshold."""
    left = known.select(F.col("id").alias("a"), F.col("bitmap").alias("bits_a"))
    right = known.select(F.col("id").alias("b"), F.col("bitmap").alias("bits_b"))
    fit = F.least("n_a", "n_b") * limit.under >= F.greatest("n_a", "n_b") * limit.over
    joined = pairs.where(fit & (F.col("a") != F.col("b"))).distinct().join(left, "a").join(right, "b")

    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            sizes = [batch.column(k).to_numpy().astype(np.int64) for k in (2, 3)]
            need = limit.overlap(*sizes)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(4)[i].as_py(), dtype=np.uint64)
                y = np.frombuffer(batch.column(5)[i].as_py(), dtype=np.uint64)
                words = min(len(x), len(y))
                x, y = _narrowed(x, words), _narrowed(y, words)
                missing_x = int(np.bitwise_count(x & ~y).sum())
                missing_y = int(np.bitwise_count(y & ~x).sum())
                keep[i] = min(sizes[0][i] - missing_x, sizes[1][i] - missing_y) >= need[i]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    return joined.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(tidy(run), "a long, b long")


def _arrays(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, hashes) of the rows with these ids. A Bloom filter of fixed size keeps most other texts from being shingled."""
    bit = (F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS)) + 1).cast("long")
    marks = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
    rows = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros((BLOOM_BITS // 8 // BITMAP_BYTES, BITMAP_BYTES), dtype=np.uint8)
    for bucket, part in rows:
        bits[bucket - 1] = np.frombuffer(bytes(part), dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def run(batches):
        shingler, marked = Shingler(), sent.value
        for batch in batches:
            at = batch.column(2).to_numpy() - 1
            hit = np.flatnonzero(marked[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for start in range(0, len(hit), 500):
                some = pa.array(hit[start : start + 500])
                sets = shingler.sets(batch.column(1).take(some).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(some), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "hashes"]
                )

    return docs.select("id", "text", bit.alias("bit")).mapInArrow(tidy(run), "id long, hashes binary")


def _links(docs: DataFrame, allowed: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a, b), of those that bitmaps allow, that reach the threshold by exact intersection."""
    allowed = stored(allowed, "allowed")
    arrays = stored(_arrays(docs, allowed.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "arrays")
    left = arrays.select(F.col("id").alias("a"), F.col("hashes").alias("set_a"))
    right = arrays.select(F.col("id").alias("b"), F.col("hashes").alias("set_b"))
    joined = allowed.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_py(), dtype=np.uint64)
                y = np.frombuffer(batch.column(3)[i].as_py(), dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                keep[i] = int((both[1:] == both[:-1]).sum()) >= limit.overlap(len(x), len(y))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return stored(joined.mapInArrow(tidy(run), "a long, b long"), "links")


def _tile_pairs(apart: DataFrame, known: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs of different components inside one large group that their bitmaps allow.

    A group of one chunk is one tile. A larger one is tiled by size bands, and inside bands by chunks. Bitmaps join the
    rows last, when these are in their tiles.
    """
    sizes = apart.groupBy("tile").agg(F.count(F.lit(1)).alias("rows"))
    banded = F.when(F.col("rows") > tiles.ROWS_PER_CHUNK, limit.band(F.col("n"))).otherwise(0)
    rows = apart.join(sizes, "tile").withColumn("cell", banded)
    dealt = tiles.tiled(rows.select("tile", "cell", "id", "n", "component"), ["tile"], "id")
    dealt = dealt.join(known.select("id", "bitmap"), "id")

    def compare(table):
        chunk, own = table["chunk"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
        ids, n, part = (table[c].to_numpy().astype(np.int64) for c in ("id", "n", "component"))
        maps = [np.frombuffer(m.as_py(), dtype=np.uint64) for m in table["bitmap"]]
        widths = np.array([len(m) for m in maps])
        split = table["low"][0].as_py() != table["high"][0].as_py()
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        for words in np.unique(widths):  # sizes that fit have bitmaps of the same width or of the next one
            mine, others = np.flatnonzero(widths == words), np.flatnonzero((widths == words) | (widths == 2 * words))
            bits = np.stack([_narrowed(maps[i], words) for i in others])
            ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            inner = np.flatnonzero(widths[others] == words)
            step = max(1, WORDS_PER_STEP // (len(others) * int(words)))
            for at in range(0, len(mine), step):
                i, x = mine[at : at + step], inner[at : at + step]
                inter = np.bitwise_count(bits[x, None, :] & bits[None, :, :]).sum(axis=2, dtype=np.int64)
                bound = np.minimum(n[i, None] - ones[x, None] + inter, n[None, others] - ones[None, :] + inter)
                ok = (bound >= limit.overlap(n[i, None], n[None, others])) & limit.sizes_fit(n[i, None], n[None, others])
                ok &= (ids[i, None] < ids[None, others]) | (widths[None, others] > words)
                ok &= (part[i, None] != part[None, others]) & (own[i, None] | own[None, others])
                if split:
                    ok &= chunk[i, None] != chunk[None, others]
                left, right = np.nonzero(ok)
                first, second = i[left], others[right]
                swap = ids[first] > ids[second]
                found.append((np.where(swap, second, first), np.where(swap, first, second)))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": ids[a], "b": ids[b], "n_a": n[a].astype(np.int32), "n_b": n[b].astype(np.int32)})

    return dealt.groupBy("tile", "cell", "low", "high").applyInArrow(compare, PAIR)


def similar_groups(df: DataFrame, key: str, text: str, limit: Threshold = Threshold()) -> DataFrame:
    """(key, n_shingles, component_id) for every row.

    A row's set holds the distinct five-word shingles of its whole text; a shorter text is one shingle. ``key`` is a whole
    number; ``component_id`` is the smallest key that links reach. A NULL or wordless text has the empty set and links with
    nothing; a row with a NULL key links with nothing and has a NULL component. Rows with the same key stand for one
    document. Other columns are not read.
    """
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    levels = _frequent(docs.select("text"))
    sets = stored(_sets(docs, levels, limit), "sets")
    digest = ["d1", "d2", "n"]
    filled = sets.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = stored(filled.groupBy(*digest).agg(F.min("id").alias("id")), "classes")
    named = ["id", *digest]
    chosen = filled.join(classes, named, "left_semi").groupBy(*named).agg(F.first("leading").alias("leading"))
    chosen = stored(chosen, "chosen")
    groups = stored(_groups(chosen, limit), "groups")
    involved = stored(groups.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
    known = stored(sets.join(classes, named, "left_semi").join(involved, "id", "left_semi")
                   .groupBy("id", "n").agg(F.first("bitmap").alias("bitmap")), "known")
    large = groups.where("tile IS NOT NULL").select("tile", "a", "n_a", F.col("b").alias("id"), F.col("n_b").alias("n"))
    # A row per tile; written, so that Spark sends it to the tasks while it is small.
    second = stored(large.groupBy("tile").agg(F.min_by(F.struct("id", "n"), F.xxhash64("id")).alias("p")), "pivots")
    # Groups with the same two pivots are nearly the same sets; together they are one tile, in which all of them meet.
    merged = large.join(second, "tile").select(
        F.xxhash64("a", "p.id").alias("tile"), "a", "n_a", F.col("p.id").alias("p"), F.col("p.n").alias("n_p"), "id", "n"
    )
    members = stored(merged.distinct(), "members")
    first = members.select("a", F.col("id").alias("b"), "n_a", F.col("n").alias("n_b"))
    other = members.select(F.col("p").alias("a"), F.col("id").alias("b"), F.col("n_p").alias("n_a"), F.col("n").alias("n_b"))
    pairs = groups.where("tile IS NULL").select("a", "b", "n_a", "n_b").unionByName(first).unionByName(other)
    links = _links(docs, _bits_allow(pairs, known, limit), limit)
    apart = stored(_apart(members.select("tile", "id", "n"), connected_components(links)), "apart")
    if not apart.isEmpty():
        allowed = _tile_pairs(apart, known, limit).select("a", "b").distinct()
        links = links.unionByName(_links(docs, allowed, limit))
    components = connected_components(links).withColumnRenamed("node", "id")
    reached = classes.join(components, "id", "left").select(*digest, F.coalesce("component", "id").alias("component"))
    out = sets.select(*named).join(reached, digest, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def _apart(members: DataFrame, components: DataFrame) -> DataFrame:
    """(tile, id, n, component) of the groups whose members are not all in one component yet."""
    tied = members.join(components.withColumnRenamed("node", "id"), "id", "left")
    tied = stored(tied.select("tile", "id", "n", F.coalesce("component", "id").alias("component")), "tied")
    ends = tied.groupBy("tile").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return tied.join(stored(ends.where("low != high").select("tile"), "open-tiles"), "tile")
