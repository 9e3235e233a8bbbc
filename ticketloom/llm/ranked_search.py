"""Ranked lexical search without random reads (NRA) over impact-sorted lists.

Documents are indexed in blocks of bounded size, each by the task that reads them: for every term that some item asks, the
documents that hold it and how often. Counts over all documents (N, L, df) give every posting its impact. In a block each
list is sorted by falling impact and read from its head only, all lists of an item in turn and ever deeper. A document's
lower bound is what has been read of it, its upper bound adds the last impact read from each list in which it has not been
met. Reading goes on until every document whose upper bound reaches the k-th lower bound has equal bounds: then
membership, ties and final scores are certain. The k best of earlier blocks of a task raise that k-th bound from the start.

The k best per item of every task meet in a window by item, which Spark cuts to k rows per partition before its shuffle.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.memory import tidy
from ticketloom.sources.sinks import stored

#: Maximal runs of ASCII letters and digits and of all other characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same rule on bytes of UTF-8: small letters, separators as spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text cut into terms at a time.
PIECE = 1 << 20
DOCS_PER_BLOCK, POSTINGS_PER_BLOCK = 1 << 15, 1 << 20
#: Pairs of item and term that are sent to the tasks together; more go in several passes.
MOST_SENT = 1_000_000
#: Postings read from each list at first; the depth doubles.
FIRST_DEPTH = 256


def _term_counts(data: bytes) -> tuple[int, Counter]:
    """The number of terms, and each term's."""
    n, counts, at = 0, Counter(), 0
    data = data.translate(_FOLD)
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        n += len(words)
        counts.update(words)
        at = end
    return n, counts


class _Block:
    """Postings of the documents of a block, by term."""

    def __init__(self):
        self.keys, self.lengths = [], array("q")
        self.terms, self.rows, self.counts = array("i"), array("i"), array("q")

    def add(self, key, n: int, found: list[tuple[int, int]]) -> bool:
        """Adds a document; true when the block is full."""
        row = len(self.keys)
        self.keys.append(key)
        self.lengths.append(n)
        self.terms.extend(t for t, _ in found)
        self.counts.extend(c for _, c in found)
        self.rows.extend([row] * len(found))
        return len(self.keys) >= DOCS_PER_BLOCK or len(self.terms) >= POSTINGS_PER_BLOCK

    def batch(self, key_type: pa.DataType) -> pa.RecordBatch:
        terms = np.frombuffer(self.terms, dtype=np.int32) if self.terms else np.zeros(0, dtype=np.int32)
        order = np.argsort(terms, kind="stable")
        distinct, sizes = np.unique(terms, return_counts=True)
        rows = np.array(self.rows, dtype="<i4")[order]
        counts = np.array(self.counts, dtype="<i8")[order]
        lengths = np.array(self.lengths, dtype="<i8")
        columns = {
            "keys": pa.array([self.keys], pa.list_(key_type)),
            "n_docs": pa.array([len(lengths)], pa.int64()),
            "n_terms": pa.array([int(lengths.sum())], pa.int64()),
            "lengths": pa.array([lengths.tobytes()], pa.binary()),
            "terms": pa.array([distinct], pa.list_(pa.int32())),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "rows": pa.array([rows.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_BLOCK = "n_docs long, n_terms long, lengths binary, terms array<int>, sizes array<long>, rows binary, counts binary"


def index_blocks(documents: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of all documents with a term, with postings of the terms in ``vocabulary``."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)
    kind = documents.schema[key].dataType.simpleString()
    texts = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        known, block, key_type = sent.value, _Block(), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for one, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, counts = _term_counts(value.as_py())
                if not n:
                    continue
                found = [(known[t], counts[t]) for t in counts.keys() & known.keys()]
                if block.add(one, n, found):
                    yield block.batch(key_type)
                    block = _Block()
        if block.keys:
            yield block.batch(key_type)

    return texts.mapInArrow(tidy(run), f"keys array<{kind}>, {_BLOCK}")


def resolve(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of all documents that may be among the ``k`` best and score ``least`` or more, their scores final.

    Each list holds rows and their gains, by falling gain; it is only read forward.
    """
    lower = np.zeros(n_docs, dtype=np.int64)
    at, depth = 0, FIRST_DEPTH
    while True:
        unread = 0
        for rows, gains in lists:
            lower[rows[at:depth]] += gains[at:depth]
            unread += int(gains[depth - 1]) if depth < len(gains) else 0
        kth = int(np.partition(lower, n_docs - k)[n_docs - k]) if n_docs > k else 0
        bar = max(kth, least, 1)
        upper = lower + unread
        for rows, gains in lists:
            if depth < len(gains):
                upper[rows[:depth]] -= gains[depth - 1]
        alive = upper >= bar
        if not (alive & (upper > lower)).any():
            rows = np.flatnonzero(alive)
            return rows, lower[rows]
        at, depth = depth, depth * 2


class _Best:
    """The k best documents of an item so far; equal scores by ascending key, NULL keys last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def offer(self, keys: pa.Array, rows: np.ndarray, scores: np.ndarray) -> None:
        if len(rows):
            fresh = zip((-scores).tolist(), keys.take(pa.array(rows)).to_pylist())
            self.rows = heapq.nsmallest(self.k, [*self.rows, *((s, one is None, one) for s, one in fresh)])


def _lists(block: pa.RecordBatch, row: int, n_docs: int, n_terms: int) -> tuple[pa.Array, int, dict]:
    """(keys, documents, impact-sorted postings by term) of a block."""
    lengths = np.frombuffer(block.column("lengths")[row].as_buffer(), dtype="<i8")
    rows = np.frombuffer(block.column("rows")[row].as_buffer(), dtype="<i4")
    counts = np.frombuffer(block.column("counts")[row].as_buffer(), dtype="<i8")
    terms = block.column("terms")[row].values.to_numpy()
    sizes = block.column("sizes")[row].values.to_numpy()
    m = 100 - 90 + 90 * lengths * n_docs // n_terms
    impact = 1_000_000_000 * counts // (1000 * counts + 8 * m[rows])
    order = np.lexsort((-impact, np.repeat(np.arange(len(terms)), sizes)))
    rows, impact, ends = rows[order], impact[order], np.cumsum(sizes)
    found = {t: (rows[e - s : e], impact[e - s : e]) for t, s, e in zip(terms.tolist(), sizes.tolist(), ends.tolist())}
    return block.column("keys")[row].values, len(lengths), found


def _best_of_task(batches, items: list[list[int]], weights: list[int], n_docs: int, n_terms: int, k: int):
    best = [_Best(k) for _ in items]
    key_type = None
    for batch in batches:
        key_type = batch.schema.field("keys").type.value_type
        for row in range(batch.num_rows):
            keys, size, postings = _lists(batch, row, n_docs, n_terms)
            for mine, terms in zip(best, items):
                lists = [(postings[t][0], weights[t] * postings[t][1]) for t in terms if t in postings and weights[t]]
                if lists:
                    mine.offer(keys, *resolve(lists, size, k, mine.least))
    hits = [(i, one, -s) for i, mine in enumerate(best) for s, _, one in mine.rows]
    if hits:
        numbers, keys, scores = zip(*hits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(keys, key_type), pa.array(scores, pa.int64())], ["item", "key", "score"]
        )


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term) pairs, each once."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), _CAPITALS, _SMALL)
    found = F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))
    return items.select(F.col(key).alias("item"), F.explode(found).alias("term")).distinct()


def _some_items(documents: DataFrame, key: str, text: str, pairs: DataFrame, k: int) -> DataFrame:
    """(item, key, score) of the k best of every task, for items whose terms may be sent."""
    spark = documents.sparkSession
    asked = pairs.groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms")).collect()
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in asked for t in r["terms"]}))}
    blocks = stored(index_blocks(documents, key, text, {t.encode(): i for t, i in vocabulary.items()}), "index-blocks")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    spans = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("of")).select("of.terms", "of.sizes")
    weights = [0] * len(vocabulary)
    for term, df in spans.groupBy("terms").agg(F.sum("sizes")).collect():  # a row per term that was sent
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    sent = spark.sparkContext.broadcast(([[vocabulary[t] for t in r["terms"]] for r in asked], weights))

    def run(batches):
        return _best_of_task(batches, *sent.value, n_docs, n_terms, k)

    kind = documents.schema[key].dataType.simpleString()
    hits = blocks.drop("n_docs", "n_terms").mapInArrow(tidy(run), f"item int, key {kind}, score long")
    schema = f"number int, item {pairs.schema['item'].dataType.simpleString()}"
    names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(asked)], schema)
    hits = hits.withColumnRenamed("item", "number").join(F.broadcast(names), "number")
    return hits.select("item", "key", "score")


def ranked(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, k: int = 10,
    most_sent: int = MOST_SENT,
) -> DataFrame:
    """(item key, rank, key, score): the ``k`` best documents of each item with a score above 0, the best first.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z. A term that df of N documents
    hold weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document of n of all L terms that holds it tf times adds the
    weight times 10^9 tf div (1000 tf + 8 (10 + 90 n N div L)). Equal scores rank by ascending key, NULL keys last. A NULL
    text or one without terms counts nowhere. Documents with equal keys are ranked each. Rows with equal item keys, or
    with none, are one item with the terms of all; an item without terms, or with none that a document holds, has no rows.
    Other columns are not read. The pairs of item and term go to the tasks, ``most_sent`` about at a time.
    """
    pairs = _item_terms(items, item_key, item_text)
    passes = max(1, -(-pairs.count() // most_sent))
    deal = F.pmod(F.xxhash64("item"), F.lit(passes))
    parts = [_some_items(documents, key, text, pairs.where(deal == i), k) for i in range(passes)]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")
