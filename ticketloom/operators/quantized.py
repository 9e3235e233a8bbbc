"""Exact search over compressed vectors, by bounds that skip cells and rows.

Vectors are dealt to cells around coarse centres. What is left of a vector is cut into short parts, and each part becomes
the number of its nearest code, so 64 components take 16 bytes. A row also stores how far its codes are from it. With the
length of a query this bounds the inner product from both sides, and a cell's radius bounds that of all its rows.

A search lays the whole vectors beside the coded rows and first scores each query's most promising cells; the k-th score
there is a limit that the k-th best vector reaches at least. Then it scans only cells whose bound reaches the limit, and
scores only rows whose upper bound does. Every task keeps k hits per query, so what it gives does not grow with the number
of rows that the bounds leave. The hits are those of a search through all vectors; the centres and codes, which are fitted
on a bounded sample, only decide how much is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticketloom.operators import ranking
from ticketloom.operators.dense import MAX_SENT_COMPONENTS, matrix
from ticketloom.operators.topk import BLOCK_CELLS, DIGITS, TILE_QUERIES, best_products, block_best, k_best, merge_best
from ticketloom.sources import sinks

CELLS, PART, CODES = 16, 4, 256
#: Vectors that centres and codes are fitted on.
SAMPLE_ROWS = 50_000
#: Cells that the first scan of a query reads.
FIRST_PROBES = 2
_SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of at most ``k`` groups of the rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(half - x[a : a + 20_000] @ centres.T).argmin(axis=1) for a in range(0, max(len(x), 1), 20_000)])


@dataclass(frozen=True)
class Quantizer:
    """Cell centres, and per part of a vector its codes."""

    centres: np.ndarray
    books: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance from its centre, codes, distance from what the codes say) of every row."""
        cell = _nearest(x, self.centres)
        left = x - self.centres[cell]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        rest, at = left.copy(), 0
        for i, book in enumerate(self.books):
            part = slice(at, at + book.shape[1])
            codes[:, i] = _nearest(left[:, part], book)
            rest[:, part] -= book[codes[:, i]]
            at += book.shape[1]
        return cell, np.linalg.norm(left, axis=1), codes, np.linalg.norm(rest, axis=1)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.hstack([book[codes[:, i]] for i, book in enumerate(self.books)])


def fit_quantizer(corpus: DataFrame, vector: str, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> Quantizer:
    """From about ``sample_rows`` vectors, drawn by the hash of their components."""
    if not 1 <= cells <= 1 << 15:
        raise ValueError("between 1 and 32768 cells")
    known = corpus.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    n = known.count()
    steps = 1 << 30
    share = F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(steps)) < int(steps * min(1.0, sample_rows / max(n, 1)))
    rows = known.where(share).toArrow()["v"]
    x = matrix(rows) if len(rows) else np.zeros((0, 1))
    x = np.unique(x, axis=0)  # in an order of its own, whatever that of the scan
    rng = np.random.default_rng(seed)
    if not len(x):
        return Quantizer(np.zeros((1, 1)), [np.zeros((1, 1))])
    centres = _kmeans(x, cells, rng)
    left = x - centres[_nearest(x, centres)]
    books = [_kmeans(left[:, a : a + PART], CODES, rng) for a in range(0, x.shape[1], PART)]
    return Quantizer(centres, books)


@dataclass(frozen=True)
class VectorIndex:
    """Coded rows (id, codes, error, by cell) in a folder, their quantizer, and the radius of every cell."""

    spark: SparkSession
    path: str
    quantizer: Quantizer
    radius: np.ndarray
    schema: StructType

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        table = self.spark.read.schema(self.schema).parquet(self.path)
        return table if cells is None else table.where(F.col("cell").isin(*cells))


def write_index(corpus: DataFrame, key: str, vector: str, path: str, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> VectorIndex:
    """Codes every vector of the corpus; NULL vectors are left out. Cells are folders, so a search reads those it needs."""
    quantizer = fit_quantizer(corpus, vector, cells, sample_rows, seed)
    kind = corpus.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell, away, codes, error = quantizer.encode(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(error), pa.array(away), pa.array(cell.astype(np.int32)),
                    ],
                    ["id", "codes", "error", "away", "cell"],
                )

    rows = corpus.select(key, vector).where(F.col(vector).isNotNull())
    coded = rows.mapInArrow(run, f"id {kind}, codes binary, error double, away double, cell int")
    coded.write.partitionBy("cell").mode("errorifexists").parquet(path)
    table = corpus.sparkSession.read.schema(coded.schema).parquet(path)
    radius = np.full(len(quantizer.centres), -1.0)  # a cell without rows
    for cell, away in table.groupBy("cell").agg(F.max("away")).collect():  # a row per cell
        radius[cell] = away
    return VectorIndex(corpus.sparkSession, path, quantizer, radius, coded.schema)


def _reach(index: VectorIndex, queries: np.ndarray) -> np.ndarray:
    """Queries x cells: the most that a vector of the cell can score."""
    most = queries @ index.quantizer.centres.T + np.linalg.norm(queries, axis=1)[:, None] * np.maximum(index.radius, 0)
    most[:, index.radius < 0] = -np.inf
    return most + _SLACK


def _scan(index: VectorIndex, asked, alive: np.ndarray, limit: np.ndarray | None, k: int, exclude_self: bool, kind: str, query_kind: str) -> DataFrame:
    """Of the cells that are ``alive`` (queries x cells): without a ``limit`` the k best lower bounds per query and task, else
    (query_id, doc_id) of the rows whose upper bound reaches the query's limit."""
    spark, quantizer = index.spark, index.quantizer
    sent = spark.sparkContext.broadcast((asked, alive, limit))
    centres, books = quantizer.centres, quantizer.books
    cells = np.flatnonzero(alive.any(axis=0)).tolist()

    def run(batches):
        (ids, queries), alive, limit = sent.value
        mine, norms, best = Quantizer(centres, books), np.linalg.norm(queries, axis=1), None
        step = max(1, BLOCK_CELLS // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                cell = part.column(3).to_numpy()
                near = mine.decode(cell, codes) @ queries.T
                room = part.column(2).to_numpy()[:, None] * norms + _SLACK
                seen = alive[:, cell].T
                if exclude_self:
                    seen &= keys[:, None] != ids
                if limit is None:
                    low = np.where(seen, near - room, -1e9)
                    row, query = block_best(low, keys, k)
                    score = low[row, query]
                    keep = score > -1e8
                    best = merge_best(best, query[keep], score[keep], keys[row][keep], k)
                else:
                    row, query = np.nonzero(seen & (near + room >= limit))
                    if len(row):
                        yield _pairs(ids[query], keys[row], np.zeros(len(row)))
        if best is not None and len(best[0]):
            yield _pairs(ids[best[0]], best[2], best[1])

    rows = index.rows(cells).select("id", "codes", "error", "cell")
    return rows.mapInArrow(run, f"query_id {query_kind}, doc_id {kind}, score double")


def _pairs(queries: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(docs), pa.array(scores)], ["query_id", "doc_id", "score"])


def candidates(
    index: VectorIndex, queries: DataFrame, query_key: str, query_vector: str, k: int, exclude_self: bool = False,
    max_sent: int = MAX_SENT_COMPONENTS,
) -> tuple[DataFrame, list[DataFrame]]:
    """(query_id, doc_id) of all rows that may be among the k best, and the sides of the queries that were sent, in parts of
    at most about ``max_sent`` components."""
    asked = queries.select(F.col(query_key).alias("query_id"), F.col(query_vector).alias("vector")).where(F.col("vector").isNotNull())
    size = asked.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    passes = max(1, -(-size // max_sent))
    kind = index.rows().schema["id"].dataType.simpleString()
    query_kind = asked.schema["query_id"].dataType.simpleString()
    sides = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) for i in range(passes)]
    found = None
    for side in sides:
        rows = side.toArrow()
        if not len(rows) or not (index.radius >= 0).any():
            continue
        ids, x = rows["query_id"].to_numpy(), matrix(rows["vector"])
        reach = _reach(index, x)
        first = np.zeros(reach.shape, dtype=bool)
        np.put_along_axis(first, np.argsort(-reach, axis=1, kind="stable")[:, :FIRST_PROBES], True, axis=1)
        scan = lambda alive, limit: _scan(index, (ids, x), alive, limit, k, exclude_self, kind, query_kind)  # noqa: B023
        best = ranking.rank_hits(scan(first, None), "query_id", k, F.col("score").desc(), F.col("doc_id"))
        table = best.toArrow()  # at most k rows per query sent
        query = np.searchsorted(np.sort(ids), table["query_id"].to_numpy())
        order = np.argsort(ids, kind="stable")[query] if len(table) else np.zeros(0, int)
        limit = np.full(len(ids), -np.inf)
        number, score, _ = k_best(order, table["score"].to_numpy(), table["doc_id"].to_numpy(), k)
        full = np.flatnonzero(np.bincount(number, minlength=len(ids)) >= k)
        lowest = np.full(len(ids), np.inf)
        np.minimum.at(lowest, number, score)
        limit[full] = lowest[full] - 10.0**-DIGITS  # scores are rounded before they are ranked
        part = scan(reach >= limit[:, None], limit).select("query_id", "doc_id")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.spark.createDataFrame([], f"query_id {query_kind}, doc_id {kind}")
    return found, sides


def _scored(index: VectorIndex, rows: DataFrame, asked, alive: np.ndarray, limit: np.ndarray | None, k: int, exclude_self: bool, schema: str) -> DataFrame:
    """The k best (query_id, doc_id, score) per query and task among the ``rows`` (id, codes, error, cell, vector) of the cells
    that are ``alive`` for the query; with a ``limit`` those that reach it."""
    sent = index.spark.sparkContext.broadcast((asked, alive, limit))
    centres, books = index.quantizer.centres, index.quantizer.books
    cells = np.flatnonzero(alive.any(axis=0)).tolist()

    def run(batches):
        (ids, queries), alive, limit = sent.value
        mine, best = Quantizer(centres, books), {}
        # A product with these is the most that a row can score: its codes' score and the room for their error.
        wide = np.hstack([queries, np.linalg.norm(queries, axis=1)[:, None]])
        for batch in batches:
            cell = batch.column(3).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            coded = np.hstack([mine.decode(cell, codes), batch.column(2).to_numpy()[:, None]]) if batch.num_rows else None
            keys, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(4))
            for c in np.unique(cell):
                rows, asking = np.flatnonzero(cell == c), np.flatnonzero(alive[:, c])
                for a in range(0, len(asking), TILE_QUERIES):
                    tile, near, floor = asking[a : a + TILE_QUERIES], rows, None
                    if limit is not None:
                        floor = limit[tile]
                        near = rows[(coded[rows] @ wide[tile].T + _SLACK >= floor).any(axis=1)]
                    best[c, a] = best_products(best.get((c, a)), keys[near], x[near], ids[tile], queries[tile], k, exclude_self, floor)
        for (c, a), found in best.items():
            if found is not None and len(found[0]):
                tile = np.flatnonzero(alive[:, c])[a : a + TILE_QUERIES]
                yield _pairs(ids[tile][found[0]], found[2], found[1])

    return rows.where(F.col("cell").isin(*cells)).mapInArrow(run, schema)


def search(
    index: VectorIndex, queries: DataFrame, query_key: str, query_vector: str, corpus: DataFrame, key: str, vector: str,
    k: int = 5, exclude_self: bool = False, max_sent: int = MAX_SENT_COMPONENTS,
) -> DataFrame:
    """Exact top k by inner product: (query_id, doc_id, score, rank). ``corpus`` holds the whole vectors of the index."""
    asked = queries.select(F.col(query_key).alias("query_id"), F.col(query_vector).alias("vector")).dropna()
    asked = asked.join(asked.select("query_id"), "query_id")  # ids that repeat find each hit once per pair of their rows
    coded = index.rows().select("id", "codes", "error", "cell")
    listed = corpus.select(F.col(key).alias("id"), F.col(vector).alias("_doc")).where(F.col("_doc").isNotNull())
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {coded.schema['id'].dataType.simpleString()}, score double"
    order = (F.col("score").desc(), F.col("doc_id"))
    size = asked.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    passes = max(1, -(-size // max_sent))
    found = index.spark.createDataFrame([], schema)
    if not (index.radius >= 0).any():
        return ranking.rank_hits(found, "query_id", k, *order)
    rows = sinks.stored(coded.join(listed, "id").select("id", "codes", "error", "cell", "_doc"), "coded-vectors")
    for i in range(passes):
        side = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow()
        if not len(side):
            continue
        ids, x = side["query_id"].to_numpy(), matrix(side["vector"])
        reach = _reach(index, x)
        first = np.zeros(reach.shape, dtype=bool)
        np.put_along_axis(first, np.argsort(-reach, axis=1, kind="stable")[:, :FIRST_PROBES], True, axis=1)
        hits = _scored(index, rows, (ids, x), first, None, k, exclude_self, schema)
        hits = sinks.stored(ranking.rank_hits(hits, "query_id", k, *order).drop("rank"), "first-hits")
        table = hits.select("query_id", "score").toArrow()  # at most k rows per query sent
        known, place = np.unique(ids, return_inverse=True)
        at = np.searchsorted(known, table["query_id"].to_numpy())
        lowest = np.full(len(known), np.inf)
        np.minimum.at(lowest, at, table["score"].to_numpy())
        limit = np.where(np.bincount(at, minlength=len(known)) >= k, lowest - 10.0**-DIGITS, -np.inf)[place]
        rest = _scored(index, rows, (ids, x), (reach >= limit[:, None]) & ~first, limit, k, exclude_self, schema)
        found = found.unionByName(hits).unionByName(rest)
    return ranking.rank_hits(found, "query_id", k, *order)
