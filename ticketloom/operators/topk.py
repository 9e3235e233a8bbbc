"""Keeping the k best candidates per query inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores are rounded before ranking, so that equal inputs tie whatever the order of summation.
DIGITS = 6
#: Cells of the dense block (candidates x queries) that a task scores at a time.
BLOCK_CELLS = 4_000_000
#: Queries that are scored at a time, and rows of the first block, which has no limits yet.
TILE_QUERIES, FIRST_ROWS = 2048, 512

#: Most hits that are sent to the tasks of the table they are looked up in.
MAX_SENT_HITS = 1_000_000


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores from 0 up with DIGITS places, halves up; ``rounded_column`` rounds alike."""
    return np.floor(scores * 10**DIGITS + 0.5) / 10**DIGITS


def rounded_column(score: Column) -> Column:
    return F.floor(score * F.lit(10.0**DIGITS) + F.lit(0.5)) / F.lit(10.0**DIGITS)


def attach(hits: DataFrame, table: DataFrame, on: str, queries: DataFrame, k: int) -> DataFrame:
    """Hits with the columns of ``table``, which holds each document once.

    There are at most k hits per query. Within ``MAX_SENT_HITS`` rows they go to the tasks of the table, whose texts
    then need no shuffle; more hits are joined by shuffle.
    """
    few = queries.limit(MAX_SENT_HITS // k + 1).count() * k <= MAX_SENT_HITS
    return table.join(F.broadcast(hits) if few else hits, on)


def block_best(scores: np.ndarray, keys: np.ndarray, k: int):
    """(row, column) of the k best rows per column of a block of rounded scores: score descending, key ascending.

    Score and key order are packed into one whole number per cell, so any number of equal scores - a block full of
    copies - costs no more than distinct ones.
    """
    n = len(scores)
    if n <= k:
        row, column = np.indices(scores.shape)
        return row.ravel(), column.ravel()
    place = np.empty(n, np.int64)
    place[np.argsort(keys, kind="stable")] = np.arange(n)
    largest = float(np.abs(scores).max(initial=0.0)) * 10**DIGITS * n
    if not largest < 2**62:  # too large to pack: one sort per column by score, then key
        top = np.stack([np.lexsort((place, -column))[:k] for column in scores.T], axis=1)
        return top.ravel(), np.tile(np.arange(scores.shape[1]), k)
    packed = np.rint(scores * 10**DIGITS).astype(np.int64) * n + (n - 1 - place)[:, None]
    top = np.argpartition(packed, n - k, axis=0)[n - k :]
    return top.ravel(), np.tile(np.arange(scores.shape[1]), k)


def k_best(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int):
    """The k best per query: score descending, key ascending."""
    order = np.lexsort((key, -score, query))
    query, score, key = query[order], score[order], key[order]
    at = np.arange(len(query))
    start = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    position = at - np.maximum.accumulate(np.where(start, at, 0))
    keep = position < k
    return query[keep], score[keep], key[keep]


def merge_best(best, query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int):
    if best is not None:
        query, score, key = (np.concatenate(pair) for pair in zip(best, (query, score, key)))
    return k_best(query, score, key, k)


def _limits(best, n_queries: int, k: int) -> np.ndarray:
    """The k-th score of every query, -inf with fewer hits or without a number."""
    low = np.full(n_queries, np.inf)
    if best is None:
        return -low
    np.minimum.at(low, best[0], best[1])
    low[(np.bincount(best[0], minlength=n_queries) < k) | np.isnan(low)] = -np.inf
    return low


def _best_of_tile(best, keys, x, single, length, ids, queries, k: int, exclude_self: bool, floor, plain: bool):
    """``best_products`` for one tile of queries; ``single`` is ``x`` in single precision, ``length`` that of its longest row."""
    asked, extra = queries.astype(np.float32).T.copy() if plain else None, 1 if exclude_self else 0
    # Products in single precision are this far off, at most; rounded scores are half a digit off.
    slack = 2.0**-22 * (x.shape[1] + 4) * length * np.linalg.norm(queries, axis=1) + 10.0**-DIGITS
    low = np.maximum(_limits(best, len(ids), k), floor)
    waiting, held, at = [], 0, 0
    while at < len(x):
        known = plain and np.isfinite(low).all()
        part = slice(at, at + (max(1, BLOCK_CELLS // len(ids)) if known else FIRST_ROWS))
        at = part.stop
        row = None
        if known:
            least = np.nextafter((low - slack).astype(np.float32), np.float32(-np.inf))
            row, column = np.divmod(np.flatnonzero(single[part] @ asked >= least), len(ids))
        if row is not None and len(row) <= 4 * (k + extra) * len(ids):
            score = np.round(np.einsum("ij,ij->i", x[part][row], queries[column]), DIGITS)
        else:  # no limits yet, or so many equal scores that a selection per query is cheaper
            scores = np.round(x[part] @ queries.T, DIGITS)
            row, column = block_best(scores, keys[part], k + extra)
            score = scores[row, column]
        key = keys[part][row]
        keep = ~(score < low[column])
        if exclude_self:
            keep &= ids[column] != key
        waiting.append((column[keep], score[keep], key[keep]))
        held += len(waiting[-1][0])
        if at >= len(x) or held >= k * len(ids) or not known:
            best = merge_best(best, *(np.concatenate(c) for c in zip(*waiting)), k)
            low, waiting, held = np.maximum(_limits(best, len(ids), k), floor), [], 0
    return best


def best_products(best, keys: np.ndarray, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool, floor: np.ndarray | None = None):
    """``best`` (query place, rounded inner product, key; by query) with the rows of ``x`` taken in, k per query.

    Only products that reach a query's k-th score so far, or its ``floor``, are looked at: products in single precision, with
    room for their error, tell which, and these are computed again in double precision.
    """
    if not len(x) or not len(ids):
        return best
    length, longest = (float(np.sqrt((v * v).sum(axis=1).max())) for v in (x, queries))
    plain = length < 1e15 and longest < 1e15  # neither infinite nor missing components
    single = x.astype(np.float32) if plain else None
    floor = np.full(len(ids), -np.inf) if floor is None else floor
    found = []
    for a in range(0, len(ids), TILE_QUERIES):
        tile = slice(a, a + TILE_QUERIES)
        mine = None
        if best is not None:
            p, q = np.searchsorted(best[0], [a, a + TILE_QUERIES])
            mine = (best[0][p:q] - a, best[1][p:q], best[2][p:q])
        mine = _best_of_tile(mine, keys, x, single, length, ids[tile], queries[tile], k, exclude_self, floor[tile], plain)
        found.append((mine[0] + a, mine[1], mine[2]))
    return tuple(np.concatenate(c) for c in zip(*found))
