"""Edit distance between whole texts, bit-parallel over code points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def distance(a: str, b: str) -> int:
    """The least number of inserted, dropped and replaced characters that turns ``a`` into ``b``.

    A column of the distance table is held as two whole numbers, one bit per character of the shorter text: where the
    distance grows by one from a row to the next, and where it falls. Each character of the longer text takes a few
    operations on them, so 64 cells cost about one. Equal ends are cut off first.
    """
    if a == b:
        return 0
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, character in enumerate(a):
        places[character] = places.get(character, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    grows, falls, score = every, 0, len(a)
    for character in b:
        equal = places.get(character, 0)
        steady = equal | falls
        carried = (((equal & grows) + grows) ^ grows) | equal
        up = falls | (every & ~(carried | grows))
        down = grows & carried
        score += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        grows = (down | every & ~(steady | up)) & every
        falls = up & steady & every
    return score


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int64")


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts of any script; NULL when one is NULL. Rows travel in Arrow batches."""
    return F.pandas_udf(_distances, LongType())(a, b)
