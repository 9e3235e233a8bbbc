"""Bounded samples of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.sources.sinks import stored

_STEPS = 1 << 30
#: Rows of a class that are expected at least, if it has as many: no row weighs more than such a part of the limit.
LEAST_ROWS = 20


def per_class(rows: DataFrame, label: str, key: str, limit: int, weight: Column | None = None) -> DataFrame:
    """About ``limit`` rows of each class, the same ones on every run; with a ``weight``, rows of ``limit`` total weight,
    where no row counts for more than ``limit / LEAST_ROWS``.

    A row is taken when the hash of its key falls below its class's share, so nothing is sorted and no class passes through
    one task. A class of up to LEAST_ROWS rows is taken whole, however heavy they are; of a larger one LEAST_ROWS rows are
    expected at least, so no class is lost. Classes come back with ``class_rows``, their number of rows in all. The table of
    shares has a row per class and is written, so that Spark sends it to all tasks as long as it is small.
    """
    size = F.sum(F.least(weight, F.lit(limit / LEAST_ROWS))) if weight is not None else F.count(F.lit(1))
    shares = rows.groupBy(label).agg(size.cast("double").alias("_size"), F.count(F.lit(1)).alias("class_rows"))
    marked = rows.join(stored(shares, "class-shares"), label)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(_STEPS)) / F.lit(float(_STEPS))
    return marked.where(draw < F.lit(float(limit)) / F.greatest(F.col("_size"), F.lit(1.0))).drop("_size")
