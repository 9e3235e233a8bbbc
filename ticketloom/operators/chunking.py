"""Overlapping text chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


#: Fixed value: a chunk may end after the first character of one of these.
_BOUNDARY = re.compile(r"\. |\n")


def _stop_finder(text: str, size: int) -> Callable[[int], int]:
    """begin -> end of the chunk that begins there. The boundaries are listed once; each end is one binary search."""
    spans = [m.span() for m in _BOUNDARY.finditer(text)]
    closed = [after for _, after in spans]

    def stop(begin: int) -> int:
        limit = begin + size
        if limit >= len(text):
            return len(text)
        nearest = bisect_right(closed, limit) - 1
        earliest = max(begin + 1, int(limit - size * 0.2))
        if nearest >= 0 and spans[nearest][0] >= earliest:
            return spans[nearest][0] + 1
        return limit

    return stop


def chunk_spans(text: str, size: int, overlap: int, keep_tail: bool = False) -> Iterator[tuple[int, int]]:
    """(start, end) of each non-blank chunk of at most ``size`` characters.

    A chunk that does not reach the end of the text ends after the last boundary in its last fifth. The next one begins
    ``overlap`` characters before that, or at it where this would not move on. The last chunk ends with the text;
    ``keep_tail`` adds the extra chunk holding only the final ``overlap`` characters that the original rule produces.
    """
    stop, begin, shown = _stop_finder(text, size), 0, None
    reached = 0
    while reached < len(text):
        reached = stop(begin)
        if text[begin:reached].strip():
            shown = begin
            yield begin, reached
        begin = reached - overlap if reached - overlap > begin else reached
    tail = len(text) - overlap
    if keep_tail and shown is not None and tail > shown and text[tail:].strip():
        yield tail, len(text)


def _chunk_batches(batches, size, overlap, keep_tail, flush=2000):
    names = ["key", "chunk_index", "content", "token_count", "start_char", "end_char"]
    rows: list[tuple] = []

    def table():
        columns = list(zip(*rows))
        arrays = [
            pa.array(columns[0]),
            pa.array(columns[1], pa.int32()),
            pa.array(columns[2], pa.string()),
            pa.array(columns[3], pa.int32()),
            pa.array(columns[4], pa.int32()),
            pa.array(columns[5], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            for index, (start, end) in enumerate(chunk_spans(text, size, overlap, keep_tail)):
                piece = text[start:end].strip()
                rows.append((key, index, piece, len(piece) // CHARS_PER_TOKEN, start, end))
                if len(rows) >= flush:
                    yield table()
                    rows.clear()
    if rows:
        yield table()


def chunk_table(
    df: DataFrame, key: str, text: str, size_tokens: int = 1024, overlap_tokens: int = 256, compat: bool = False
) -> DataFrame:
    """(key, chunk_index, content, token_count, start_char, end_char) for every document.

    Runs where the documents lie; the chunks stream out in small Arrow batches, without a shuffle.
    """
    size, overlap = size_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, chunk_index int, content string, token_count int, start_char int, end_char int"

    def run(batches):
        for out in _chunk_batches(batches, size, overlap, compat):
            yield out.rename_columns([key, *out.schema.names[1:]])

    return df.select(key, text).mapInArrow(run, schema)


def register_chunk_function(spark: SparkSession, name: str = "chunk_text") -> None:
    """Makes the chunker callable from SQL: ``FROM articles, LATERAL chunk_text(content, 1024, 256)``."""

    @F.udtf(returnType="chunk_index int, content string, token_count int, start_char int, end_char int")
    class ChunkText:
        def eval(self, text: str, size_tokens: int, overlap_tokens: int):
            spans = chunk_spans(text or "", size_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN)
            for index, (start, end) in enumerate(spans):
                piece = text[start:end].strip()
                yield index, piece, len(piece) // CHARS_PER_TOKEN, start, end

    spark.udtf.register(name, ChunkText)
