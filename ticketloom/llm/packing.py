"""Online packing of token sequences by the sum of squares.

Documents come in the order of the scan. All windows of one fill level are counted together in a level array; a piece of n
ids goes to the level h, or opens a window, where the sum of the squared counts of partly filled windows becomes smallest.
A document longer than a window first fills whole windows. When a task ends, or holds too many open windows, it empties
the least filled windows into the fullest ones, cutting pieces where they do not fit, so at most one window stays open; its
ids are dealt to windows of lengths that are powers of two, which need no padding.

Every task packs its own split in one pass over the texts: nothing is shuffled, and a task that runs again gives the same
windows, because the split is read in the same order.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.memory import tidy
from ticketloom.llm.token_files import _WordCache, read_definition

CAPACITY = 2048
#: Windows that a task holds open; their ids take at most 32 MB.
MOST_OPEN = 4096
#: Characters whose distinct words are encoded together, and ids given back at a time.
CHARS_PER_ROUND = 8_000_000
IDS_PER_BATCH = 1_000_000
#: Sequence numbers: the task's number above these bits, the window's number in the task below.
_WINDOW_BITS = 36


class Packer:
    """Open windows of one task. A piece is (document, start, ids); a window is a list of pieces."""

    def __init__(self, capacity: int = CAPACITY, most_open: int = MOST_OPEN):
        self.capacity, self.most_open = capacity, most_open
        self._empty()

    def _empty(self) -> None:
        self.counts = np.zeros(self.capacity + 1, dtype=np.int64)
        self.levels: list[list] = [[] for _ in range(self.capacity)]
        self.open = 0

    def level_for(self, n: int) -> int:
        """The level of the window that takes ``n`` ids, 0 for a new window; of equal choices the fullest."""
        before, after = self.counts[: self.capacity - n + 1], self.counts[n:]
        change = 2 * (after - before) + 2
        change[0] -= 1  # no window leaves a level
        change[-1] -= 1  # a full window enters none
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return self.capacity - n - int(change[::-1].argmin())

    def add(self, document, ids: np.ndarray):
        """The windows that this document's ids fill."""
        start, whole = 0, len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            yield [(document, start, ids[start : start + self.capacity])]
        if whole == len(ids):
            return
        window = self._put((document, whole, ids[whole:]))
        if window:
            yield window
        if self.open > self.most_open:
            yield from self._close(keep_last=True)

    def _put(self, *pieces):
        """Adds the pieces to one window; that window if it is full now."""
        n = sum(len(ids) for _, _, ids in pieces)
        level = self.level_for(n)
        window = self.levels[level].pop() if level else []
        window.extend(pieces)
        self.counts[level] -= level > 0
        self.open -= level > 0
        if level + n == self.capacity:
            return window
        self.levels[level + n].append(window)
        self.counts[level + n] += 1
        self.open += 1

    def _close(self, keep_last: bool):
        """Full windows from all open ones; the one that is left over stays open or is dealt to powers of two."""
        left = deque(window for level in reversed(self.levels) for window in level)
        self._empty()
        while left:
            window = left.popleft()
            room = self.capacity - sum(len(ids) for _, _, ids in window)
            while room and left:
                document, start, ids = left[-1].pop()
                if len(ids) > room:
                    left[-1].append((document, start + room, ids[room:]))
                elif not left[-1]:
                    left.pop()
                window.append((document, start, ids[:room]))
                room -= len(window[-1][2])
            if not room:
                yield window
            elif keep_last:
                self._put(*window)
            else:
                yield from _powers(window)

    def finish(self):
        """The windows of all ids that are left."""
        yield from self._close(keep_last=False)


def _powers(window: list):
    """The pieces dealt to windows whose lengths are falling powers of two."""
    pieces = deque(window)
    left = sum(len(ids) for _, _, ids in window)
    while left:
        room = size = 1 << left.bit_length() - 1
        part = []
        while room:
            document, start, ids = pieces.popleft()
            if len(ids) > room:
                pieces.appendleft((document, start + room, ids[room:]))
            part.append((document, start, ids[:room]))
            room -= len(part[-1][2])
        yield part
        left -= size


RESULT = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def pack(
    df: DataFrame, key: str, text: str, tokenizer_json: str, end_id: int = 1, capacity: int = CAPACITY,
    most_open: int = MOST_OPEN,
) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset) per piece of a document.

    A document's ids are those of its whole text by the definition in the file ``tokenizer_json``, strings of special
    tokens being ordinary text, and ``end_id``. ``start`` counts its ids before the piece, ``offset`` those of other
    pieces before it in the sequence, without gaps; ``ids`` are little-endian unsigned 32-bit integers. A sequence holds
    ``capacity`` ids, or a power of two below that at the end of a task. A NULL or empty text is only the end id. Rows
    with equal keys or equal texts are packed each; NULL keys are kept. Sequence numbers are unique but leave gaps between
    tasks. An empty table gives no rows. Other columns are not read; a key named like a result is an error.
    """
    if key in RESULT:
        raise ValueError(f"the key column has the name of a result: {key}")
    if capacity < 1 or most_open < 1:
        raise ValueError("a window holds one id at least, and one window is open at least")
    sent = df.sparkSession.sparkContext.broadcast(read_definition(tokenizer_json))
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")))

    def run(batches):
        cache, packer = _WordCache(sent.value), Packer(capacity, most_open)
        sequence = TaskContext.get().partitionId() << _WINDOW_BITS
        rows, held, key_type = [], 0, None

        def out():
            columns = list(zip(*rows))
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [key, *RESULT])

        def windows():
            for keys, texts in _rounds(batches):
                nonlocal key_type
                key_type = keys.type
                for one, ids in zip(keys.to_pylist(), cache.encode(texts, end_id)):
                    yield from packer.add((one, len(ids)), ids)
            yield from packer.finish()

        for window in windows():
            offset = 0
            for (one, total), start, ids in window:
                rows.append((one, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
                offset += len(ids)
            sequence += 1
            held += offset
            if held >= IDS_PER_BATCH:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    schema = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.mapInArrow(tidy(run), schema)


def _rounds(batches):
    """(keys, texts) of about CHARS_PER_ROUND characters each."""
    keys, texts, chars = [], [], 0
    for batch in batches:
        first = 0
        for i, value in enumerate(batch.column(1)):
            texts.append(value.as_py())
            chars += len(texts[-1])
            if chars >= CHARS_PER_ROUND:
                yield pa.concat_arrays([*keys, batch.column(0).slice(first, i + 1 - first)]), texts
                keys, texts, chars, first = [], [], 0, i + 1
        if first < batch.num_rows:
            keys.append(batch.column(0).slice(first))
    if keys:
        yield pa.concat_arrays(keys), texts
