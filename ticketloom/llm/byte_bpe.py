"""Byte-level BPE by corpus-level merge replay.

Every task gathers the distinct pieces of its texts into one flat array of byte tokens with neighbour links. An inverted
index goes from merge rank to the positions of the pairs that make it; the replay takes the lowest rank that is present,
merges all its positions at once and looks up new ranks only for the neighbours it touched.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import astuple, dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.memory import tidy

NEVER = np.int32(2**31 - 1)
#: Text gathered before a replay, and ids sent back in one Arrow batch.
CHARS_PER_REPLAY = 4_000_000
IDS_PER_BATCH = 500_000


@dataclass(frozen=True)
class Merges:
    """A vocabulary as arrays: pair keys (left id * size + right id, sorted) with the id each pair makes, the id of every
    byte, and which ids may lead to a pair of lower rank than their own."""

    keys: np.ndarray
    made: np.ndarray
    byte_ids: np.ndarray
    steps_back: np.ndarray
    words: list[bytes]

    @property
    def size(self) -> int:
        return len(self.words)


def read_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> Merges:
    """All pairs of tokens whose joined bytes are a token."""
    size = max(ranks.values()) + 1
    words = [b""] * size
    keys, made = [], []
    steps_back = np.zeros(size, dtype=bool)
    for token, rank in ranks.items():
        words[rank] = token
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left * size + right)
                made.append(rank)
                for half, text in ((left, token[:cut]), (right, token[cut:])):
                    if len(text) > 1 and half > rank:
                        steps_back[half] = True
    order = np.argsort(np.array(keys, dtype=np.int64))
    return Merges(
        np.array(keys, dtype=np.int64)[order],
        np.array(made, dtype=np.int32)[order],
        np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32),
        steps_back,
        words,
    )


def _ranks_of(merges: Merges, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    wanted = left.astype(np.int64) * merges.size + right
    at = np.minimum(np.searchsorted(merges.keys, wanted), len(merges.keys) - 1)
    return np.where(merges.keys[at] == wanted, merges.made[at], NEVER)


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, and where each piece starts (one more entry than pieces)."""
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    token = merges.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    n = len(token)
    ends = np.cumsum(lengths)
    if n == 0:
        return token, np.concatenate([[0], ends])
    after = np.arange(1, n + 1, dtype=np.int64)
    before = np.arange(-1, n - 1, dtype=np.int64)
    after[ends[lengths > 0] - 1] = -1
    before[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(n, dtype=bool)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    rank = np.full(n, NEVER, dtype=np.int32)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = _ranks_of(merges, token[inner], token[inner + 1])

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def add(positions: np.ndarray) -> None:
        positions = positions[rank[positions] != NEVER]
        if not len(positions):
            return
        order = positions[np.argsort(rank[positions], kind="stable")]
        values = rank[order]
        starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
        heads = values[starts[:-1]].tolist()
        bounds = starts.tolist()
        for k, made in enumerate(heads):
            if made not in index:
                index[made] = []
                heapq.heappush(queue, made)
            index[made].append(order[bounds[k] : bounds[k + 1]])

    add(inner)
    while queue:
        made = heapq.heappop(queue)
        found = index.pop(made)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        at = at[alive[at] & (rank[at] == made)]
        if not len(at):
            continue
        if len(at) > 1:
            if merges.steps_back[made]:  # a pair of lower rank may follow: one merge per piece at a time
                mine = piece[at]
                first = np.concatenate([[True], mine[1:] != mine[:-1]])
                add(at[~first])
                at = at[first]
            else:
                linked = after[at[:-1]] == at[1:]
                if linked.any():  # of pairs that share a token, every second one from the left
                    place = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(np.concatenate([[True], ~linked]), place, 0))
                    at = at[(place - head) % 2 == 0]
        gone = after[at]
        follower = after[gone]
        token[at] = made
        alive[gone] = False
        rank[gone] = NEVER
        after[at] = follower
        has = follower >= 0
        before[follower[has]] = at[has]
        rank[at] = NEVER
        left = before[at]
        pairs = np.concatenate([at[has], left[left >= 0]])
        rank[pairs] = _ranks_of(merges, token[pairs], token[after[pairs]])
        add(np.unique(pairs))
    kept = np.concatenate([[0], np.cumsum(alive)])
    return token[alive], kept[np.concatenate([[0], ends])]


def _gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``values`` one after the other."""
    sizes = starts[which + 1] - starts[which]
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts[which] - (ends - sizes), sizes)]


def _encoded(keys: list, documents: list[np.ndarray], numbers: dict[str, int], merges: Merges):
    ids, starts = replay([p.encode("utf-8") for p in numbers], merges)
    at = 0
    while at < len(keys):
        end, size, rows = at, 0, []
        while end < len(keys) and size < IDS_PER_BATCH:
            row = _gather(ids, starts, documents[end]).astype("<u4")
            rows.append(row)
            size += len(row)
            end += 1
        yield keys[at:end], rows
        at = end


def encode(
    df: DataFrame, key: str, text: str, ranks: dict[bytes, int], pattern: str,
    chars_per_replay: int = CHARS_PER_REPLAY, decoded: bool = False,
) -> DataFrame:
    """(key, ids, n_tokens): the ids of every whole text as little-endian unsigned 32-bit integers in one binary value;
    with ``decoded`` also the bytes that the ids stand for, as ``decode`` gives them, in the same pass.

    Each match of ``pattern`` is encoded separately by the ranks, without special tokens. A NULL or empty text has no
    ids; a NULL key is kept; repeated rows are encoded each; other columns of ``df`` are not read. Texts are never cut:
    a text longer than ``chars_per_replay`` is one replay of its own. Nothing is shuffled.
    """
    key_type = df.schema[key].dataType
    sent = df.sparkSession.sparkContext.broadcast(astuple(merges_of(ranks)))

    def run(batches):
        find, merges = regex.compile(pattern).findall, Merges(*sent.value)
        keys, documents, numbers, chars = [], [], {}, 0
        fresh = count()

        def flush():
            for some, rows in _encoded(keys, documents, numbers, merges):
                columns = {
                    "key": pa.array(some, type=kind),
                    "ids": pa.array([r.tobytes() for r in rows], type=pa.binary()),
                    "n_tokens": pa.array([len(r) for r in rows], type=pa.int64()),
                }
                if decoded:
                    columns["decoded"] = pa.array([_bytes_of(merges.words, r) for r in rows], type=pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            values = batch.column(1)
            for i, one in enumerate(batch.column(0).to_pylist()):
                value = values[i].as_py() or ""
                found = find(value)
                for piece in found:
                    if piece not in numbers:
                        numbers[piece] = next(fresh)
                keys.append(one)
                documents.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
                chars += len(value)
                if chars >= chars_per_replay:
                    yield from flush()
                    keys, documents, numbers, chars, fresh = [], [], {}, 0, count()
        if keys:
            yield from flush()

    schema = f"`{key}` {key_type.simpleString()}, ids binary, n_tokens long" + ", decoded binary" * decoded
    return df.select(key, text).mapInArrow(tidy(_named(run, key)), schema)


def _bytes_of(words: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(words.__getitem__, ids.tolist()))


def decode(df: DataFrame, key: str, ids: str, ranks: dict[bytes, int], *keep: str) -> DataFrame:
    """(key, ``keep`` columns, decoded): the bytes the ids stand for. NULL ids give NULL; no ids give no bytes."""
    kept = df.select(key, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    words = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    sent = df.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        words = sent.value
        for batch in batches:
            source = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                out, size, start = [], 0, at
                while at < batch.num_rows and size < 4 * IDS_PER_BATCH:
                    value = source[at].as_py()
                    out.append(None if value is None else _bytes_of(words, np.frombuffer(value, "<u4")))
                    size += len(value or b"")
                    at += 1
                kept = [c.slice(start, at - start) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(out, type=pa.binary())], [*batch.schema.names[:-1], "decoded"]
                )

    return df.select(key, *keep, F.col(ids).alias("_decode")).mapInArrow(tidy(run), f"{schema}, decoded binary")


def _named(run, key: str):
    def named(batches):
        for out in run(batches):
            yield out.rename_columns([key, *out.schema.names[1:]])

    return named
