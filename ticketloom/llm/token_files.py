"""Token ids in Simple-8b files, in ascending key order.

A file is a Parquet container of blocks. A block holds whole documents: the packed words, the places of their escapes, the
count of ids, the keys, and per document the offset of its first id inside the block, so a block is decoded by itself and
all its words of one selector at once. Spark's writer commits the files, so a task that runs twice leaves one copy.
"""

from __future__ import annotations

import json
import os
import sys
import types
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.llm import simple8b
from ticketloom.llm.memory import tidy
from ticketloom.llm.shingles import WordHasher

IDS_PER_BLOCK = 1 << 16
#: Fixed value: how a definition must cut words.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Text whose distinct words are encoded together, and words sent to the tokenizer at a time.
CHARS_PER_ROUND = 24_000_000
WORDS_PER_CALL = 20_000
#: Words whose ids a Python worker keeps between tasks; about 40 bytes each.
MOST_WORDS = 1_000_000


def read_definition(path: str) -> str:
    """The definition in a file of the tokenizers library. Its words must be such that a text's ids are those of its words in
    turn: lower case, white space dropped, and runs of letters, digits or signs by themselves; others are an error."""
    with open(path, encoding="utf-8") as source:
        text = source.read()
    parts = json.loads(text)
    kinds = [n.get("type") for n in (parts.get("normalizer") or {}).get("normalizers", [])]
    split = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    rule = split.get("pattern", {}).get("Regex"), split.get("behavior"), split.get("invert")
    if kinds != ["NFC", "Replace", "Lowercase"] or rule != (WORD_RULE, "Removed", True) or parts["model"].get("end_of_word_suffix") != "</w>":
        raise ValueError(f"{path} does not define a vocabulary of lower-case words with ends")
    return text


class _WordCache:
    """Ids of texts, each distinct word encoded once.

    Texts are cut at spaces and line feeds, and a sign is cut off a word that ends with an ASCII letter before it. The
    vocabulary drops white space and never joins characters across it or across the end of a run of letters, so the ids of
    a text are those of its pieces in turn. Words are known by a 64-bit hash; those of earlier tasks stay in the Python
    worker, up to MOST_WORDS.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.memory = sys.modules.setdefault("_token_words", types.ModuleType("_token_words")).__dict__
        if self.memory.get("definition") != definition:
            tokenizer = Tokenizer.from_str(definition)
            tokenizer.encode_special_tokens = True
            tokenizer.no_truncation()
            tokenizer.no_padding()
            vocabulary = tokenizer.get_vocab()
            last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            self.memory.update(definition=definition, tokenizer=tokenizer, last=last)
            self._forget()
        self.tokenizer, self.last, self.hasher = self.memory["tokenizer"], self.memory["last"], WordHasher()

    def _forget(self) -> None:
        """``known``: sorted hashes; ``start`` and ``size``: where the ids of each are in ``ids``."""
        none = np.zeros(0, dtype=np.int64)
        self.memory.update(known=none.astype(np.uint64), start=none, size=none, ids=none.astype(np.uint32))

    def encode(self, texts: list[str], end_id: int):
        """The ids of each text, the end id last."""
        parts = []
        for text in texts:
            one = text.encode("utf-8", "surrogatepass")
            # Before a combining mark, a small letter may compose where the capital does not.
            parts.append(one if b"\xcc" in one or b"\xcd" in one else one.translate(_LOWER))
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        whole = b"\n".join([*parts, b""])
        raw = np.frombuffer(whole, dtype=np.uint8)
        hashes, starts, ends = self.hasher.words(raw, (raw == 32) | (raw == 10), _without_sign)
        signed = (raw[ends] != 32) & (raw[ends] != 10)
        tails, sign_starts, sign_ends = self._signs()
        place = np.arange(len(hashes)) + np.cumsum(signed) - signed
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        words = [(distinct, first, whole, starts, ends)]
        if signed.any():
            used = np.unique(raw[ends[signed]])
            words.append((tails[used], used, bytes(range(256)), sign_starts, sign_ends))
        self._learn(words)
        known, start, size, ids = (self.memory[k] for k in ("known", "start", "size", "ids"))
        at = np.empty(len(hashes) + int(signed.sum()), dtype=np.int64)
        at[place] = np.searchsorted(known, distinct)[which]
        at[place[signed] + 1] = np.searchsorted(known, tails)[raw[ends[signed]]]
        heads = np.append(place, len(at))[np.searchsorted(starts, bounds)]
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
            mine = at[a:b]
            run = size[mine]
            stop = np.cumsum(run)
            n = int(stop[-1]) if b > a else 0
            out = np.empty(n + 1, dtype=np.uint32)
            out[:n] = ids[np.arange(n) + np.repeat(start[mine] - (stop - run), run)]
            out[n] = end_id
            yield out

    def _signs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of every byte as a word of its own."""
        spread = np.full(512, 32, dtype=np.uint8)
        spread[::2] = np.arange(256)
        one = np.zeros(512, dtype=bool)
        one[1::2] = True
        return self.hasher.words(spread, one)[0], np.arange(256), np.arange(1, 257)

    def _learn(self, words: list[tuple]) -> None:
        """Encodes the words whose hashes are not known yet."""
        if len(self.memory["known"]) > MOST_WORDS:
            self._forget()
        for hashes, which, source, starts, ends in words:
            known = self.memory["known"]
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            fresh = known[at] != hashes if len(known) else np.ones(len(hashes), dtype=bool)
            if not fresh.any():
                continue
            places = zip(starts[which[fresh]].tolist(), ends[which[fresh]].tolist())
            ids, size = self._ids([source[a:b].decode("utf-8", "surrogatepass") for a, b in places])
            start = len(self.memory["ids"]) + np.cumsum(size) - size
            joined = np.concatenate([known, hashes[fresh]])
            order = np.argsort(joined, kind="stable")
            self.memory["known"] = joined[order]
            self.memory["start"] = np.concatenate([self.memory["start"], start])[order]
            self.memory["size"] = np.concatenate([self.memory["size"], size])[order]
            self.memory["ids"] = np.concatenate([self.memory["ids"], ids])

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each has."""
        size = np.zeros(len(words), dtype=np.int64)
        simple = np.fromiter((w.islower() and _only_letters(w) for w in words), dtype=bool, count=len(words))
        found: list[np.ndarray] = [None] * 2
        for turn, (which, joined) in enumerate([(np.flatnonzero(simple), True), (np.flatnonzero(~simple), False)]):
            parts = [np.zeros(0, dtype=np.uint32)]
            for at in range(0, len(which), WORDS_PER_CALL):
                some = which[at : at + WORDS_PER_CALL]
                ids, ends = self._call([words[i] for i in some], joined)
                size[some] = np.diff(ends, prepend=0)
                parts.append(ids)
            found[turn] = np.concatenate(parts)
        out = np.empty(int(size.sum()), dtype=np.uint32)
        mine = np.repeat(simple, size)
        out[mine], out[~mine] = found
        return out, size

    def _call(self, words: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn and where each ends."""
        if joined:  # a word of letters ends with its only end token
            lines = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)]
            encoded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words):
                return ids, ends
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), dtype=np.uint32), np.cumsum([len(i) for i in lists])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SIGN, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SIGN[list(b".,!?;:")] = True
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True


def _without_sign(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the words without a last sign that follows a small ASCII letter."""
    last, before = raw[ends - 1], raw[np.maximum(ends - 2, 0)]
    return ends - ((ends - starts > 1) & _SIGN[last] & _LETTER[before])


def _only_letters(word: str) -> bool:
    """Letters whose composed and lower-case forms are letters too."""
    return word.isalpha() and (word.isascii() or (unicodedata.is_normalized("NFC", word) and word.lower().isalpha()))


BLOCK = "part int, start_in_part long, n_ids long, words binary, escapes array<int>, offsets array<int>"


def _block(part: int, begun: int, keys: list, rows: list[np.ndarray], key_type: pa.DataType) -> pa.RecordBatch:
    values = np.concatenate(rows)
    words, escapes = simple8b.pack(values)
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    offsets = (np.cumsum(sizes) - sizes).astype(np.int32)
    columns = {
        "part": pa.array([part], pa.int32()),
        "start_in_part": pa.array([begun], pa.int64()),
        "n_ids": pa.array([len(values)], pa.int64()),
        "words": pa.array([words.tobytes()], pa.binary()),
        "escapes": pa.array([escapes.tolist()], pa.list_(pa.int32())),
        "offsets": pa.array([offsets.tolist()], pa.list_(pa.int32())),
        "keys": pa.array([keys], pa.list_(key_type)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def write_token_files(
    df: DataFrame, key: str, text: str, tokenizer_json: str, path: str, end_id: int = 1,
    ids_per_block: int = IDS_PER_BLOCK, parts: int | None = None,
) -> None:
    """Encodes every whole text and writes the ids in ascending order of ``key`` to ``path``.

    ``tokenizer_json`` is the path of a definition for the tokenizers library, read and checked on the driver. Strings of special
    tokens inside a text are ordinary text. A NULL text counts as empty: only the end id. Rows with equal keys are
    written each, ordered by the hash of their text; a NULL key comes first. Other columns are not read; an empty table
    writes no block. ``parts`` is the number of range partitions, from the session unless given.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(read_definition(tokenizer_json))
    key_type = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def run(batches):
        cache, part, begun = _WordCache(sent.value), TaskContext.get().partitionId(), 0
        keys, rows, size, kind = [], [], 0, None
        for kind, some, texts in _rounds(batches):
            for one, ids in zip(some, cache.encode(texts, end_id)):
                keys.append(one)
                rows.append(ids)
                size += len(ids)
                if size >= ids_per_block:
                    yield _block(part, begun, keys, rows, kind)
                    begun, size, keys, rows = begun + size, 0, [], []
        if keys:
            yield _block(part, begun, keys, rows, kind)

    blocks = ordered.mapInArrow(tidy(run), f"{BLOCK}, keys array<{key_type}>")
    blocks.write.option("compression", "none").parquet(path)


def _rounds(batches):
    """(key type, keys, texts) of about CHARS_PER_ROUND characters each."""
    keys, texts, chars, kind = [], [], 0, None
    for batch in batches:
        kind = batch.column(0).type
        for one, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys.append(one)
            texts.append(value.as_py())
            chars += len(texts[-1])
            if chars >= CHARS_PER_ROUND:
                yield kind, keys, texts
                keys, texts, chars = [], [], 0
    if keys:
        yield kind, keys, texts


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) per document: ``start`` counts the ids of all documents before it, ``ids`` are
    little-endian unsigned 32-bit integers."""
    blocks = spark.read.parquet(path)
    key_type = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                words = np.frombuffer(row["words"].as_py(), dtype="<u8")
                n = row["n_ids"].as_py()
                ids = simple8b.unpack(words, n, np.array(row["escapes"].as_py(), dtype=np.int64)).astype("<u4")
                offsets = [*row["offsets"].as_py(), n]
                base, keys = row["start_in_part"].as_py(), row["keys"].values
                bounds = list(zip(offsets, offsets[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array([row["part"].as_py()] * len(bounds), pa.int32()),
                        pa.array([base + a for a, _ in bounds], pa.int64()),
                        pa.array([b - a for a, b in bounds], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in bounds], pa.binary()),
                    ],
                    [key, "part", "start", "n_tokens", "ids"],
                )

    docs = blocks.mapInArrow(
        tidy(run), f"`{key}` {key_type}, part int, start long, n_tokens long, ids binary"
    )
    return _with_part_starts(blocks, docs, key)


def _with_part_starts(blocks: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """One row per part is summed up, far fewer than documents, so the running total over parts is one small window."""
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    joined = docs.join(F.broadcast(starts), "part")
    return joined.select(key, (F.col("part_start") + F.col("start")).alias("start"), "n_tokens", "ids")
