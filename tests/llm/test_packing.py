import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ticketloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def power_of_two(n):
    return n & (n - 1) == 0


def check_sequences(pieces, capacity):
    """Offsets without gaps, no sequence beyond the capacity, others full or a power of two long."""
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and power_of_two(at)


def check_documents(pieces, want):
    """Every id of every document in exactly one piece; ``want`` has the ids of each row."""
    found = {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        found.setdefault(p["doc_id"], []).append((p["start"], ids, p["doc_tokens"]))
    for key, rows in want.items():
        # Rows with one key cannot be told apart, so starts and ids are compared as they lie.
        left = sorted(found.pop(key))
        assert sum(len(ids) for _, ids, _ in left) == sum(map(len, rows))
        if len(rows) == 1:
            assert sum((ids for _, ids, _ in left), []) == rows[0]
            assert [s for s, _, _ in left] == np.cumsum([0, *(len(i) for _, i, _ in left[:-1])]).tolist()
            assert {n for _, _, n in left} == {len(rows[0])}
    assert not found


def brute_level(counts, capacity, n):
    """The level with the least sum of squares afterwards, the fullest of equal ones."""
    best = None
    for level in range(capacity - n + 1):
        if level and not counts[level]:
            continue
        after = list(counts)
        if level:
            after[level] -= 1
        if level + n < capacity:
            after[level + n] += 1
        cost = sum(c * c for c in after[1:capacity])
        if best is None or cost <= best[0]:
            best = cost, level
    return best[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=80))
def test_level_minimises_the_sum_of_squares(sizes):
    packer = packing.Packer(16, 1_000)
    for n in sizes:
        assert packer.level_for(n) == brute_level(packer.counts.tolist(), 16, n)
        list(packer.add("d", np.zeros(n, dtype=np.uint32)))
        assert packer.open == packer.counts.sum() == sum(map(len, packer.levels))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 33), st.integers(1, 6))
def test_windows_hold_every_id_once(sizes, capacity, most_open):
    packer, windows, at, docs = packing.Packer(capacity, most_open), [], 0, []
    for i, n in enumerate(sizes):
        docs.append(np.arange(at, at + n))
        at += n
        windows.extend(packer.add(i, docs[-1]))
        assert packer.open <= most_open
    windows.extend(packer.finish())
    short = [n for n in (sum(len(x) for _, _, x in w) for w in windows) if n != capacity]
    assert all(power_of_two(n) for n in short) and len(short) == len(set(short))
    for i, start, ids in (p for w in windows for p in w):
        assert ids.tolist() == docs[i][start : start + len(ids)].tolist()
    assert sorted(x for w in windows for _, _, ids in w for x in ids.tolist()) == list(range(at))


def test_pieces(spark, documents):
    rows = [
        (9, "One fish, two fish."), (3, None), (4, ""), (5, "again"), (5, "again"), (-2, "Übergröße ΑΣ … <|endoftext|>"),
        (1, "many words " * 30_000), (None, "no key"), (6, "two " * 15), (7, "two " * 15),
    ]
    pieces = packing.pack(documents(rows, extra=True).coalesce(1), "doc_id", "text", PATH, capacity=16).collect()
    check_sequences(pieces, 16)
    want = {}
    for key, text in rows:
        want.setdefault(key, []).append(ids_of(text))
    check_documents(pieces, want)
    assert any(p["length"] == 16 and p["doc_id"] == 6 for p in pieces)  # a document of exactly one window stays whole


def test_clashing_key_and_sizes(spark, documents):
    docs = documents([(1, "x")]).withColumnRenamed("doc_id", "start")
    with pytest.raises(ValueError):
        packing.pack(docs, "start", "text", PATH)
    with pytest.raises(ValueError):
        packing.pack(docs, "text", "text", PATH, capacity=0)


def test_empty_table(spark, documents):
    assert packing.pack(documents([]), "doc_id", "text", PATH).collect() == []


def test_query(spark, folder):
    from ticketloom.llm.queries import op11_packing

    docs = {r["doc_id"]: ids_of(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pieces = op11_packing(spark, folder).collect()
    check_sequences(pieces, packing.CAPACITY)
    covered = {}
    for p in pieces:
        ids = docs[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == p["ids_crc32"]
        assert p["doc_tokens"] == len(docs[p["doc_id"]])
        covered.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for key, parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(docs[key])
    assert covered.keys() == docs.keys()
    whole = sum(len(parts) == 1 for parts in covered.values())
    assert whole > 0.8 * sum(len(ids) <= packing.CAPACITY for ids in docs.values())
