import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketloom.llm import byte_bpe
from ticketloom.llm.queries import bpe_digests, byte_ranks

RANKS = byte_ranks()
MERGES = byte_bpe.merges_of(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = [
    (1, "The cat sat on the mat, didn't it?\n\n  Yes 123!"), (2, ""), (3, None), (4, "a" * 30_000), (5, "ab" * 9_000),
    (5, "ab" * 9_000), (None, "été 😀 \x1c\x85 naïve"), (7, "<|endoftext|> plain"), (8, "x y z " * 40_000),
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aabé \n'1s", max_size=60), max_size=20))
def test_replay_is_the_librarys_encoding(pieces):
    texts = [p.encode() for p in pieces]
    ids, starts = byte_bpe.replay(texts, MERGES)
    for piece, a, b in zip(texts, starts, starts[1:]):
        assert ids[a:b].tolist() == (LIBRARY._encode_single_piece(piece) if piece else [])


def expected(text):
    ids = np.array(LIBRARY.encode_ordinary(text or ""), dtype="<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_digests(documents):
    rows = bpe_digests(documents(TEXTS, extra=True)).collect()
    got = sorted(((r[0], *r[1:]) for r in rows), key=repr)
    assert got == sorted(((i, *expected(t)) for i, t in TEXTS), key=repr)


def test_small_replays_change_nothing(documents):
    found = byte_bpe.encode(documents(TEXTS), "doc_id", "text", RANKS, public_tokenizers.PATTERN, chars_per_replay=10)
    whole = byte_bpe.encode(documents(TEXTS), "doc_id", "text", RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_both_ways_of_decoding_agree(documents):
    both = byte_bpe.encode(documents(TEXTS), "doc_id", "text", RANKS, public_tokenizers.PATTERN, decoded=True)
    again = byte_bpe.decode(both, "doc_id", "ids", RANKS).collect()
    assert sorted((repr(r["doc_id"]), r["decoded"]) for r in again) == sorted((repr(r["doc_id"]), r["decoded"]) for r in both.collect())


def test_decode_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, ids binary")
    assert [r["decoded"] for r in byte_bpe.decode(df, "doc_id", "ids", RANKS).orderBy("doc_id").collect()] == [None, b""]


def test_empty_table(documents):
    assert bpe_digests(documents([])).collect() == []
