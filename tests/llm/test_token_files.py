import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ticketloom.llm import simple8b, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=200))
def test_packing_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    words, escapes = simple8b.pack(values)
    assert simple8b.unpack(words, len(values), escapes).tolist() == values.tolist()


def test_packing_is_tight():
    words, escapes = simple8b.pack(np.zeros(6_000, dtype=np.uint32))
    assert len(words) == 100 and not len(escapes)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_words_encode_like_texts(texts):
    cache = token_files._WordCache(open(PATH, encoding="utf-8").read())
    assert [x.tolist() for x in cache.encode(texts, 1)] == [ids_of(t) for t in texts]


@pytest.fixture()
def path(shared_folder):
    return f"{shared_folder}/tokens-{uuid.uuid4().hex}"


def test_files_round_trip(spark, documents, path):
    rows = [
        (9, "One fish, two fish."), (3, None), (5, ""), (5, "again"), (5, "again"), (-2, "Übergröße ΑΣ … <|endoftext|>"),
        (1, "many words " * 30_000), (None, "no key"),
    ]
    token_files.write_token_files(documents(rows, extra=True), "doc_id", "text", PATH, path, ids_per_block=50, parts=3)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert len(got) == len(rows)
    keys = [r["doc_id"] for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    want = sorted((repr(i), ids_of(t)) for i, t in rows)
    assert sorted((repr(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]


def test_query(spark, folder):
    from ticketloom.llm.queries import op5_token_files

    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    at, want = 0, []
    for r in rows:
        ids = np.array(ids_of(r["text"]), dtype="<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op5_token_files(spark, folder).collect())) == want


def test_empty_table(spark, documents, path):
    token_files.write_token_files(documents([]), "doc_id", "text", PATH, path, parts=2)
    assert token_files.read_token_files(spark, path).collect() == []


def test_other_definitions_are_refused(tmp_path):
    with pytest.raises(ValueError):
        token_files.read_definition(public_tokenizers.path("byte_bpe_50k.json"))
    text = open(PATH, encoding="utf-8").read()
    assert token_files.read_definition(PATH) == text
    other = tmp_path / "other.json"
    other.write_text(text.replace('"Lowercase"', '"NFD"'), encoding="utf-8")
    with pytest.raises(ValueError):
        token_files.read_definition(str(other))
