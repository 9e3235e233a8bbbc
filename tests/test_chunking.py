from hypothesis import given, settings
from hypothesis import strategies as st

from ticketloom.operators.chunking import chunk_spans, chunk_table

SIZE, OVERLAP = 40, 10


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.booleans())
def test_spans_cover_text_and_terminate(text, tail):
    spans = list(chunk_spans(text, SIZE, OVERLAP, tail))
    covered = set()
    for start, end in spans:
        assert 0 <= start < end <= len(text) and end - start <= SIZE
        assert text[start:end].strip()
        covered.update(range(start, end))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_blank_text_has_no_chunk():
    assert list(chunk_spans(" " * 5000, 4096, 1024)) == []
    assert list(chunk_spans("", 4096, 1024)) == []


def test_trailing_blanks_terminate():
    assert list(chunk_spans("a" * 5000 + " " * 5000, 4096, 1024))[0] == (0, 4096)


def test_redundant_tail_only_in_compat():
    assert list(chunk_spans("x" * 2000, 4096, 1024)) == [(0, 2000)]
    assert list(chunk_spans("x" * 2000, 4096, 1024, True)) == [(0, 2000), (976, 2000)]
    assert list(chunk_spans("x" * 1000, 4096, 1024, True)) == [(0, 1000)]


def test_cut_after_sentence():
    text = "x" * 3500 + ". " + "y" * 2000
    assert list(chunk_spans(text, 4096, 1024))[0] == (0, 3501)


def test_table(spark):
    df = spark.createDataFrame([("a", "x" * 9000), ("b", None), ("c", "  ")], "id string, text string")
    rows = chunk_table(df, "id", "text").orderBy("chunk_index").collect()
    assert [(r.id, r.chunk_index, r.start_char, r.end_char) for r in rows] == [
        ("a", 0, 0, 4096), ("a", 1, 3072, 7168), ("a", 2, 6144, 9000),
    ]
    assert rows[0].token_count == 1024
