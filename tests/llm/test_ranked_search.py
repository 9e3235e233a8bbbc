import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests import oracle
from ticketloom.llm import ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(ranked_search.TERM, (text or "").translate(LOWER))


def brute(docs, items, k):
    """(item, rank, key, score) over every document."""
    found = [(key, Counter(terms_of(text))) for key, text in docs]
    found = [(key, c, c.total()) for key, c in found if c]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    holders = Counter(t for _, c, _ in found for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for key, c, n in found:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms
                if c[t]
            )
            if score > 0:
                scored.append((-score, key is None, key))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r + 1, key, -s) for r, (s, _, key) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def run(docs, items, **options):
    return sorted(map(tuple, ranked_search.ranked(docs, "doc_id", "text", items, "item_id", "text", **options).collect()), key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(ranked_search, "DOCS_PER_BLOCK", 7)
    monkeypatch.setattr(ranked_search, "FIRST_DEPTH", 1)


def corpus(n=240):
    rng = np.random.default_rng(3)
    odds = 1 / np.arange(1, 41)
    docs = [(i * 3, " ".join(rng.choice(WORDS, rng.integers(1, 30), p=odds / odds.sum()))) for i in range(n)]
    docs += [(9_000 + i, docs[5][1]) for i in range(40)]  # equal scores
    docs += [(50, None), (51, ""), (52, " .,;! \t"), (53, "Straße STRASSE ÄÖ äö 日本語\U0001f600"), (54, "w1"), (54, "w1")]
    docs += [(None, "w3 w39"), (None, "w3 w39"), (55, "w2 " * 400_000 + "longest"), (56, "W7 W7 w7")]
    items = [(i, " ".join(rng.choice(WORDS, 6))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "straße ÄÖ 日本語\U0001f600"), (104, "longest"), (105, docs[5][1])]
    items += [(106, "w1 w2"), (106, "w3"), (None, "w4"), (107, "w39 w3 w39"), (108, "w0"), (108, "w0")]
    return docs, items


def test_matches_brute_force(spark, documents, small_blocks):
    docs, items = corpus()
    df = documents(docs, extra=True).repartition(3)
    assert run(df, benchmark(spark, items), k=10) == brute(docs, items, 10)


def test_several_passes(spark, documents, small_blocks):
    docs, items = corpus(60)
    assert run(documents(docs), benchmark(spark, items), k=3, most_sent=30) == brute(docs, items, 3)


def test_empty_tables(spark, documents):
    docs, items = corpus(10)
    assert run(documents([]), benchmark(spark, items)) == []
    assert run(documents(docs), benchmark(spark, [])) == []
    assert run(documents([(1, None), (2, "")]), benchmark(spark, items)) == []


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_terms(text):
    n, counts = ranked_search._term_counts(text.encode("utf-8", "replace"))
    want = terms_of(text.encode("utf-8", "replace").decode())
    assert n == len(want) and {t.decode(): c for t, c in counts.items()} == Counter(want)


def test_terms_across_pieces(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 5)
    n, counts = ranked_search._term_counts(b"a longword, b;" * 50 + b"c" * 30)
    assert n == 151 and counts == {b"a": 50, b"longword": 50, b"b": 50, b"c" * 30: 1}


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6), st.integers(0, 60), st.integers(1, 5))
def test_reading_stops_only_when_all_is_certain(seed, n_lists, least, k):
    rng, n_docs = np.random.default_rng(seed), 30
    lists, total = [], np.zeros(n_docs, dtype=np.int64)
    for _ in range(n_lists):
        rows = rng.permutation(n_docs)[: rng.integers(1, n_docs + 1)]
        gains = np.sort(rng.integers(0, 12, len(rows)))[::-1].astype(np.int64)
        lists.append((rows, gains))
        total[rows] += gains
    depth, ranked_search.FIRST_DEPTH = ranked_search.FIRST_DEPTH, 1
    try:
        rows, scores = ranked_search.resolve(lists, n_docs, k, least)
    finally:
        ranked_search.FIRST_DEPTH = depth
    assert scores.tolist() == total[rows].tolist()
    bar = max(np.sort(total)[-k], least, 1)
    assert set(np.flatnonzero(total >= bar)) <= set(rows.tolist())


def test_reading_stops_early():
    class Watched(np.ndarray):
        deepest = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Watched.deepest = max(Watched.deepest, at.stop or 0)
            return super().__getitem__(at)

    n = 100_000
    rows = np.arange(n).view(Watched)
    gains = (1_000 * np.arange(n, 0, -1)).astype(np.int64)
    ranked_search.resolve([(rows, gains)], n, 10, 0)
    assert Watched.deepest <= 2 * ranked_search.FIRST_DEPTH


def test_equal_scores_take_the_smallest_keys():
    best = ranked_search._Best(3)
    best.offer(pa.array([9, None, 4]), np.array([0, 1, 2]), np.array([5, 5, 5]))
    best.offer(pa.array([7, 1]), np.array([0, 1]), np.array([5, 6]))
    assert [(one, -s) for s, _, one in best.rows] == [(1, 6), (4, 5), (7, 5)] and best.least == 5


def test_query(spark, folder):
    from ticketloom.llm.queries import OP13_SQL, op13_ranked_search

    assert oracle.difference(op13_ranked_search(spark, folder), oracle.connect(folder), OP13_SQL) is None
