import random
import re

import pytest

from ticketloom.llm import ngram_join
from ticketloom.llm.ngram_join import similar_groups
from ticketloom.llm.queries import op3_ngram_join

CAPITALS = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(CAPITALS))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Rows with one key are one node; links come from any of its texts."""
    sets = [(i, shingles(t)) for i, t in rows]
    reach = {i: i for i, _ in sets if i is not None}

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    inverted = {}
    for n, (i, s) in enumerate(sets):
        for g in s:
            inverted.setdefault(g, []).append(n)
    pairs = {(a, b) for group in inverted.values() for a in group for b in group if a < b}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
            i, j = root(i), root(j)
            reach[max(i, j)] = min(i, j)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


def answer(documents, rows, **k):
    return sorted(map(tuple, similar_groups(documents(rows, **k), "doc_id", "text").collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
    return words


def corpus(rng):
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for family in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            words = edited(rng, base, rng.choice([0, 0, 1, 2, 5]))
            if rng.random() < 0.3:
                at = rng.randrange(len(words) + 1)
                words[at:at] = passage
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(documents, seed):
    rows = corpus(random.Random(seed))
    assert answer(documents, rows) == brute(rows)


@pytest.mark.parametrize("chunk", [4, 1_000])
def test_tiles_decide_what_pivots_leave(documents, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 2)
    monkeypatch.setattr(ngram_join.tiles, "ROWS_PER_CHUNK", chunk)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3])))) for i in range(60)]
    # A chain in which only neighbours are similar.
    chain = [f"c{i}" for i in range(400)]
    rows += [(100 + k, " ".join(chain[k * 12 : k * 12 + 150])) for k in range(20)]
    rows += [(200 + k, " ".join([*base[:60], *[f"v{k}_{i}" for i in range(30)]])) for k in range(15)]
    assert answer(documents, rows) == brute(rows)


@pytest.mark.parametrize("most", [2, 12])
def test_groups_beyond_a_task(documents, monkeypatch, most):
    """Members of large groups stay where they are; links and components are the same."""
    monkeypatch.setattr(ngram_join, "MOST_POSTINGS", most)
    rows = corpus(random.Random(3))
    assert answer(documents, rows) == brute(rows)


def test_odd_rows(documents):
    rows = [
        (9, "one two three"), (4, "ONE two\tthree"), (3, "one two three four five six seven"), (2, None), (1, ""), (5, " \n "),
        (7, "x " * 60_000), (8, "x " * 50_000), (None, "one two three"), (6, "é é é é é É"), (10, "é é é é é é"),
        (11, "same words here for all of us"), (11, "same words here for all of us"), (12, "same words here for all of us"),
    ]
    assert answer(documents, rows, extra=True) == brute(rows)


def test_exact_threshold(documents):
    a = [f"a{i}" for i in range(11)]  # 7 shingles
    b = [*a, "b"]  # 8 shingles, 7 shared: 0.875
    c = [f"c{i}" for i in range(10)]  # 6 shingles
    d = [*c, "d", "e"]  # 8 shingles, 6 shared: exactly 0.75
    e = [f"e{i}" for i in range(9)]  # 5 shingles
    f = [*e, "f", "g"]  # 7 shingles, 5 shared: 0.714
    rows = list(enumerate(map(" ".join, [a, b, c, d, e, f])))
    assert [r[2] for r in answer(documents, rows)] == [0, 0, 2, 2, 4, 5]


def test_empty_table(documents):
    assert answer(documents, []) == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op3_ngram_join(spark, folder).collect()), key=repr) == brute(rows)
