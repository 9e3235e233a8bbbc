import random

import pytest

from tests import oracle
from tests.llm.test_ngram_join import shingles
from ticketloom.llm import decontamination
from ticketloom.llm.queries import SQL, op4_decontamination


def brute(docs, items):
    out = []
    for i in {i for i, _ in docs if i is not None}:
        have = frozenset().union(*[shingles(t) for d, t in docs if d == i])
        for k in {k for k, _ in items if k is not None}:
            want = frozenset().union(*[shingles(t) for d, t in items if d == k])
            if want and 100 * len(have & want) >= 75 * len(want):
                out.append((i, k, len(want), len(have & want), len(have & want) / len(want)))
    return sorted(out)


def answer(spark, documents, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contained_items(documents(docs, extra=True), "doc_id", "text", benchmark, "item_id", "text")
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_against_all_pairs(spark, documents, monkeypatch, sent):
    monkeypatch.setattr(decontamination, "MOST_SENT", sent)
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([2, 5, 6, 20, 40, 90])))) for k in range(25)]
    docs = []
    for i in range(80):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 3, 50, 400, 3_000]))]
        for _ in range(rng.choice([0, 1, 2])):
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                part[rng.randrange(len(part))] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((i, " ".join(words).upper() if i % 3 else " ".join(words)))
    assert answer(spark, documents, docs, items) == brute(docs, items)


def test_odd_rows(spark, documents):
    items = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None), (3, ""), (4, "two words"), (None, "a b c d e"), (5, "a b c d e f g h")]
    docs = [
        (1, "x " * 50_000 + "a b c d e f g h" + " y" * 50_000), (2, None), (3, ""), (4, "TWO  words"), (5, "more than two words here"),
        (None, "a b c d e f g h"), (6, "a b c d e f"), (6, "d e f g h"), (7, "a b c d e f g"), (8, "a b c d e f g h"), (8, "a b c d e f g h"),
    ]
    assert answer(spark, documents, docs, items) == brute(docs, items)


def test_empty_tables(spark, documents):
    assert answer(spark, documents, [], [(1, "a b c d e")]) == []
    assert answer(spark, documents, [(1, "a b c d e")], []) == []


def test_no_python_in_the_plan(spark, folder):
    plan = op4_decontamination(spark, folder)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_query_and_sql(spark, folder):
    assert oracle.difference(op4_decontamination(spark, folder), oracle.connect(folder), SQL["op4_decontamination"]) is None


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op3_ngram_join"])
def test_other_sql(spark, folder, name):
    from ticketloom.llm.queries import QUERIES

    assert oracle.difference(QUERIES[name](spark, folder), oracle.connect(folder), SQL[name]) is None
