import zlib

import pytest

from ticketloom.llm import toxicity
from ticketloom.llm.queries import op10_toxicity


@pytest.mark.parametrize("raw, folded", [
    ("You 1D10T!", " you idiot "), ("іdіоt", " idiot "), ("ｉｄｉｏｔ", " idiot "), ("f00l$ 2024", " fools 2024 "), ("", "  "),
    ("a@b $5", " aab 5 "), ("Été", " été "),
])
def test_fold(raw, folded):
    assert toxicity.fold(raw) == folded


def naive(folded, terms, exceptions):
    out = []
    for start in range(len(folded)):
        found = [(w, start + len(t)) for t, w in terms.items() if folded.startswith(t, start)]
        if found:
            weight = max(w for w, _ in found)
            end = next(e for w, e in found if w == weight)
            shield = any(s <= start and s + len(x) >= end - 1 for x in exceptions for s in range(len(folded)) if folded.startswith(x, s))
            if not shield:
                out.append((start, end, weight))
    return out


@pytest.mark.parametrize("text", ["you idiot and idiotic fool", "village idiot idiot", "fool fool foolproof", "", "nothing here"])
def test_matcher(text):
    terms = {" idiot ": 3.0, " idio": 1.0, " fool": 2.0}
    exceptions = (" village idiot ", " foolproof ")
    folded = toxicity.fold(text)
    assert toxicity.Matcher(terms, exceptions).hits(folded) == naive(folded, terms, exceptions)


def test_learned_lexicon_and_exceptions(spark, documents):
    rows = [(i, f"plain text number {i} with a village idiot in it") for i in range(60)]
    rows += [(100 + i, f"you are an 1diot and a blockhead {i}") for i in range(40)] + [(200 + i, f"some words {i}") for i in range(100)]
    labels = [(i, int(100 <= i < 140)) for i, _ in rows] + [(1, None), (None, 1), (5_000, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(documents(rows, extra=True), labels, exceptions=("Blockhead Stadium",))
    assert " blockhead " in model.terms and " blockhead stadium " in model.exceptions
    asked = [(1, "What a BL0CKHEAD, you are an idiot"), (2, "the village idiot"), (3, None), (4, ""), (None, "a blockhead"), (5, "fine " * 50_000),
             (6, "blockhead stadium is open today"), (6, "blockhead stadium is open today")]
    got = toxicity.score(documents(asked, extra=True), "doc_id", "text", model).collect()
    assert len(got) == len(asked) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    flags = {r["doc_id"]: r["predicted"] for r in got}
    assert flags == {1: 1, 2: 0, 3: 0, 4: 0, None: flags[None], 5: 0, 6: 0}


def test_nothing_to_learn(spark, documents):
    for labels in ([], [(1, 0)]):
        model = toxicity.learn(documents([(1, "text")]), spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.score(documents([(1, "text")]), "doc_id", "text", model).first()["predicted"] == 0
    assert toxicity.score(documents([]), "doc_id", "text", model).collect() == []


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in op10_toxicity(spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"] and r["toxic"] is not None]
    flagged = [r["toxic"] for r in labels if rows[r["doc_id"]]["predicted"]]
    toxic = [rows[r["doc_id"]]["predicted"] for r in labels if r["toxic"]]
    assert sum(flagged) >= 0.97 * len(flagged) and sum(toxic) >= 0.9 * len(toxic)


def test_no_term_is_dropped(spark):
    """Thousands of strong terms: all are learned."""
    words = [f"vile{a}{b}{c}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopq"]
    rows = [(i, " ".join(words[i % 68 :: 68])) for i in range(68 * 6)] + [(10_000 + i, "good plain words here") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 10_000)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    covered = toxicity.Matcher(model.terms)
    assert len(words) > 5_000 and all(covered.hits(f" {w} ") for w in words)


def test_shadowed_beginnings_go():
    found = {" ab": (5, 0, 1.0), " abc": (5, 0, 2.0), " abd": (3, 0, 1.5), " b ": (2, 1, 1.0), " abc ": (4, 0, 2.5)}
    assert toxicity._without_shadowed(found) == {" abc": 2.0, " abc ": 2.5, " abd": 1.5, " b ": 1.0}
