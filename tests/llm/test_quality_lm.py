import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from ticketloom.llm import quality_lm
from ticketloom.llm.queries import op6_quality_lm


def brute_model(texts):
    """log p of a byte after the five before it, by the textbook recursion over dictionaries."""
    counts = {quality_lm.ORDER: Counter()}
    for text in texts:
        s = quality_lm.START + text.encode()
        counts[quality_lm.ORDER].update(s[i : i + quality_lm.ORDER] for i in range(len(s) - quality_lm.ORDER + 1))
    for order in range(quality_lm.ORDER - 1, 0, -1):
        counts[order] = Counter(run[1:] for run in counts[order + 1])
    discounts, totals = {}, {}
    for order, table in counts.items():
        n = [max(1, sum(c == k for c in table.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        found = 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]
        discounts[order] = [0, *(min(max(d, 0.05), top) for d, top in zip(found, (0.95, 1.9, 2.85)))]
        totals[order] = defaultdict(lambda: [0, 0.0])
        for run, c in table.items():
            totals[order][run[:-1]][0] += c
            totals[order][run[:-1]][1] += discounts[order][min(c, 3)]

    def p(run):
        if not run:
            return 1 / quality_lm.SYMBOLS
        order, below = len(run), p(run[1:])
        total, held = totals[order].get(run[:-1], (0, 0))
        if not total:
            return below
        c = counts[order].get(run, 0)
        return (c - discounts[order][min(c, 3)] if c else 0) / total + held / total * below

    def perplexity(text):
        s = quality_lm.START + text.encode()
        logs = [math.log(p(s[i : i + quality_lm.ORDER])) for i in range(len(s) - quality_lm.ORDER + 1)]
        return math.exp(-sum(logs) / len(logs))

    return perplexity


TEXTS = ["the cat sat on the mat. the dog sat too", "Ça va? The end.", "a a a b", "x", "日本語の本", "the cat sat"]


@pytest.mark.parametrize("common", [0, 3, 60, 10**6])
def test_perplexities_match_the_recursion(documents, monkeypatch, common):
    """Whatever share of the runs is sent, and in chunks of any size; the rest goes through the join."""
    monkeypatch.setattr(quality_lm, "COMMON", common)
    monkeypatch.setattr(quality_lm, "CHUNK", 30)
    monkeypatch.setattr(quality_lm, "HELD_RUNS", 20)
    model, brute = quality_lm.learn(documents(list(enumerate(TEXTS))), "text"), brute_model(TEXTS)
    asked = [*TEXTS, "the dog sat on the cat", "本日", "unseen, all of it", "mat the on sat cat the", "\n\n\n\n\n\n", "z"]
    rows = [(i, t) for i, t in enumerate(asked)] + [(100, None), (101, "")]
    got = {r["doc_id"]: r for r in quality_lm.perplexities(documents(rows), "text", model, "doc_id").collect()}
    assert len(got) == len(rows) and got[100]["perplexity"] is got[101]["perplexity"] is None
    for i, text in enumerate(asked):
        assert got[i]["n_symbols"] == len(text.encode())
        assert math.isclose(got[i]["perplexity"], brute(text), rel_tol=1e-5), text


def test_runs_of_texts():
    texts = [b"ab", b"", b"c", "é".encode(), b""]
    doc, code = quality_lm.runs_of(texts)
    want = [(i, (quality_lm.START + t)[k : k + quality_lm.ORDER]) for i, t in enumerate(texts) for k in range(len(t))]
    assert doc.tolist() == [i for i, _ in want] and code.tolist() == [int.from_bytes(w, "big") for _, w in want]
    assert len(quality_lm.runs_of([b""])[1]) == 0


def test_lookup():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3_000):
        codes = np.unique(rng.integers(0, 1 << 51, n))
        known = quality_lm._Lookup(codes)
        asked = np.concatenate([codes, rng.integers(0, 1 << 51, 500)])
        place = {int(c): i for i, c in enumerate(codes)}
        assert known.find(asked).tolist() == [place.get(int(c), -1) for c in asked]


def test_hashes_are_those_of_spark(spark):
    codes = np.array([-7, 12345678901, 0, 3], dtype=np.int64)
    row = spark.sql("SELECT " + ", ".join(f"xxhash64({c}L)" for c in codes)).first()
    assert quality_lm._spark_hash(codes).view(np.int64).tolist() == list(row)


def test_what_is_gathered_grows(spark, documents):
    """Ten times the text gives more runs, not only higher counts."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(4_000)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(600)]
    few, many = (quality_lm.learn(documents(list(enumerate(t))), "text").values.count() for t in (texts[:60], texts))
    assert many > 4 * few


def test_odd_rows(spark, documents):
    rows = [(i, f"a sound sentence of plain words, number {i}.", "en") for i in range(50)]
    rows += [(90, None, "en"), (91, "", "en"), (92, "#$%|" * 20, "en"), (93, "a sound sentence of plain words, number 7.", "xx"),
             (94, "a sound sentence of plain words, number 8.", None), (95, "plain words " * 20_000, "en"), (None, "plain words", "en")]
    trusted = spark.createDataFrame([(i,) for i in range(50)] + [(3,), (None,), (700,)], "doc_id long")
    got = {r["doc_id"]: r for r in quality_lm.classify(documents(rows, extra=True), "doc_id", "text", "lang", trusted).collect()}
    assert len(got) == len(rows)
    assert not got[90]["keep"] and not got[91]["keep"] and got[90]["perplexity"] is None and not got[92]["keep"]
    assert got[93]["keep"] and got[94]["keep"] and got[94]["lang"] is None
    assert got[93]["highest"] == got[94]["highest"] and sum(got[i]["keep"] for i in range(50)) >= 49


def test_without_trusted_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long")
    got = quality_lm.classify(documents([(1, "text", "en")]), "doc_id", "text", "lang", none).collect()
    assert [(r["keep"], round(r["perplexity"])) for r in got] == [(False, 256)]
    assert quality_lm.classify(documents([]), "doc_id", "text", "lang", none).collect() == []


def test_separates_labels(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["keep"] for r in op6_quality_lm(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good, poor = ([kept[r["doc_id"]] for r in labels if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.4 * len(poor)


def test_scripts_and_word_order_count(spark, documents):
    # Other characters of one script, and the same words in another order.
    seen = [chr(0x4E00 + i) for i in range(16)]
    text = "".join(seen)
    other = "".join(chr(ord(c) + 16) for c in seen)
    plain = "the old keeper of the house went down to the river and sat by the water until the evening came"
    shuffled = " ".join(sorted(plain.split(), key=lambda w: w[::-1]))
    rows = [(i, t, "x") for i, t in enumerate([text * 3, text, plain, plain + " again"])] + [(10, other, "x"), (11, shuffled, "x")]
    trusted = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    got = {r["doc_id"]: r["perplexity"] for r in quality_lm.classify(documents(rows), "doc_id", "text", "lang", trusted).collect()}
    assert got[10] > 2 * got[1] and got[11] > 1.5 * got[2]
