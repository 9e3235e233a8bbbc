"""Ranked search against brute force, on both ways of joining the query side."""

import math
import re
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import containment, dense, fusion, lexical, posting_index, quantized

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "hot"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 30)) + ["hot"] * (i % 3))) for i in range(120)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # a group of copies: ties go to the smaller id
    queries = [(i, " ".join(rng.choices(WORDS, k=3))) for i in range(12)] + [(99, "!!!"), (98, "unknown words")]
    return (
        docs,
        queries,
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(queries, "query_id long, query_text string"),
    )


def ranked(scores, k):
    return sorted(((q, d, s) for (q, d), s in scores.items() if s > 0), key=lambda x: (x[0], -x[2], x[1])), k


def brute_bm25(docs, queries, k):
    tf = {d: Counter(t.split()) for d, t in docs}
    n, mean = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    out = []
    for q, text in queries:
        hits = []
        for d, counts in tf.items():
            s, length = 0.0, sum(counts.values())
            for term in set(text.split()):
                if counts[term]:
                    df = sum(1 for c in tf.values() if c[term])
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    s += idf * counts[term] * 2.2 / (counts[term] + 1.2 * (0.25 + 0.75 * length / mean))
            if s > 0:
                hits.append((round(s, 6), d))
        hits.sort(key=lambda h: (-h[0], h[1]))
        out += [(q, d, s, r) for r, (s, d) in enumerate(hits[:k], 1)]
    return out


def rows(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("max_sent", [lexical.MAX_SENT_TERMS, 0])
def test_bm25(corpus, max_sent):
    docs, queries, docs_df, queries_df = corpus
    got = lexical.bm25_search(docs_df, "doc_id", F.col("text"), queries_df, "query_id", "query_text", 7, stop_words=[], max_sent=max_sent)
    assert rows(got) == sorted(brute_bm25(docs, queries, 7))


@pytest.mark.parametrize("max_sent", [lexical.MAX_SENT_TERMS, 0])
def test_cover_rank(corpus, max_sent):
    docs, queries, docs_df, queries_df = corpus
    expected = []
    for q, text in queries:
        hits = []
        for d, body in docs:
            if d == q:
                continue
            counts = Counter(body.split())
            s = sum((0.4 + (1.0 if i == 0 else 0)) * 0 + 0.4 * counts[t] for i, t in enumerate(sorted(set(text.split()))))
            if s > 0:
                hits.append((round(s / (s + 1), 6), d))
        hits.sort(key=lambda h: (-h[0], h[1]))
        expected += [(q, d, s, r) for r, (s, d) in enumerate(hits[:4], 1)]
    got = lexical.cover_rank_search(
        docs_df, "doc_id", {"B": F.col("text")}, queries_df, "query_id", "query_text", 4, exclude_self=True, stop_words=[], max_sent=max_sent
    )
    assert rows(got) == sorted(expected)


def test_small_blocks_give_the_same(corpus, monkeypatch):
    _, _, docs_df, queries_df = corpus
    search = lambda: rows(lexical.bm25_search(docs_df, "doc_id", F.col("text"), queries_df, "query_id", "query_text", 5))
    whole = search()
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 100)
    assert search() == whole
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 20)  # below terms x queries: pairs are spelled out
    assert search() == whole


def test_block_best_with_copies():
    from ticketloom.operators.topk import block_best

    scores = np.zeros((50, 2))
    scores[:, 0] = 0.5
    scores[7, 1] = 0.25
    keys = np.arange(50)[::-1].copy()
    row, column = block_best(scores, keys, 3)
    got = {c: sorted(keys[row[column == c]]) for c in (0, 1)}
    assert got == {0: [0, 1, 2], 1: [0, 1, 42]}


def test_term_counts(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["c"])], "id int, tokens array<string>")
    got = lexical.term_counts(df, ["id"], "tokens").collect()
    assert sorted((r.id, r.term, r.tf) for r in got) == [(1, "a", 1), (1, "b", 2), (3, "c", 1)]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 16))
    vectors[200:] = vectors[0]  # a third of all rows are copies
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows_ = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return vectors, spark.createDataFrame(rows_, "id long, v array<double>").repartition(4)


def brute_dense(vectors, k, exclude):
    scores = np.round(vectors @ vectors.T, 6)
    out = []
    for q in range(len(vectors)):
        order = sorted((-scores[q, d], d) for d in range(len(vectors)) if not (exclude and d == q))
        out += [(q, d, r) for r, (_, d) in enumerate(order[:k], 1)]
    return out


@pytest.mark.parametrize("max_sent,grid", [(dense.MAX_SENT_COMPONENTS, 1000), (0, 1000), (0, 37)])
@pytest.mark.parametrize("exclude", [False, True])
def test_dense_exact(points, max_sent, grid, exclude):
    vectors, df = points
    got = dense.dense_topk(df, "id", "v", df, "id", "v", 5, exclude_self=exclude, max_sent=max_sent, grid_rows=grid)
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got.collect()) == sorted(brute_dense(vectors, 5, exclude))


def test_dense_k_larger_than_corpus(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert dense.dense_topk(df, "id", "v", df, "id", "v", 9).count() == 4


def test_approximate_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    args = (df, "vec_id", "embedding", df, "vec_id", "embedding", 5)
    exact = dense.dense_topk(*args, exclude_self=True).select("query_id", "doc_id")
    close = dense.approximate_topk(*args, cells=16, probes=6, exclude_self=True, grid_rows=100).select("query_id", "doc_id")
    assert exact.intersect(close).count() / exact.count() > 0.7
    every = dense.approximate_topk(*args, cells=4, probes=4, exclude_self=True).select("query_id", "doc_id")
    assert exact.exceptAll(every).count() == 0


def test_encoder_is_unit_length(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "id long, tokens array<string>")
    got = {r.id: r.embedding for r in dense.encode_table(df, "id", F.col("tokens")).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1.0, abs=1e-6) and not any(got[2])


def test_fusion_ties_keep_dense_order(spark):
    make = lambda pairs: spark.createDataFrame([(1, d, r) for d, r in pairs], "query_id int, doc_id long, rank int")
    fused = fusion.fuse_ranks(make([(10, 1), (11, 2)]), make([(11, 1), (12, 2)]), 3)
    got = [(r.doc_id, r.dense_rank, r.sparse_rank) for r in fused.orderBy("rank").collect()]
    assert got == [(11, 2, 1), (10, 1, None), (12, None, 2)]


@pytest.mark.parametrize("most_sent", [10_000, 0])
def test_containment(spark, most_sent):
    texts = ["xx abc yy", "abcabc", "none", None, "", "one two three four five six", "zero one  two three", "wo three four fiv"]
    parts = ["abc", "bca", "xx abc yy", "zzz", "abc", "", None, "ne two three four fi", "one two three four five six", " ", "wo three four f", "e  t"]
    parts += [" two three four five ", "two\nthree", "three four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    passages = spark.createDataFrame(list(enumerate(parts)), "query_id long, query_text string")
    got = containment.contained_passages(docs, "doc_id", "text", passages, most_sent)
    want = sorted((i, j) for i, p in enumerate(parts) for j, t in enumerate(texts) if p and t and p in t)
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == want


def test_containment_without_passages(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    passages = spark.createDataFrame([], "query_id long, query_text string")
    assert containment.contained_passages(docs, "doc_id", "text", passages).collect() == []


@pytest.fixture(scope="module")
def index_folder(spark):
    import uuid

    from ticketloom.session import shared_folder

    return lambda: f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def small_segments(corpus, index_folder):
    """The corpus in many segments, with a payload."""
    docs = corpus[2].withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "even").when(F.col("doc_id") % 3 == 0, "third"))
    return posting_index.write_postings(
        docs, F.col("doc_id"), {"B": F.col("text")}, index_folder(), ("kind",), stop_words=[], docs_per_segment=4
    )


def index_rows(index, queries_df, **options):
    return rows(posting_index.search(index, queries_df, "query_id", "query_text", stop_words=[], **options))


WAYS = [{"one_phase": 10**6}, {"one_phase": 0}, {"max_sent": 0}]


@pytest.mark.parametrize("way", WAYS)
def test_index_okapi(corpus, small_segments, way):
    docs, queries, _, queries_df = corpus
    assert index_rows(small_segments, queries_df, k=7, score="okapi", **way) == sorted(brute_bm25(docs, queries, 7))


@pytest.mark.parametrize("way", WAYS)
def test_index_cover_with_payload_and_self(corpus, small_segments, way):
    docs, queries, _, queries_df = corpus
    expected = []
    for q, text in queries:
        hits = []
        for d, body in docs:
            counts = Counter(body.split())
            s = 0.4 * sum(counts[t] for t in set(text.split()))
            if s / (s + 1) > 0.5 and d != q and d % 2 and d % 3 == 0:
                hits.append((round(s / (s + 1), 6), d))
        hits.sort(key=lambda h: (-h[0], h[1]))
        expected += [(q, d, s, r) for r, (s, d) in enumerate(hits[:4], 1)]
    got = index_rows(small_segments, queries_df, k=4, min_score=0.5, exclude_self=True, where={"kind": ["third"]}, **way)
    assert got == sorted(expected)
    with pytest.raises(ValueError):
        index_rows(small_segments, queries_df, where={"colour": ["red"]})


def test_index_of_several_fields_and_struct_keys(spark, corpus, index_folder):
    docs, queries, _, queries_df = corpus
    rows_ = [(d, d % 3, f"hot {t[:9]}", t) for d, t in docs] + [(5_000, 0, None, None)]
    df = spark.createDataFrame(rows_, "a long, b int, title string, body string")
    fields = {"A": F.col("title"), "B": F.col("body")}
    index = posting_index.write_postings(df, F.struct("b", "a"), fields, index_folder(), stop_words=[], docs_per_segment=8)
    for score in ("cover", "okapi"):
        lengths = [len((a or "").split()) + len((b or "").split()) for _, _, a, b in rows_]
        mean, expected = sum(lengths) / len(lengths), []
        for q, text in queries:
            hits = []
            for (a, b, title, body), length in zip(rows_, lengths):
                ta, tb = Counter((title or "").split()), Counter((body or "").split())
                s = 0.0
                for t in set(text.split()):
                    if score == "cover":
                        s += ta[t] + 0.4 * tb[t]
                    elif ta[t] + tb[t]:
                        df_ = sum(t in f"{x} {y}".split() for _, _, x, y in rows_)
                        tf = ta[t] + tb[t]
                        s += math.log(1 + (len(rows_) - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
                s = s / (s + 1) if score == "cover" else s
                if s > 0:
                    hits.append((-round(s, 6), (b, a)))
            hits.sort()
            expected += [(q, d, round(-s, 6), r) for r, (s, d) in enumerate(hits[:5], 1)]
        for way in WAYS:
            found = posting_index.search(index, queries_df, "query_id", "query_text", 5, score, stop_words=[], **way).collect()
            assert sorted((r["query_id"], tuple(r["doc_id"]), r["score"], r["rank"]) for r in found) == sorted(expected)
    with pytest.raises(ValueError):
        posting_index.search(index, queries_df, "query_id", "query_text", exclude_self=True)


def test_index_reads_only_what_it_needs(spark, corpus, index_folder):
    """Terms reach the file reader, and segments that cannot hold a hit are left out."""
    texts = [(i, " ".join(f"t{i % 50}x{j}" for j in range(5)) + " common" + (" rare" * (i % 40) if i % 7 == 0 else "")) for i in range(800)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    index = posting_index.write_postings(df, F.col("doc_id"), {"C": F.col("text")}, index_folder(), docs_per_segment=10)
    again = posting_index.open_postings(spark, index.path)
    assert again == index and index.segments == 80
    plan = index.blocks_of(["rare", "common"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [common,rare])]" in plan
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, query_text string")
    terms = lexical.query_terms(asked, "query_id", "query_text").toArrow()
    find = posting_index._Search(index, terms, "okapi", 3, 0.0, False, {})
    cells = find.cells()
    seeds = cells.orderBy(F.desc("bound"), "segment").limit(1)
    rest = posting_index.remaining_cells(cells, seeds, find.scored(seeds), 3, 0.0)
    assert cells.count() == 80 and rest.count() < 60
    whole = index_rows(index, asked, k=3, score="okapi", one_phase=10**6)
    assert index_rows(index, asked, k=3, score="okapi", one_phase=0) == whole and len(whole) == 3


def test_empty_index(spark, corpus, index_folder):
    df = spark.createDataFrame([], "doc_id long, text string")
    index = posting_index.write_postings(df, F.col("doc_id"), {"C": F.col("text")}, index_folder())
    for way in WAYS:
        for score in ("okapi", "cover"):
            assert index_rows(index, corpus[3], score=score, **way) == []
    none = spark.createDataFrame([], "query_id long, query_text string")
    assert index_rows(index, none) == []


def test_rounding_is_one_rule(spark):
    from ticketloom.operators.topk import rounded, rounded_column

    values = [0.0000005, 0.1234565, 2.5000015, 0.1, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(rounded_column(F.col("v"))).collect()] == rounded(np.array(values)).tolist()


def brute_inner(vectors, queries, k, exclude_self=False):
    out = []
    for q, v in queries:
        scored = sorted((-round(float(np.dot(v, x)), 6), d) for d, x in vectors if not (exclude_self and d == q))
        out += [(q, d, -s, r) for r, (s, d) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def grouped_points(spark):
    """Vectors around centres, a third of them copies, with some far out, equal, zero and missing."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(12, 16))
    x = middle[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * 0.15
    x[600:] = x[5]
    x[7], x[8] = 0, 40 * x[8]
    points = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return points, spark.createDataFrame([*points, (9_000, None)], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("max_sent", [10**7, 500])
def test_quantized_search_is_exact(spark, grouped_points, index_folder, max_sent):
    points, df = grouped_points
    index = quantized.write_index(df, "vec_id", "embedding", index_folder(), cells=9, sample_rows=300)
    asked = df.where("vec_id % 30 = 0 OR vec_id IN (7, 8, 9000)")
    for own in (False, True):
        got = quantized.search(index, asked, "vec_id", "embedding", df, "vec_id", "embedding", 6, own, max_sent)
        assert rows(got) == brute_inner(points, [p for p in points if p[0] % 30 == 0 or p[0] in (7, 8)], 6, own)


def test_quantized_search_reads_few_vectors(spark, index_folder):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 64))
    x = middle[rng.integers(0, 40, 6_000)] + rng.normal(size=(6_000, 64)) * 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    index = quantized.write_index(df, "vec_id", "embedding", index_folder(), cells=32)
    asked = df.where("vec_id % 500 = 0")
    pairs, _ = quantized.candidates(index, asked, "vec_id", "embedding", 5)
    assert pairs.count() < 0.25 * 12 * 6_000
    got = quantized.search(index, asked, "vec_id", "embedding", df, "vec_id", "embedding", 5)
    points = list(enumerate(x))
    assert rows(got) == brute_inner(points, [p for p in points if p[0] % 500 == 0], 5)


def test_quantized_edges(spark, grouped_points, index_folder):
    points, df = grouped_points
    none = df.where("false")
    empty = quantized.write_index(none, "vec_id", "embedding", index_folder())
    assert quantized.search(empty, df.limit(3), "vec_id", "embedding", none, "vec_id", "embedding").collect() == []
    few = df.where("vec_id < 3")
    index = quantized.write_index(few, "vec_id", "embedding", index_folder())
    assert quantized.search(index, none, "vec_id", "embedding", few, "vec_id", "embedding").collect() == []
    got = quantized.search(index, few, "vec_id", "embedding", few, "vec_id", "embedding", 10)
    assert rows(got) == brute_inner(points[:3], points[:3], 10)
    with pytest.raises(ValueError):
        quantized.fit_quantizer(df, "embedding", cells=0)


def test_tfidf(spark, corpus):
    from ticketloom.functions import text as T

    docs = [*corpus[0], (5_000, None), (5_001, "only rare words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = {d: Counter((t or "").split()) for d, t in docs}
    found = Counter(t for c in counts.values() for t in c)
    total = sum(counts.values(), Counter())
    kept = sorted((t for t, n in found.items() if 2 <= n <= 0.95 * len(docs)), key=lambda t: (-total[t], t))[:5]
    want = {}
    for d, c in counts.items():
        weights = {t: c[t] * (math.log((1 + len(docs)) / (1 + found[t])) + 1) for t in kept if c[t]}
        length = math.sqrt(sum(w * w for w in weights.values()))
        want |= {(d, t): (c[t], found[t], w / length) for t, w in weights.items()}
    got = {(r["doc_id"], r["term"]): r for r in lexical.tfidf(df, "doc_id", T.tokens(F.col("text")), max_features=5).collect()}
    assert set(got) == set(want)
    for key, (tf, n, weight) in want.items():
        assert (got[key]["tf"], got[key]["df"]) == (tf, n) and got[key]["weight"] == pytest.approx(weight)
    assert lexical.tfidf(df.where("false"), "doc_id", T.tokens(F.col("text"))).collect() == []


def test_search_hits_do_not_grow_with_loose_bounds(spark, index_folder):
    """Vectors without groups, of which the bounds leave nearly all: tasks give k hits per query, not the pairs that are left."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    index, asked = quantized.write_index(df, "vec_id", "embedding", index_folder()), df.where("vec_id % 20 = 0")
    points = list(enumerate(x))
    got = quantized.search(index, asked, "vec_id", "embedding", df, "vec_id", "embedding", 5, True)
    assert rows(got) == brute_inner(points, points[::20], 5, True)
    ids, asking = np.arange(0, 2_000, 20), x[::20]
    whole = index.rows().join(df.withColumnRenamed("vec_id", "id"), "id").select("id", "codes", "error", "cell", "embedding").coalesce(2)
    every = np.ones((len(ids), len(index.radius)), dtype=bool)
    limit = np.sort(asking @ x.T, axis=1)[:, -6]
    schema = "query_id long, doc_id long, score double"
    hits = quantized._scored(index, whole, (ids, asking), every, limit, 5, True, schema).count()
    assert quantized.candidates(index, asked, "vec_id", "embedding", 5, True)[0].count() > 50 * hits


@pytest.mark.parametrize("exclude", [False, True])
def test_best_products(monkeypatch, exclude):
    """Batches, tiles of queries, copies and a row too long for single precision, against a sort per query."""
    from ticketloom.operators import topk

    monkeypatch.setattr(topk, "TILE_QUERIES", 7)
    monkeypatch.setattr(topk, "FIRST_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_CELLS", 350)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 8))
    x[300:500] = x[3]
    keys, queries = rng.permutation(900), x[::40]
    for rows_ in (x, np.vstack([x[:-1], np.full(8, 1e20)])):
        best = None
        for at in range(0, 900, 250):
            best = topk.best_products(best, keys[at : at + 250], rows_[at : at + 250], keys[::40], queries, 4, exclude)
        scores = np.round(queries @ rows_.T, 6)
        for q in range(len(queries)):
            want = sorted((-s, d) for s, d in zip(scores[q], keys) if not (exclude and d == keys[::40][q]))[:4]
            assert best[2][best[0] == q].tolist() == [d for _, d in want]
            assert best[1][best[0] == q] == pytest.approx([-s for s, _ in want])


def test_blocks_are_made_by_segment(spark, index_folder):
    """What is sorted and dealt are blocks, not postings; keys that repeat, texts that are missing, two classes."""
    texts = [(i % 40, None if i % 11 == 0 else f"a{i % 5} b b", f"b c{i % 3} a{i % 5} a{i % 5}" if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(texts, "id long, t string, c string")
    index = posting_index.write_postings(df, F.col("id"), {"A": F.col("t"), "B": F.col("c")}, index_folder(), ("id",), [], 16)
    want = Counter()
    for number, (i, *fields) in enumerate(texts):
        for name, text in zip("AB", fields):
            want.update((number, i, name, w) for w in (text or "").split())
    blocks = index.blocks.collect()
    got = [(k, c, b.term, tf) for b in blocks for k, c, tf in zip(b["keys"], b["classes"], b["tfs"])]
    assert sorted(got) == sorted((i, name, w, tf) for (_, i, name, w), tf in want.items())
    assert len({(b.term, b.segment) for b in blocks}) == len(blocks) and index.segments == 4
    for b in blocks:
        rows_ = list(zip(b["keys"], b["classes"], b["tfs"], b["lengths"]))
        assert rows_ == sorted(rows_) and b.n_docs == len(set(b["keys"])) and b.payload_id == [str(k) for k in b["keys"]]
    docs = df.select("id", "t")
    plan = lambda: posting_index.write_postings(docs, F.col("id"), {"A": F.col("t")}, index_folder())
    made, make = [], posting_index.lexical.term_counts
    posting_index.lexical.term_counts = lambda *args: made.append(1) or make(*args)
    try:
        plan()
    finally:
        posting_index.lexical.term_counts = make
    assert not made  # no row per posting


def test_quantized_search_of_ids_that_repeat(spark, index_folder):
    """A hit comes once per pair of rows of either id."""
    rng = np.random.default_rng(9)
    rows_ = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    df = spark.createDataFrame([*rows_, rows_[4], rows_[9]], "vec_id long, embedding array<double>")
    index = quantized.write_index(df, "vec_id", "embedding", index_folder())
    got = quantized.search(index, df.where("vec_id IN (4, 5)"), "vec_id", "embedding", df, "vec_id", "embedding", 400)
    assert Counter((r.query_id, r.doc_id) for r in got.collect()) == {
        (q, d): (4 if q == 4 else 1) * (4 if d in (4, 9) else 1) for q in (4, 5) for d in range(60)
    }


def test_texts_are_read_once_for_an_index(spark, index_folder):
    """Texts are not read for their counts, and blocks lie where they are made; words are those of ``tokens``."""
    from ticketloom import vocab
    from ticketloom.functions import text as T

    odd = ["", " ", None, "the", "The end.", "...lead and trail!", "İstanbul ΟΔΟΣ ΟΔΟΣ. Straße_1 x", "a\tb\nc d éf", "𝒳 tail the​the", "１２ ²x ß"]
    texts = [(i, odd[i % len(odd)], f"w{i % 3} {odd[(i * 7) % len(odd)] or ''}") for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    df = spark.createDataFrame(texts, "id long, t string, c string").repartition(3)
    counted = df.withColumn("c", F.udf(seen, "string")("c"))
    fields = {"A": F.col("t"), "B": F.col("c")}
    index = posting_index.write_postings(counted, F.col("id"), fields, index_folder(), ("t",), docs_per_segment=8)
    assert read.value == 60
    words = df.select("id", T.tokens(F.col("t")).alias("t"), T.tokens(F.col("c")).alias("c")).collect()
    lengths = {r.id: len(r.t) + len(r.c) for r in words}
    want = Counter((r.id, name, w) for r in words for name, line in (("A", r.t), ("B", r.c)) for w in line if w not in vocab.STOP_WORDS)
    assert {(r.key, r.weight_class, r.term): r.tf for r in index.postings().collect()} == want
    assert (index.n_docs, index.n_tokens, index.segments) == (60, sum(lengths.values()), 8)
    assert posting_index.open_postings(spark, index.path) == index
    for b in index.blocks.collect():
        assert b["lengths"] == [lengths[k] for k in b["keys"]] and b.payload_t == [texts[k][1] for k in b["keys"]]
        own = [tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / index.average_length)) for tf, n in zip(b["tfs"], b["lengths"])]
        assert b.most_okapi >= max(own) - 1e-9


def test_postings_hold_numbers_only(spark, index_folder):
    """Classes and payloads are stored as places; values that are missing, repeat or differ between rows of one key."""
    rows_ = [(i % 30, f"w{i % 4} x", f"y w{i % 3}", None if i % 5 == 0 else f"s{i % 3}", "all") for i in range(60)]
    df = spark.createDataFrame(rows_, "id long, t string, c string, status string, kind string")
    fields = {"B": F.col("c"), "A": F.col("t")}
    index = posting_index.write_postings(df, F.col("id"), fields, index_folder(), ("status", "kind"), [], 16)
    stored = spark.read.parquet(f"{index.path}/blocks")
    types = {c: stored.schema[c].dataType.elementType.typeName() for c in ("classes", "payload_status", "payload_kind")}
    assert types == {"classes": "byte", "payload_status": "integer", "payload_kind": "integer"}
    assert all(r.values_kind == ["all"] for r in stored.where("term IS NULL").collect())
    want = Counter()
    for i, t, c, status, kind in rows_:
        for name, text in (("A", t), ("B", c)):
            want.update(((i, name, w, status, kind) for w in text.split()))
    got = Counter()
    for b in index.blocks.collect():
        for k, c, tf, status, kind in zip(b["keys"], b["classes"], b["tfs"], b.payload_status, b.payload_kind):
            got[k, c, b.term, status, kind] += tf
    assert got == want
    for way in WAYS:
        asked = spark.createDataFrame([(1, "w1 w2")], "query_id long, query_text string")
        hits = posting_index.search(
            index, asked, "query_id", "query_text", 99, where={"status": ["s1", "s9"], "kind": ["all"]}, stop_words=[], **way
        )
        found = {k for k, t, c, status, _ in rows_ if status == "s1" and {"w1", "w2"} & set(f"{t} {c}".split())}
        assert {r.doc_id for r in hits.collect()} == found


def test_many_queries_read_an_index_once(spark, index_folder, monkeypatch):
    """A first phase reads a segment per query; where that is most of them, the blocks are read once and hits are the same."""
    texts = [(i, f"common t{i % 7} t{i % 11}") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    index = posting_index.write_postings(df, F.col("doc_id"), {"C": F.col("text")}, index_folder(), docs_per_segment=5)
    asked = spark.createDataFrame([(q, f"common t{q}") for q in range(12)], "query_id long, query_text string")
    phases, cells = [], posting_index._Search.cells
    monkeypatch.setattr(posting_index._Search, "cells", lambda self: phases.append(1) or cells(self))
    one = index_rows(index, asked, k=3)
    assert index.segments == 40 and not phases
    assert index_rows(index, asked, k=3, one_phase=0) == one and phases
    del phases[:]
    assert index_rows(index, asked.where("query_id = 3"), k=3) and phases


def test_runs_of_words_take_no_copy_of_their_text(spark):
    """Every word of a text offers a run; an uncompiled step would copy the whole text for each."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (4, "b c"), (5, "x a b c d y"), (5, "a b c d")], "doc_id long, text string")
    for text, held in (("a b c d e", {1}), ("b c d", {1, 5}), ("x a b", {5}), ("b c", {1, 4, 5}), ("b", {1, 4, 5}), ("e f", {1}), ("", set())):
        passages = spark.createDataFrame([(7, text), (8, None)], "query_id long, query_text string")
        for sent in (100, 0):
            found = containment.contained_passages(docs, "doc_id", "text", passages, sent)
            assert sorted((r.query_id, r.doc_id) for r in found.collect()) == [(7, d) for d in sorted(held)]
            plan = [line for line in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Generate " in line]
            assert (plan or not text) and all(re.search(r"\*\(\d+\) Generate ", line) for line in plan if "_w" in line or "_anchors" in line)
