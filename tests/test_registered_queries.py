"""Every registered query against its SQL twin; the others must run and keep their invariants."""

import pytest

import __spark_entry__ as entry_module
from tests import oracle
from ticketloom.plans import catalogue

QUERIES = catalogue.all_queries()


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


# Refuses the smallest data set, which has fewer than 100 labelled tickets.
NEEDS_MORE_ROWS = {
    "training_rows", "routing_predictions", "routing_training_summary", "stored_router_predictions", "routing_evaluation",
    "routing_cross_validation", "routing_explanations", "triage_table",
}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql and n not in NEEDS_MORE_ROWS])
def test_matches_sql(spark, folder, con, name):
    assert oracle.difference(QUERIES[name].run(spark, folder), con, QUERIES[name].sql) is None


@pytest.mark.parametrize("name", sorted(NEEDS_MORE_ROWS))
def test_matches_sql_on_more_rows(spark, name):
    larger = "/root/testdata/sf0.01"
    assert oracle.difference(QUERIES[name].run(spark, larger), oracle.connect(larger), QUERIES[name].sql) is None


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_is_wired():
    assert set(QUERIES) <= set(entry_module.queries())
    assert {name for name, q in QUERIES.items() if q.sql} <= set(entry_module.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_point_ids_match_uuid5(spark, folder):
    import uuid

    for row in QUERIES["vector_point_ids"].run(spark, folder).collect():
        assert row["point_id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, str(row["vec_id"])))


#: Results of fitted models, held against plain versions in test_router_values.py.
MODEL_RESULTS = {"routing_labels", "routing_report", "routing_reasons", "topic_keywords"}
#: Stems have no SQL form; held against a search over stems below.
STEMMED = {"stemmed_articles"}


def test_every_other_query_has_a_twin():
    assert {n for n, q in QUERIES.items() if not q.sql} == MODEL_RESULTS | STEMMED


def test_stemmed_search(spark, folder):
    """Every published article against every passage, by plain counts of stems."""
    import re
    from collections import Counter

    from ticketloom import vocab
    from ticketloom.functions.stemming import stem

    def stems(text):
        words = [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]
        return [stem(w) for w in words if w not in vocab.STOP_WORDS]

    documents = spark.read.parquet(f"{folder}/documents.parquet").collect()
    listed = [(r["doc_id"], Counter(stems(r["text"].split("\n")[0])), Counter(stems(r["text"]))) for r in documents if r["lang"] != "es"]
    want = []
    for q in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        hits = []
        for key, title, content in listed:
            s = sum(title[t] + 0.4 * content[t] for t in set(stems(q["text"])))
            if s > 0:
                hits.append((-round(s / (s + 1), 6), key))
        want += [(q["item_id"], key, -s, r) for r, (s, key) in enumerate(sorted(hits)[:5], 1)]
    got = QUERIES["stemmed_articles"].run(spark, folder).collect()
    assert sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in got) == sorted(want)


def test_model_results(spark):
    larger = "/root/testdata/sf0.01"
    labels = QUERIES["routing_labels"].run(spark, larger).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    assert {r["ticket_id"] for r in labels} == set(truth)
    assert sum(r["predicted_category"] == truth[r["ticket_id"]] for r in labels) > 0.95 * len(labels)
    report = {r["label"]: r for r in QUERIES["routing_report"].run(spark, larger).collect()}
    assert report["accuracy"]["f1"] > 0.9 and report["macro avg"]["recall"] > 0.85
    topics = QUERIES["topic_keywords"].run(spark, larger).collect()
    assert sum(r["size"] for r in topics) == len(truth) and all(r["keywords"].count(",") == 4 for r in topics)
