from pyspark.sql import functions as F

from ticketloom.operators import routing, topics
from ticketloom.sources import standins as S

FOLDER = "/root/testdata/sf0.01"


def test_router_beats_the_majority(spark):
    rows = routing.training_rows(S.labelled_tickets(spark, FOLDER))
    scored = routing.fit_router(rows.where("ticket_id % 4 > 0")).predict(rows.where("ticket_id % 4 = 0")).collect()
    assert sum(r["category"] == r["predicted_category"] for r in scored) > 0.9 * len(scored)
    assert all(abs(sum(r["category_probabilities"].values()) - 1) < 1e-6 for r in scored)


def test_too_few_tickets_give_empty_tables(spark):
    tickets = spark.createDataFrame([(1, "a", "b")], "ticket_id long, subject string, body string")
    assert topics.fit_topics(tickets) is None and topics.fit_features(tickets) is None
    assert topics.profiles(None, tickets, "ticket_id").collect() == []
    assert topics.topic_table(None, tickets, "ticket_id", "created_at", "2001-01-01 00:00:00").collect() == []
    assert topics.projection(None, tickets, "ticket_id").collect() == []


def test_topics_cover_all_tickets(spark):
    words = ["ship", "late", "invoice", "refund", "login", "password", "printer", "paper"]
    rows = [(i, words[i % 4], " ".join([words[i % 8], words[(i + 1) % 8], "common"] * 3)) for i in range(40)]
    tickets = spark.createDataFrame(rows, "ticket_id long, subject string, body string")
    profile = topics.profiles(topics.fit_topics(tickets, restarts=2), tickets, "ticket_id").collect()
    assert sum(r["size"] for r in profile) == 40 and all(r["keywords"] and r["example"] for r in profile)


def test_heaviest_terms_against_plain_counts(spark):
    """Counts and rows of words and pairs; equal terms in order of the term, rare words' pairs left out or not."""
    from collections import Counter

    from ticketloom import vocab
    from ticketloom.operators import features

    texts = [f"alpha beta beta w{i % 7} alpha the beta w{i % 3} x" + " gamma delta" * (i % 4) for i in range(30)] + ["", "w1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lists = []
    for t in texts:
        words = [w for w in t.split() if len(w) > 1 and w not in vocab.STOP_WORDS]
        lists.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    n, rows = sum(lists, Counter()), Counter(t for c in lists for t in c)
    usable = sorted((t for t in n if 2 <= rows[t] <= 0.9 * len(texts)), key=lambda t: (-n[t], t))
    for most in (3, 8, 15, 1000):
        model = features.fit_tfidf(df, "t", most, 2, 0.9)
        assert features.vocabulary(model) == usable[:most]
    got = {r["t"]: r["_counts"] for r in model.transform(df).select("t", "_counts").collect()}
    assert all({usable[i]: v for i, v in zip(got[t].indices, got[t].values)} == {k: c[k] for k in c if k in usable} for t, c in zip(texts, lists))


def test_counts_of_terms_keep_nothing_in_memory(spark):
    from ticketloom.operators import features

    kept = lambda: spark.sparkContext._jsc.sc().getRDDStorageInfo()
    df = spark.createDataFrame([("one two three two",)] * 5 + [("four five",)] * 5, "t string")
    before = len(kept())
    features.fit_tfidf(df, "t", 10, 2, 0.8)
    assert len(kept()) == before and not hasattr(features, "CountVectorizer")


def test_folds_are_fitted_at_the_same_time(spark, monkeypatch):
    """All folds wait for each other; their lines are those of folds fitted one after the other."""
    import threading

    rows = [(i, f"word{i % 3} left", f"word{i % 3} right w{i % 7}", f"c{i % 3}", f"P{2 + i % 2}") for i in range(90)]
    tickets = spark.createDataFrame(rows, "ticket_id long, subject string, body string, category string, priority string")
    fit, meeting = routing.fit_router, threading.Barrier(3, timeout=60)

    def fit_together(*args, **options):
        meeting.wait()
        return fit(*args, **options)

    monkeypatch.setattr(routing, "fit_router", fit_together)
    together = sorted(map(tuple, routing.cross_validate(tickets, "ticket_id", 3, max_iter=20).collect()))
    monkeypatch.setattr(routing, "fit_router", fit)
    monkeypatch.setattr(routing, "ROWS_AT_ONCE", 1)
    assert sorted(map(tuple, routing.cross_validate(tickets, "ticket_id", 3, max_iter=20).collect())) == together
    assert sum(line[1] for line in together) == 90


def test_tasks_of_a_fit(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [routing._tasks(spark, n) for n in (0, 1, 2_001, 25_000 * cores, 25_000 * (cores + 3))] == [1, 1, 2, cores, cores + 3]


TEXTS = ["Ship late invoice", "refund the refund", "", None, "login password login", "Émile's paper, printer paper", "late late ship"] * 6


def test_texts_are_read_once_for_topics(spark):
    """Vocabulary, clusters, profiles and trends come from one reading of the texts, after that of the first few."""
    read = spark.sparkContext.accumulator(0)

    def body(i):
        read.add(1)
        return TEXTS[i]

    numbers = spark.range(len(TEXTS)).repartition(4)
    made = F.udf(body, "string").asNondeterministic()(F.col("id").cast("int"))
    day = F.make_timestamp(F.lit(2001), F.lit(1), F.col("id").cast("int") % 28 + 1, F.lit(0), F.lit(0), F.lit(0))
    tickets = numbers.select(F.col("id").alias("ticket_id"), F.lit("word").alias("subject"), made.alias("body"), day.alias("at"))
    table = topics.topic_table(topics.fit_topics(tickets, restarts=2), tickets, "ticket_id", "at", "2001-02-01 00:00:00").collect()
    assert sum(r["size"] for r in table) == sum(r["recent"] for r in table) == len(TEXTS)
    assert read.value <= 2 * len(TEXTS)


def test_clusters_of_fitted_tickets_are_those_of_any(spark):
    rows = [(i, "word", t) for i, t in enumerate(TEXTS)] + [(None, None, "late paper"), (3, "twice", "late ship")]
    tickets = spark.createDataFrame(rows, "ticket_id long, subject string, body string").repartition(3)
    found = topics.fit_topics(tickets, restarts=2)
    once = found.assign(tickets, ["ticket_id", "subject"])
    again = found.assign(tickets.select("*"), ["ticket_id", "subject"])
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_features_made_of_counted_words(spark, monkeypatch):
    """The features of written words are those of the stages, in whatever portions; with too many words to send, too."""
    from ticketloom.operators import features

    df = spark.createDataFrame([(i, t and t.lower()) for i, t in enumerate(TEXTS)], "id long, t string").repartition(3)

    def held(rows):
        return {r["id"]: (list(r["features"].indices), [round(v, 12) for v in r["features"].values]) for r in rows.collect()}

    for most, bigrams in ((1000, True), (4, True), (1000, False)):
        first = features.fit_parts(df, "t", ["id"], max_features=most, bigrams=bigrams)[0]
        want = held(features.with_features(first.pipeline, df.fillna("", ["t"]), ["id"]))
        assert held(first.rows()) == want and len(want) == len(TEXTS)
        for name, value in (("CHARS_AT_ONCE", 7), ("MOST_SENT_WORDS", 1)):
            with monkeypatch.context() as changed:
                changed.setattr(features, name, value)
                other = features.fit_parts(df, "t", ["id"], max_features=most, bigrams=bigrams)[0]
                assert features.vocabulary(other.pipeline) == features.vocabulary(first.pipeline)
                assert held(other.rows()) == want


def test_parts_left_out(spark):
    """One counting for all folds gives what each fold's own rows give; rows without a fold are in none."""
    from ticketloom.operators import features

    rows = [(None if i == 5 else i % 3, f"red w{i % 4} blue w{i % 6} red" if i % 5 else "green red w1") for i in range(60)]
    df = spark.createDataFrame(rows, "part int, t string").repartition(4)
    for size in (5, 1000):
        for out, fitted in zip((0, 1, 2), features.fit_parts(df, "t", ["part"], "part", [0, 1, 2], size)):
            alone = features.fit_tfidf(df.where(F.col("part") != out), "t", size)
            assert features.vocabulary(fitted.pipeline) == features.vocabulary(alone)
            assert fitted.pipeline.stages[-2].getScalingVec() == alone.stages[-2].getScalingVec()
            assert fitted.rows().count() == 60


def test_words_are_found_once_for_all_folds(spark, monkeypatch):
    """The folds share the words of the tickets; their lines are those of routers fitted on the other folds alone."""
    read, plain = spark.sparkContext.accumulator(0), routing.plain_tickets

    def same(text):
        read.add(1)
        return text

    rows = [(i, "left", f"word{i % 3} right w{i % 7}", f"c{i % 3}", f"P{2 + i % 2}") for i in range(90)]
    tickets = spark.createDataFrame(rows, "ticket_id long, subject string, body string, category string, priority string")
    seen = F.udf(same, "string").asNondeterministic()
    with monkeypatch.context() as changed:
        changed.setattr(routing, "plain_tickets", lambda t: plain(t).withColumn("_text", seen("_text")))
        lines = {r["fold"]: r for r in routing.cross_validate(tickets, "ticket_id", 3, max_iter=20).collect()}
    assert read.value == 90
    slot = F.conv(F.substring(routing.hash_order("ticket_id", 42), 1, 8), 16, 10).cast("bigint")
    marked = tickets.withColumn("fold", F.floor(slot * 3 / 2**32).cast("int"))
    for fold, line in lines.items():
        router = routing.fit_router(marked.where(F.col("fold") != fold), max_iter=20)
        scored = router.predict(marked.where(F.col("fold") == fold)).collect()
        right = sum(r["category"] == r["predicted_category"] for r in scored)
        assert line["samples"] == len(scored) > 0 and abs(line["category_accuracy"] - right / len(scored)) < 1e-9
