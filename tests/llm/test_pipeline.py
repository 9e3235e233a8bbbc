import __spark_entry__ as entry_module
import corpus_pipeline
from tests.llm.test_decontamination import brute as contained
from tests.llm.test_ngram_join import brute as grouped
from ticketloom.llm.queries import bpe_digests

FOLDER = "/root/testdata/sf0.01"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_join", "decontamination", "byte_bpe"]


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        kept = {r["doc_id"] for r in docs.collect()}
        assert all(before[r["doc_id"]] == r for r in docs.collect())
        texts = [(i, r["text"]) for i, r in before.items()]
        if name == "ngram_join":
            assert kept == {i for i, _, component in grouped(texts) if i == component}
        if name == "decontamination":
            assert kept == set(before) - {i for i, *_ in contained(texts, benchmark)}
        if name == "language_id":
            assert kept == {i for i, t in texts if t and any(c.isalpha() for c in t)}
    want = sorted(map(tuple, bpe_digests(docs).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == want


def test_odd_rows(spark, documents):
    text = "these are five or more ordinary words that repeat"
    rows = [(1, text, "en"), (1, text, "en"), (2, text, "en"), (None, text, "en"), (None, None, None), (3, None, "en"), (4, "", "en"),
            (5, "12 34", "en"), (6, "word " * 30_000, None)]
    docs = documents(rows, extra=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        got = sorted((r["doc_id"] for r in out.collect()), key=repr)
        if name == "ngram_join":
            assert got == sorted([1, None, None, 3, 4, 5, 6], key=repr)
        elif name == "decontamination":
            assert got == sorted((r[0] for r in rows), key=repr)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == len(rows)


def test_empty_table(spark, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents([]), FOLDER).collect() == []


def test_entry_has_all_queries():
    names = entry_module.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}


WORDS = {"en": "the house of our neighbours was sold when they moved away with which this that ", "fr": "la maison de nos voisins était vendue quand ils sont partis avec leur chère fille où "}


def texts_of(lang, i, n=400):
    words = WORDS[lang].split()
    return " ".join(words[(i * 7 + k * (i % 5 + 1) + k // 3) % len(words)] for k in range(n))


def test_language_stage_without_a_network(spark, documents):
    docs = documents([(1, "a plain text", None), (2, "12 34", None), (3, None, None), (None, "日本", None)])
    got = corpus_pipeline.language_stage(spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == [1, None]


def test_language_stage_asks_the_network(spark, documents):
    clean = [(i, texts_of(lang, i), lang) for i in range(0, 160, 2) for lang in ("en",)]
    clean += [(i, texts_of("fr", i), "fr") for i in range(1, 160, 2)]
    mixed = [(None, texts_of("en", 3) + " " + texts_of("fr", 4), None)]  # a blind guess between the two
    got = corpus_pipeline.language_stage(spark, documents(clean + mixed), FOLDER).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in clean), key=repr)


STRANGE = [
    "xq zvk wqpl brfg tnx klw zzx qqp vvb mnm rtrt wkwk jjh " * 3,
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "123 456 789 1011 a 55 66 77 8899 1234 555",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
]


def test_language_stage_rejects_what_is_in_no_language(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    strange = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(STRANGE)], "doc_id long, text string")
    docs = given.unionByName(strange, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, FOLDER).select("doc_id").collect()}
    assert not {i for i in kept if i >= 10_000_000}
    assert len(kept) >= 0.995 * given.count()


def test_columns_of_any_names_and_types(spark, documents):
    from pyspark.sql import functions as F

    text = "these are five or more ordinary words that repeat"
    names = ["_row", "_bucket", "_bits", "x.y", "_key", "lang_pred", "score", "tile", "a", "b"]
    docs = documents([(1, text, "en"), (1, text, "en"), (2, text + " again", "en"), (None, text, None)])
    docs = docs.select("*", *[F.lit("x").alias(n) for n in names], F.create_map(F.lit("k"), F.lit(1)).alias("map"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        rows = out.collect()
        assert len(rows) == (2 if name == "ngram_join" else 4)
        assert all(r["x.y"] == "x" and r["map"] == {"k": 1} for r in rows)


def test_language_limits_come_from_all_rows(spark, documents, monkeypatch):
    """Limits see every labelled row that may teach, also where the network learns from a few."""
    import functools

    from pyspark.sql import functions as F

    from ticketloom.llm import language_id
    from ticketloom.llm.queries import language_network, language_rows

    docs = documents([(i, texts_of(("en", "fr")[i % 2], i), ("en", "fr")[i % 2]) for i in range(160)])
    small = functools.partial(language_id.learn, max_bytes_per_language=3_000)
    monkeypatch.setattr("ticketloom.llm.queries.language_id.learn", small)
    seen, plain = [], language_id.limits
    monkeypatch.setattr(corpus_pipeline.language_id, "limits", lambda net, right: seen.append(right.count()) or plain(net, right))
    corpus_pipeline.language_stage(spark, docs, FOLDER).collect()
    named = language_id.predict(language_rows(docs), "doc_id", "text", language_network(docs), "lang")
    assert seen == [named.where(F.col("lang_pred") == F.col("lang")).count()] and seen[0] > 100
