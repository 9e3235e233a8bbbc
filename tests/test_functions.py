import uuid

import pytest
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import normalize as N
from ticketloom.functions import text as T
from ticketloom.functions import vectors as V


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_priority(spark):
    given = ["P1", "p2-High", "1-URGENT", "5-LOW", " Critical ", "whatever", "10 days", "", None]
    assert values(spark, N.normalize_priority, *given) == ["P1", "P2", "P1", "P4", "P1", "P3", "P3", None, None]


def test_priority_compat_loses_normalised_values(spark):
    got = values(spark, lambda c: N.normalize_priority(c, compat=True), "P1", "high", "4", None)
    assert got == ["P3", "P2", "P4", None]


def test_category(spark):
    given = [" Bug ", "REFUND", "home goods", "", None]
    assert values(spark, N.normalize_category, *given) == ["Technical", "Returns", "Home Goods", None, None]
    assert values(spark, lambda c: N.normalize_category(c, compat=True), "a-b", " x") == ["A-B", " X"]


def test_priority_prefix(spark):
    assert values(spark, N.priority_prefix, "P2-High", None, "", "urgent") == ["P2", "P3", "P3", "urgent"]


def test_hedging_and_preview(spark):
    assert values(spark, N.hedging_count, "It SEEMS fine, probably", "sure", None) == [2, 0, 0]
    assert values(spark, lambda c: N.preview(c, 3), "abcd", "abc") == ["abc...", "abc"]


def test_modification_share(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abce"), ("abcd", "wxyz"), ("", "")], "a string, b string")
    share = N.modification_share(F.col("a"), F.col("b"))
    rows = df.select(share.alias("s"), N.acceptance_band(share).alias("b")).collect()
    assert [(r.s, r.b) for r in rows] == [(0.0, "as_is"), (0.25, "major"), (1.0, "major"), (0.0, "as_is")]



def test_rubric(spark):
    df = spark.createDataFrame([(5, None), (9, -4)], "a int, b int")
    row = df.select(N.clamp_score(F.col("a")).alias("a"), N.clamp_score(F.col("b")).alias("b")).collect()
    assert [(r.a, r.b) for r in row] == [(5, 3), (5, 1)]
    assert sum(vocab.RUBRIC_WEIGHTS.values()) == pytest.approx(1.0)


def test_tokens_keep_accents(spark):
    assert values(spark, T.tokens, "Été_1, l'eau!", "", None) == [["été_1", "l", "eau"], [], []]


def test_front_matter_and_title(spark):
    page = "---\nCategory: Billing\ntags: [a, b c]\nauthor: Jo: X\n---\n# Hello *you*\n\nFirst **para** [link](u).\n\nSecond"
    df = spark.createDataFrame([(page, "some-file_name.md"), ("no heading", "some-file_name.md")], "v string, f string")
    m = T.front_matter(F.col("v"))
    text = T.markdown_to_text(T.without_front_matter(F.col("v")))
    rows = df.select(
        T.article_title(F.col("v"), F.col("f")).alias("title"),
        T.front_matter_value(m, "category").alias("category"),
        T.front_matter_tags(m).alias("tags"),
        T.front_matter_value(m, "author").alias("author"),
        T.summary(text).alias("summary"),
        text.alias("text"),
    ).collect()
    first, second = rows
    assert (first.category, first.tags, first.author) == ("Billing", ["a", "b c"], "Jo: X")
    assert first.title == "Hello *you*" and second.title == "Some File Name"
    assert "First para link." in first.text and second.tags == [] and second.category is None
    assert second.summary == "no heading"


def test_html(spark):
    html = "<html><head><style>p{}</style><script>a<b</script></head><!-- x --><p>A &lt;b&gt; &amp;amp;</p><p>B</p></html>"
    assert values(spark, T.html_to_text, html) == ["A <b> &amp;\nB"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(V.l2_normalize(F.col("a")).alias("u"), V.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0].u == pytest.approx([0.6, 0.8]) and rows[0].c == pytest.approx(0.96)
    assert rows[1].u == [0.0, 0.0] and rows[1].c == 0.0


def test_point_id_keeps_uuid(spark):
    known = str(uuid.uuid4())
    assert values(spark, V.point_id, known, "doc-1") == [known, str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc-1"))]
