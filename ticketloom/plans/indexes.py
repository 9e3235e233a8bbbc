"""The stored indexes of the registered searches: each is written once per application and folder, then only read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.operators import chunking, posting_index, quantized
from ticketloom.session import scratch_path
from ticketloom.sources import standins as S

_WRITTEN: dict[tuple[str, str, str], object] = {}


def _there(spark, path: str) -> bool:
    """Whether the index is still in the shared folder, which may be cleared between queries."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _index(name: str):
    def wrap(write):
        def opened(spark, folder):
            at = (spark.sparkContext.applicationId, folder, name)
            if at not in _WRITTEN or not _there(spark, _WRITTEN[at].path):
                _WRITTEN[at] = write(spark, folder, scratch_path(spark, f"index-{name}"))
            return _WRITTEN[at]

        return opened

    return wrap


def _published(spark, folder):
    return S.articles(spark, folder).where(F.col("status") == "published")


@_index("articles")
def articles(spark, folder, path):
    """Published articles: title class A, content class B."""
    fields = {"A": F.col("title"), "B": F.col("content")}
    return posting_index.write_postings(_published(spark, folder), F.col("article_id"), fields, path, ("category",))


@_index("stemmed-articles")
def stemmed_articles(spark, folder, path):
    """Published articles by stems."""
    fields = {"A": F.col("title"), "B": F.col("content")}
    return posting_index.write_postings(_published(spark, folder), F.col("article_id"), fields, path, ("category",), stemmed=True)


@_index("article-rows")
def article_rows(spark, folder, path):
    """All articles by title (A), summary (B) and content (C)."""
    listed = S.articles(spark, folder).withColumn("summary", T.summary(F.col("content")))
    fields = {"A": F.col("title"), "B": F.col("summary"), "C": F.col("content")}
    return posting_index.write_postings(listed, F.col("article_id"), fields, path, ("category", "status"))


@_index("chunks")
def chunks(spark, folder, path):
    """Chunks of published articles: title class A, chunk text class B; a chunk's key is its article and its number."""
    listed = _published(spark, folder).select("article_id", "title", "content")
    parts = chunking.chunk_table(listed.select("article_id", "content"), "article_id", "content")
    titled = parts.join(listed.select("article_id", "title"), "article_id")
    fields = {"A": F.col("title"), "B": F.col("content")}
    return posting_index.write_postings(titled, F.struct("article_id", "chunk_index"), fields, path)


@_index("tickets")
def tickets(spark, folder, path):
    """Tickets of any status: subject class A, body class B."""
    fields = {"A": F.col("subject"), "B": F.col("body")}
    return posting_index.write_postings(S.text_tickets(spark, folder), F.col("ticket_id"), fields, path, ("category", "status"))


@_index("documents")
def documents(spark, folder, path):
    """Whole documents in one class, for BM25."""
    return posting_index.write_postings(S.documents(spark, folder), F.col("doc_id"), {"C": F.col("text")}, path)


@_index("vectors")
def vectors(spark, folder, path):
    """All vectors, compressed."""
    return quantized.write_index(S.vectors(spark, folder), "vec_id", "embedding", path)
