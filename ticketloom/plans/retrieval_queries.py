"""Registered queries: lexical, dense and fused retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.operators import chunk_index, dense, fusion, posting_index, quantized
from ticketloom.operators import relational as L
from ticketloom.plans import indexes
from ticketloom.plans import sql_parts as P
from ticketloom.plans.registry import query
from ticketloom.plans.text_queries import CHUNKS, STOP, article_chunks
from ticketloom.session import scratch_path
from ticketloom.sources import sinks
from ticketloom.sources import standins as S

QUERY_TERMS = f"""q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({P.tokens("text")}) AS term FROM benchmark)
  WHERE term NOT IN ({STOP}))"""


def bm25_sql(k: int) -> str:
    return f"""d AS (SELECT doc_id, {P.tokens("text")} AS toks FROM documents),
    st AS (SELECT count(*) AS n, avg(len(toks)) AS m FROM d),
    p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) GROUP BY ALL),
    {QUERY_TERMS},
    f AS (SELECT term, ln(1 + (st.n - count(*) + 0.5) / (count(*) + 0.5)::DOUBLE) AS idf FROM p, st WHERE term IN (SELECT term FROM q) GROUP BY term, st.n),
    sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / m))), 6) AS score
      FROM q JOIN f USING (term) JOIN p USING (term), st GROUP BY ALL),
    bm AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc
      QUALIFY rank <= {k})"""


def cover_sql(parts: list[tuple[str, float]], key: str, k: int, where_self: str = "") -> str:
    """Ranked hits from (relation with key and text, weight) parts."""
    union = " UNION ALL ".join(f"SELECT {key} AS doc_id, {w}::DOUBLE AS w, unnest({t}) AS term FROM {rel}" for (rel, t), w in parts)
    return f"""{QUERY_TERMS}, occ AS ({union}),
    sc AS (SELECT query_id, doc_id, sum(w) AS s FROM q JOIN occ USING (term) {where_self} GROUP BY ALL),
    ranked AS (SELECT query_id, doc_id, round(s / (s + 1), 6) AS score FROM sc),
    hits AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM ranked WHERE score > 0 QUALIFY rank <= {k})"""


def okapi_hits(spark, folder, k):
    index = indexes.documents(spark, folder)
    return posting_index.search(index, S.passages(spark, folder), "query_id", "query_text", k, posting_index.OKAPI)


@query("bm25_top_documents", "J10 D12 C9 F1", f"WITH {bm25_sql(10)} SELECT * FROM bm")
def bm25_top_documents(spark, folder):
    return okapi_hits(spark, folder, 10)


ARTICLE_PARTS = [(("pub", P.tokens("title")), 1.0), (("pub", P.tokens("content")), 0.4)]


@query(
    "cover_rank_articles", "J5 C3 C4 C9",
    f"""WITH {P.ARTICLES}, pub AS (SELECT * FROM articles WHERE status = 'published'),
    {cover_sql(ARTICLE_PARTS, "article_id", 5)} SELECT * FROM hits""",
)
def cover_rank_articles(spark, folder):
    return posting_index.search_articles(indexes.articles(spark, folder), S.passages(spark, folder), 5)


@query(
    "cover_rank_articles_in_category", "J5 C3",
    f"""WITH {P.ARTICLES}, pub AS (SELECT * FROM articles WHERE status = 'published' AND category = 'src7'),
    {cover_sql(ARTICLE_PARTS, "article_id", 5)} SELECT * FROM hits WHERE score > 0.5""",
)
def cover_rank_articles_in_category(spark, folder):
    return posting_index.search_articles(
        indexes.articles(spark, folder), S.passages(spark, folder), 5, category="src7", min_score=0.5
    )


@query(
    "cover_rank_chunks", "J5 D1 A8",
    f"""WITH RECURSIVE {CHUNKS}, {P.ARTICLES},
    pub AS (SELECT {{'article_id': c.article_id, 'chunk_index': c.chunk_index}} AS chunk_id, a.title, c.content FROM chunks c JOIN articles a USING (article_id) WHERE a.status = 'published'),
    {cover_sql(ARTICLE_PARTS, "chunk_id", 5)} SELECT query_id, doc_id.article_id, doc_id.chunk_index, score, rank FROM hits""",
)
def cover_rank_chunks(spark, folder):
    hits = posting_index.search_articles(indexes.chunks(spark, folder), S.passages(spark, folder), 5)
    return hits.select("query_id", "doc_id.article_id", "doc_id.chunk_index", "score", "rank")


@query("stemmed_articles", "J5 U3")
def stemmed_articles(spark, folder):
    """Published articles by cover rank over English stems."""
    return posting_index.search_articles(indexes.stemmed_articles(spark, folder), S.passages(spark, folder), 5)


TICKET_PARTS = [(("done", P.tokens("subject")), 1.0), (("done", P.tokens("body")), 0.4)]


@query(
    "similar_tickets", "J6 C3",
    f"""WITH {P.TEXT_TICKETS}, done AS (SELECT * FROM text_tickets WHERE status IN ('resolved', 'closed')),
    {cover_sql(TICKET_PARTS, "ticket_id", 5, "WHERE query_id <> doc_id")} SELECT * FROM hits""",
)
def similar_tickets(spark, folder):
    return posting_index.search_tickets(indexes.tickets(spark, folder), S.passages(spark, folder), 5)


@query(
    "combined_search", "J7 H1",
    f"""WITH {P.TEXT_TICKETS}, {P.ARTICLES}, pub AS (SELECT * FROM articles WHERE status = 'published'),
    done AS (SELECT * FROM text_tickets WHERE status IN ('resolved', 'closed')),
    a AS (WITH {cover_sql(ARTICLE_PARTS, "article_id", 3)} SELECT * FROM hits),
    t AS (WITH {cover_sql(TICKET_PARTS, "ticket_id", 2, "WHERE query_id <> doc_id")} SELECT * FROM hits)
    SELECT *, 'kb_chunk' AS source_type FROM a UNION ALL SELECT *, 'ticket' FROM t""",
)
def combined_search(spark, folder):
    return posting_index.combined_search(
        indexes.articles(spark, folder), indexes.tickets(spark, folder), S.passages(spark, folder)
    )


CENTROIDS = """dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
  means AS (SELECT label, i, avg(x) AS x FROM dims GROUP BY ALL),
  cents AS (SELECT label AS query_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM means)"""


def dense_sql(where: str = "", k: int = 5) -> str:
    return f"""{CENTROIDS},
    ds AS (SELECT query_id, vec_id AS doc_id, label, round(sum(c.x * d.x), 6) AS score FROM cents c JOIN dims d USING (i) {where} GROUP BY ALL),
    dense AS (SELECT query_id, doc_id, label, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM ds QUALIFY rank <= {k})"""


def label_queries(spark, folder):
    """One query per label: the mean vector."""
    return dense.centroids(S.vectors(spark, folder), "label", "embedding")


def dense_hits(spark, folder, k, corpus=None):
    corpus = S.vectors(spark, folder) if corpus is None else corpus
    return dense.dense_topk(label_queries(spark, folder), "label", "embedding", corpus, "vec_id", "embedding", k)


@query("dense_topk", "J3 D11 G1 S19", f"WITH {dense_sql(k=10)} SELECT query_id, doc_id, score, rank FROM dense")
def dense_topk(spark, folder):
    return dense_hits(spark, folder, 10)


@query(
    "dense_topk_filtered", "J4 C7",
    f"""WITH {dense_sql("WHERE d.label = 3")} SELECT query_id, doc_id, score, rank FROM dense""",
)
def dense_topk_filtered(spark, folder):
    payload = S.vectors(spark, folder).withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return dense_hits(spark, folder, 5, L.metadata_filter(payload, {"label": "3"}))


@query(
    "dense_topk_postfiltered", "C8",
    f"""WITH {dense_sql(k=15)} SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM (SELECT query_id, doc_id, score FROM dense WHERE label <> query_id)) WHERE rank <= 5""",
)
def dense_topk_postfiltered(spark, folder):
    labels = S.vectors(spark, folder).select(F.col("vec_id").alias("doc_id"), "label")
    hits = dense_hits(spark, folder, 15).join(labels, "doc_id")
    return dense.postfiltered_topk(hits, F.col("label") != F.col("query_id"), 5).drop("label")


NEIGHBOURS = """v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(sum(a.x * b.x), 6) AS score
      FROM v a JOIN v b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL)"""


def neighbours(spark, folder, probes):
    vectors = S.vectors(spark, folder)
    return dense.approximate_topk(
        vectors, "vec_id", "embedding", vectors, "vec_id", "embedding", 5, cells=16, probes=probes, exclude_self=True
    )


@query(
    "approximate_neighbours", "J11",
    f"""WITH {NEIGHBOURS} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM s QUALIFY rank <= 5""",
)
def approximate_neighbours(spark, folder):
    """With as many probes as cells the search is exact."""
    return neighbours(spark, folder, 16)


@query("approximate_recall", "J11", "SELECT count(*) AS queries, TRUE AS recall_reached FROM embeddings")
def approximate_recall(spark, folder):
    """Recall of the search in three quarters of the cells against the exact one, over all vectors as queries."""
    exact = sinks.stored(neighbours(spark, folder, 16), "exact-neighbours").select("query_id", "doc_id")
    found = neighbours(spark, folder, 12).select("query_id", "doc_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "doc_id"], "left")
    recall = F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))
    return both.agg(F.count_distinct("query_id").alias("queries"), (recall >= 0.9).alias("recall_reached"))


def encoded_sql(name: str, table: str, key: str) -> str:
    return f"""{name}_b AS (SELECT {key} AS id, ('0x' || left(md5(term), 8))::BIGINT % 64 AS i, count(*)::DOUBLE AS n
      FROM (SELECT {key}, unnest({P.tokens("text")}) AS term FROM {table}) GROUP BY ALL),
    {name} AS (SELECT id, i, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT)::DOUBLE AS x FROM {name}_b)"""


def encoded(df, key, text):
    return dense.encode_table(df, key, T.tokens(F.col(text)))


@query(
    "encoded_documents", "J9 U2 S18",
    f"""WITH {encoded_sql("e", "documents", "doc_id")} SELECT id AS doc_id, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM e""",
)
def encoded_documents(spark, folder):
    vectors = encoded(S.documents(spark, folder), "doc_id", "text")
    return vectors.select("doc_id", F.posexplode("embedding").alias("i", "x")).where(F.col("x") > 0).select(
        "doc_id", "i", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query(
    "refreshed_chunk_vectors", "J9 B3 B9 U2",
    f"""WITH RECURSIVE {CHUNKS}, n AS (SELECT article_id || ':' || chunk_index AS chunk_id, CASE WHEN lang = 'fr' THEN content || ' updated' ELSE content END AS content,
      CASE WHEN lang IN ('fr', 'de') THEN 1 ELSE 0 END AS refresh FROM chunks JOIN documents ON doc_id = article_id WHERE lang <> 'es'),
    b AS (SELECT chunk_id, refresh, ('0x' || left(md5(term), 8))::BIGINT % 64 AS i, count(*)::DOUBLE AS n
      FROM (SELECT chunk_id, refresh, unnest({P.tokens("content")}) AS term FROM n) GROUP BY ALL)
    SELECT chunk_id, refresh, CAST(i AS INTEGER) AS i, round(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS FLOAT)::DOUBLE, 6) AS x FROM b""",
)
def refreshed_chunk_vectors(spark, folder):
    """Vectors of all chunks but German ones, then brought up to date: French ones changed, Spanish ones gone, German ones new."""
    listed = article_chunks(spark, folder).join(S.articles(spark, folder).select("article_id", "lang"), "article_id")
    chunks = sinks.stored(listed.select(F.concat_ws(":", "article_id", "chunk_index").alias("chunk_id"), "content", "lang"), "chunks")
    table = chunk_index.build(chunks.where("lang <> 'de'"), scratch_path(spark, "chunk-vectors"), buckets=8)
    text = F.when(F.col("lang") == "fr", F.concat("content", F.lit(" updated"))).otherwise(F.col("content"))
    after, _ = chunk_index.refresh(table, chunks.where("lang <> 'es'").withColumn("content", text))
    cells = after.read().select("chunk_id", "refresh", F.posexplode("embedding").alias("i", "x")).where("x > 0")
    return cells.withColumn("x", F.round(F.col("x").cast("double"), 6))


def hybrid_hits(spark, folder, k):
    documents, passages = S.documents(spark, folder), S.passages(spark, folder)
    by_vector = dense.dense_topk(
        encoded(passages, "query_id", "query_text"), "query_id", "embedding",
        encoded(documents, "doc_id", "text"), "doc_id", "embedding", 2 * k,
    )
    return fusion.fuse_ranks(by_vector, okapi_hits(spark, folder, 2 * k), k)


HYBRID_SQL = f"""{bm25_sql(10)}, {encoded_sql("e", "documents", "doc_id")}, {encoded_sql("b", "benchmark", "item_id")},
    ds AS (SELECT b.id AS query_id, e.id AS doc_id, round(sum(b.x * e.x), 6) AS score FROM b JOIN e USING (i) GROUP BY ALL),
    dn AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 10),
    m AS (SELECT query_id, doc_id, CAST(dn.rank AS INTEGER) AS dense_rank, CAST(bm.rank AS INTEGER) AS sparse_rank,
      round(coalesce(0.6::DOUBLE / (60 + dn.rank), 0) + coalesce(0.4::DOUBLE / (60 + bm.rank), 0), 9) AS score FROM dn FULL JOIN bm USING (query_id, doc_id)),
    fused AS (SELECT query_id, doc_id, dense_rank, sparse_rank, score,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) AS INTEGER) AS rank
    FROM m QUALIFY rank <= 5)"""


@query("hybrid_rank_fusion", "J8 D6", f"WITH {HYBRID_SQL} SELECT * FROM fused")
def hybrid_rank_fusion(spark, folder):
    return hybrid_hits(spark, folder, 5)


@query(
    "hybrid_hits_with_content", "J8 D6",
    f"""WITH {HYBRID_SQL} SELECT query_id, doc_id, rank, dense_rank IS NOT NULL AS by_vector,
      CASE WHEN dense_rank IS NOT NULL THEN text ELSE split_part(text, chr(10), 1) END AS content,
      CASE WHEN dense_rank IS NOT NULL THEN 'vector ' || lang ELSE 'article ' || source END AS metadata
    FROM fused JOIN documents USING (doc_id)""",
)
def hybrid_hits_with_content(spark, folder):
    """The vector side knows whole texts and languages, the lexical side titles and sources."""
    documents = S.table(spark, folder, "documents")
    vector_rows = documents.select("doc_id", F.col("text").alias("content"), F.concat(F.lit("vector "), "lang").alias("metadata"))
    term_rows = documents.select(
        "doc_id", T.first_line(F.col("text")).alias("content"), F.concat(F.lit("article "), "source").alias("metadata")
    )
    fused = sinks.stored(hybrid_hits(spark, folder, 5), "fused")
    found = fusion.with_content(fused, vector_rows, term_rows, S.passages(spark, folder), 5)
    return found.select("query_id", "doc_id", "rank", F.col("dense_rank").isNotNull().alias("by_vector"), "content", "metadata")


@query(
    "quantized_neighbours", "J11",
    f"""WITH {NEIGHBOURS} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM s WHERE query_id % 10 = 0 QUALIFY rank <= 5""",
)
def quantized_neighbours(spark, folder):
    """Every tenth vector asks all others through compressed vectors; the hits are exact."""
    vectors = S.vectors(spark, folder)
    index = indexes.vectors(spark, folder)
    asked = vectors.where(F.col("vec_id") % 10 == 0)
    return quantized.search(index, asked, "vec_id", "embedding", vectors, "vec_id", "embedding", 5, exclude_self=True)
