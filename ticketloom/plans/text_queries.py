"""Registered queries: markup, titles, summaries, chunks, lexical index, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import normalize as N
from ticketloom.functions import text as T
from ticketloom.operators import chunking, lexical, posting_index
from ticketloom.operators import ranking as R
from ticketloom.operators.relational import join_unique
from ticketloom.plans import indexes
from ticketloom.plans import sql_parts as P
from ticketloom.plans.registry import query
from ticketloom.session import scratch_path
from ticketloom.sources import standins as S
from ticketloom.sources.layout import spread

STOP = ", ".join(f"'{w}'" for w in vocab.STOP_WORDS)

SPAN_END = """CASE WHEN {start} + 4096 >= n THEN n
    WHEN greatest(
      CASE WHEN contains(substr(text, {start} + 3277, 820), '. ') THEN {start} + 3276 + length(regexp_extract(substr(text, {start} + 3277, 820), '(?s)^(.*)\\. ', 1)) ELSE -1 END,
      CASE WHEN contains(substr(text, {start} + 3277, 820), chr(10)) THEN {start} + 3276 + length(regexp_extract(substr(text, {start} + 3277, 820), '(?s)^(.*)\\n', 1)) ELSE -1 END) > {start}
    THEN 1 + greatest(
      CASE WHEN contains(substr(text, {start} + 3277, 820), '. ') THEN {start} + 3276 + length(regexp_extract(substr(text, {start} + 3277, 820), '(?s)^(.*)\\. ', 1)) ELSE -1 END,
      CASE WHEN contains(substr(text, {start} + 3277, 820), chr(10)) THEN {start} + 3276 + length(regexp_extract(substr(text, {start} + 3277, 820), '(?s)^(.*)\\n', 1)) ELSE -1 END)
    ELSE {start} + 4096 END"""

CHUNKS = f"""spans AS (
  SELECT doc_id, text, length(text) AS n, 0 AS start, {SPAN_END.format(start="0").replace(" n ", " length(text) ").replace(">= n", ">= length(text)")} AS stop FROM documents
  UNION ALL
  SELECT doc_id, text, n, stop - 1024, {SPAN_END.format(start="(stop - 1024)")} FROM spans WHERE stop < n),
chunks AS (
  SELECT doc_id AS article_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index,
    regexp_replace(substr(text, start + 1, stop - start), '^\\s+|\\s+$', '', 'g') AS content,
    CAST(start AS INTEGER) AS start_char, CAST(stop AS INTEGER) AS end_char
  FROM spans WHERE regexp_matches(substr(text, start + 1, stop - start), '\\S'))"""


@query(
    "article_chunks", "J1 S10",
    f"""WITH RECURSIVE {CHUNKS} SELECT article_id, chunk_index, content, CAST(length(content) // 4 AS INTEGER) AS token_count, start_char, end_char FROM chunks""",
)
def article_chunks(spark, folder):
    return chunking.chunk_table(S.articles(spark, folder).select("article_id", "content"), "article_id", "content")


@query(
    "article_chunk_statistics", "J1 E8",
    f"""WITH RECURSIVE {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT article_id) AS articles, round(avg(length(content)), 6) AS mean_length FROM chunks""",
)
def article_chunk_statistics(spark, folder):
    chunks = article_chunks(spark, folder)
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("article_id").alias("articles"),
        F.round(F.avg(F.length("content")), 6).alias("mean_length"),
    )


@query("chunks_by_sql_function", "U1 J1", f"""WITH RECURSIVE {CHUNKS} SELECT article_id, chunk_index, content FROM chunks""")
def chunks_by_sql_function(spark, folder):
    chunking.register_chunk_function(spark)
    S.articles(spark, folder).createOrReplaceTempView("chunk_articles")
    return spark.sql(
        "SELECT a.article_id, c.chunk_index, c.content FROM chunk_articles a, LATERAL chunk_text(a.content, 1024, 256) c"
    )


@query(
    "token_estimates", "S10",
    "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS token_count FROM documents",
)
def token_estimates(spark, folder):
    return S.table(spark, folder, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("token_count"))


@query(
    "combined_ticket_text", "S11",
    f"WITH {P.TEXT_TICKETS} SELECT ticket_id, subject || ' ' || subject || ' ' || body AS text FROM text_tickets",
)
def combined_ticket_text(spark, folder):
    return S.text_tickets(spark, folder).select("ticket_id", T.combine_text(F.col("subject"), F.col("body")).alias("text"))


@query(
    "query_term_rows", "S12",
    f"""SELECT DISTINCT item_id AS query_id, unnest({P.tokens("text")}) AS term FROM benchmark""",
)
def query_term_rows(spark, folder):
    return lexical.query_terms(S.passages(spark, folder), "query_id", "query_text", stop_words=[])


PAGE_TEXT = """regexp_replace(regexp_replace(
    replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\\b[^>]*>.*?</(?:script|style)\\s*>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')"""


@query("pages_to_text", "S8", f"SELECT page_id, {PAGE_TEXT} AS text FROM pages")
def pages_to_text(spark, folder):
    return spread(S.table(spark, folder, "pages"), "page_id").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(
    "page_titles_and_summaries", "S6 S9",
    f"""WITH t AS (SELECT page_id, url, {PAGE_TEXT} AS text FROM pages),
    m AS (SELECT page_id, url, '# ' || replace(text, chr(10), chr(10) || chr(10)) AS md FROM t)
    SELECT page_id, trim(regexp_extract(md, '(?m)^#\\s+(.+)$', 1)) AS title,
      left(regexp_replace(split_part(md, chr(10) || chr(10), 1), '^\\s+|\\s+$', '', 'g'), 500) AS summary FROM m""",
)
def page_titles_and_summaries(spark, folder):
    body = F.replace(T.html_to_text(F.col("html")), F.lit("\n"), F.lit("\n\n"))
    pages = spread(S.table(spark, folder, "pages"), "page_id").select("page_id", "url", F.concat(F.lit("# "), body).alias("md"))
    return pages.select(
        "page_id", T.article_title(F.col("md"), F.col("url")).alias("title"), T.summary(F.col("md")).alias("summary")
    )


@query(
    "front_matter_fields", "S7",
    """SELECT doc_id, source AS category, lang || ',' || source AS tags, CASE WHEN quality = 1 THEN 'editor' END AS author,
    text AS body FROM documents LEFT JOIN labels USING (doc_id)""",
)
def front_matter_fields(spark, folder):
    documents = S.table(spark, folder, "documents").join(S.table(spark, folder, "labels"), "doc_id", "left")
    author = F.when(F.col("quality") == 1, F.lit("author: editor\n")).otherwise(F.lit("note: none\n"))
    page = F.concat(
        F.lit("---\nCategory: "), "source", F.lit("\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\n"), author,
        F.lit("---\n"), "text",
    )
    matter = documents.select("doc_id", page.alias("page")).withColumn("matter", T.front_matter(F.col("page")))
    return matter.select(
        "doc_id",
        T.front_matter_value(F.col("matter"), "category").alias("category"),
        F.array_join(T.front_matter_tags(F.col("matter")), ",").alias("tags"),
        T.front_matter_value(F.col("matter"), "author").alias("author"),
        T.without_front_matter(F.col("page")).alias("body"),
    )


@query(
    "lexical_index", "J2",
    f"""WITH {P.TEXT_TICKETS}, f AS (
      SELECT ticket_id, 'A' AS weight_class, unnest({P.tokens("subject")}) AS term FROM text_tickets
      UNION ALL SELECT ticket_id, 'B', unnest({P.tokens("body")}) FROM text_tickets)
    SELECT ticket_id, weight_class, term, CAST(count(*) AS INTEGER) AS tf FROM f WHERE term NOT IN ({STOP}) GROUP BY ALL""",
)
def lexical_index(spark, folder):
    """Written and read back."""
    fields = {"A": F.col("subject"), "B": F.col("body")}
    path = scratch_path(spark, "lexical-index")
    index = posting_index.write_postings(S.text_tickets(spark, folder), F.col("ticket_id"), fields, path, ("category", "status"))
    return index.postings().withColumnRenamed("key", "ticket_id")


@query(
    "article_row_index", "J2",
    f"""WITH {P.ARTICLES}, s AS (SELECT article_id, title, content, left(list_filter(list_transform(string_split(content, chr(10) || chr(10)),
      lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')[1], 500) AS summary FROM articles),
    f AS (SELECT article_id, 'A' AS weight_class, unnest({P.tokens("title")}) AS term FROM s
      UNION ALL SELECT article_id, 'B', unnest({P.tokens("summary")}) FROM s
      UNION ALL SELECT article_id, 'C', unnest({P.tokens("content")}) FROM s)
    SELECT article_id, weight_class, term, CAST(count(*) AS INTEGER) AS tf FROM f WHERE term NOT IN ({STOP}) GROUP BY ALL""",
)
def article_row_index(spark, folder):
    return indexes.article_rows(spark, folder).postings().withColumnRenamed("key", "article_id")


@query(
    "tfidf_weights", "K2",
    f"""WITH f AS (SELECT doc_id, unnest({P.tokens("text")}) AS term FROM documents),
    p AS (SELECT doc_id, term, count(*) AS tf FROM f WHERE term NOT IN ({STOP}) GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM documents),
    v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM p GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n)
          ORDER BY total DESC, term LIMIT 10000),
    w AS (SELECT p.doc_id, p.term, p.tf, v.df, ln((1 + n.n) / (1 + v.df)::DOUBLE) + 1 AS idf FROM p JOIN v USING (term), n)
    SELECT doc_id, term, CAST(tf AS INTEGER) AS tf, df, round(idf, 6) AS idf,
      round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
)
def tfidf_weights(spark, folder):
    words = lexical.without_stop_words(T.tokens(F.col("text")))
    weights = lexical.tfidf(S.documents(spark, folder), "doc_id", words)
    return weights.select(
        "doc_id", "term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight")
    )


@query(
    "top_terms_per_category", "F5 F1",
    f"""WITH f AS (SELECT source AS category, unnest({P.tokens("text")}) AS term FROM documents),
    c AS (SELECT category, term, count(*) AS n FROM f WHERE term NOT IN ({STOP}) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, term) AS rank FROM c)
    SELECT category, term, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def top_terms_per_category(spark, folder):
    words = lexical.without_stop_words(T.tokens(F.col("text")))
    terms = S.documents(spark, folder).select(F.col("source").alias("category"), F.explode(words).alias("term"))
    counts = terms.groupBy("category", "term").agg(F.count(F.lit(1)).alias("n"))
    return R.rank_hits(counts, "category", 10, F.col("n").desc(), F.col("term"))


@query(
    "hedging_flags", "S24",
    f"""WITH {P.DRAFTS}, t AS (SELECT ticket_id, draft_no, draft_text || CASE WHEN draft_no = 3 THEN ' I THINK it is possibly so' ELSE '' END AS t FROM drafts)
    SELECT ticket_id, draft_no, CAST({" + ".join(f"contains(lower(t), '{p.lower()}')::INT" for p in vocab.HEDGING_PHRASES)} AS INTEGER) AS hedges FROM t""",
)
def hedging_flags(spark, folder):
    note = F.when(F.col("draft_no") == 3, " I THINK it is possibly so").otherwise("")
    drafts = S.drafts(spark, folder).withColumn("t", F.concat("draft_text", note))
    return drafts.select("ticket_id", "draft_no", N.hedging_count(F.col("t")).alias("hedges"))


# The SQL twin's edit distance counts bytes, so there each accented letter of the table is one control character.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
CONTROLS = "".join(map(chr, [*range(1, 9), *range(14, 27)]))


@query(
    "draft_edit_bands", "S27 M9",
    f"""WITH {P.DRAFTS}, p AS (SELECT ticket_id, draft_no, translate(draft_text, '{ACCENTED}', '{CONTROLS}') AS t FROM drafts),
    l AS (SELECT ticket_id, max_by(t, draft_no) AS final_text FROM p GROUP BY ticket_id),
    s AS (SELECT ticket_id, draft_no, levenshtein(t, final_text) / greatest(length(t), length(final_text))::DOUBLE AS share FROM p JOIN l USING (ticket_id))
    SELECT ticket_id, draft_no, round(share, 6) AS modification_share,
      CASE WHEN share = 0 THEN 'as_is' WHEN share < 0.2 THEN 'minor' ELSE 'major' END AS band FROM s""",
)
def draft_edit_bands(spark, folder):
    drafts = S.drafts(spark, folder).select("ticket_id", "draft_no", F.col("draft_text").alias("text"))
    final = drafts.groupBy("ticket_id").agg(F.max_by("text", "draft_no").alias("final_text"))
    share = N.modification_share(F.col("text"), F.col("final_text"))
    scored = join_unique(drafts, final, "ticket_id").select("ticket_id", "draft_no", share.alias("share"))
    return scored.select(
        "ticket_id", "draft_no", F.round("share", 6).alias("modification_share"),
        N.acceptance_band(F.col("share")).alias("band"),
    )
