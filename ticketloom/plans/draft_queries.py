"""Registered queries: contexts, citations, prompts, response parsing, confidence, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import text as T
from ticketloom.operators import drafts as D
from ticketloom.operators import posting_index
from ticketloom.operators.topk import attach
from ticketloom.plans import indexes
from ticketloom.plans import sql_parts as P
from ticketloom.plans.registry import query
from ticketloom.plans.retrieval_queries import ARTICLE_PARTS, TICKET_PARTS, cover_sql
from ticketloom.sources import standins as S

# Tickets to answer: the passages. Their hits must score above the limit, so that some tickets have none.
LIMIT = 0.97

HITS_SQL = f"""{P.ARTICLES}, {P.TEXT_TICKETS}, pub AS (SELECT * FROM articles WHERE status = 'published'),
    done AS (SELECT * FROM text_tickets WHERE status IN ('resolved', 'closed')),
    a AS (WITH {cover_sql(ARTICLE_PARTS, "article_id", 5)} SELECT * FROM hits WHERE score > {LIMIT}),
    t AS (WITH {cover_sql(TICKET_PARTS, "ticket_id", 3, "WHERE query_id <> doc_id")} SELECT * FROM hits WHERE score > {LIMIT}),
    kb AS (SELECT query_id AS ticket_id, doc_id, title, content, score, rank FROM a JOIN pub ON article_id = doc_id),
    past AS (SELECT query_id AS ticket_id, doc_id, subject AS title, 'Subject: ' || subject || chr(10) || chr(10) || body AS content, score, rank
      FROM t JOIN text_tickets x ON x.ticket_id = doc_id)"""


def kb_hits(spark, folder):
    articles = S.articles(spark, folder)
    hits = posting_index.search_articles(indexes.articles(spark, folder), S.passages(spark, folder), 5, min_score=LIMIT)
    texts = articles.select(F.col("article_id").alias("doc_id"), "title", "content")
    return attach(hits.withColumnRenamed("query_id", "ticket_id"), texts, "doc_id", S.passages(spark, folder), 5)


def past_hits(spark, folder):
    tickets = S.text_tickets(spark, folder)
    hits = posting_index.search_tickets(indexes.tickets(spark, folder), S.passages(spark, folder), 3, min_score=LIMIT)
    content = F.concat(F.lit("Subject: "), "subject", F.lit("\n\n"), "body")
    texts = tickets.select(F.col("ticket_id").alias("doc_id"), F.col("subject").alias("title"), content.alias("content"))
    return attach(hits.withColumnRenamed("query_id", "ticket_id"), texts, "doc_id", S.passages(spark, folder), 5)


def asked_tickets(spark, folder):
    return S.passages(spark, folder).select(
        F.col("query_id").alias("ticket_id"),
        T.first_line(F.col("query_text")).alias("subject"),
        F.col("query_text").alias("body"),
        F.lit("Technical").alias("category"),
        F.lit(None).cast("string").alias("priority"),
    )


def prompted(spark, folder):
    kb = D.contexts(kb_hits(spark, folder), "kb", D.MAX_ARTICLES, "kb")
    past = D.contexts(past_hits(spark, folder), "ticket", D.MAX_TICKETS, "ticket")
    return D.prompts(asked_tickets(spark, folder), kb, past)


CONTEXT_SQL = f"""{HITS_SQL},
    kc AS (SELECT ticket_id, string_agg('[KB-' || rank || '] **' || title || '**' || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS kb_context, avg(score) AS kb_score FROM kb GROUP BY 1),
    tc AS (SELECT ticket_id, string_agg('[TICKET-' || rank || '] **' || title || '**' || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS ticket_context FROM past GROUP BY 1)"""


@query("article_contexts", "L1", f"WITH {CONTEXT_SQL} SELECT ticket_id, kb_context, round(kb_score, 6) AS kb_score FROM kc")
def article_contexts(spark, folder):
    kb = D.contexts(kb_hits(spark, folder), "kb", D.MAX_ARTICLES, "kb")
    return kb.select("ticket_id", "kb_context", F.round("kb_score", 6).alias("kb_score"))


@query(
    "citations", "L2 H5",
    f"""WITH {HITS_SQL} SELECT ticket_id, 'KB-' || rank AS id, 'kb' AS source_type, doc_id::VARCHAR AS source_id, title, left(content, 500) AS excerpt, score AS confidence FROM kb
    UNION ALL SELECT ticket_id, 'TICKET-' || rank, 'ticket', doc_id::VARCHAR, title, left(content, 500), score FROM past""",
)
def citations(spark, folder):
    return prompted(spark, folder).select("ticket_id", F.inline("citations"))


PROMPT = f"""'{D.INSTRUCTIONS}' || chr(10) || chr(10) || 'Subject: ' || split_part(text, chr(10), 1) || chr(10) || chr(10) || 'Category: Technical' || chr(10) || chr(10) ||
    'Message:' || chr(10) || text || chr(10) || chr(10) || 'Articles:' || chr(10) || coalesce(kb_context, '{D.NO_ARTICLES}') || chr(10) || chr(10) ||
    'Tickets:' || chr(10) || coalesce(ticket_context, '{D.NO_TICKETS}')"""


@query(
    "prompts", "L3 L4",
    f"""WITH {CONTEXT_SQL} SELECT item_id AS ticket_id, kb_context IS NOT NULL OR ticket_context IS NOT NULL AS has_context,
    CASE WHEN kb_context IS NOT NULL OR ticket_context IS NOT NULL THEN {PROMPT} END AS prompt
    FROM benchmark LEFT JOIN kc ON kc.ticket_id = item_id LEFT JOIN tc ON tc.ticket_id = item_id""",
)
def prompts(spark, folder):
    return prompted(spark, folder).select("ticket_id", "has_context", "prompt")


def raw_answers(df):
    """Answers in the four shapes, by turn number: plain JSON, fenced JSON, a flat object inside prose, prose."""
    no, text = F.col("draft_no"), F.col("draft_text")
    flat_text = F.regexp_replace(text, r'["\\{}\n]', " ")
    return (
        F.when(no == 1, F.to_json(F.struct(text.alias("draft"), F.lit("high").alias("confidence"), F.array(F.lit("a"), F.lit("b")).alias("follow_up_questions"))))
        .when(no == 2, F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(text.alias("draft"), F.lit("because").alias("rationale"))), F.lit("\n```\n")))
        .when(no == 3, F.concat(F.lit('Well, {"draft": "'), flat_text, F.lit('", "confidence": "low"} so far')))
        .otherwise(text)
    )


@query(
    "parsed_answers", "L6",
    f"""WITH {P.DRAFTS} SELECT ticket_id, draft_no,
      CASE WHEN draft_no = 3 THEN regexp_replace(draft_text, '["\\\\{{}}\\n]', ' ', 'g') ELSE draft_text END AS draft,
      CASE draft_no WHEN 1 THEN '' WHEN 2 THEN 'because' WHEN 3 THEN '' ELSE 'answer was not structured' END AS rationale,
      CASE draft_no WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence,
      CASE draft_no WHEN 1 THEN 'a|b' WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'Please check this reply' END AS questions FROM drafts""",
)
def parsed_answers(spark, folder):
    drafts = S.drafts(spark, folder)
    parsed = drafts.select("ticket_id", "draft_no", D.parse_response(raw_answers(drafts)).alias("p"))
    return parsed.select(
        "ticket_id", "draft_no", "p.draft", "p.rationale", "p.confidence", F.array_join("p.follow_up_questions", "|").alias("questions")
    )


# Answers to the prompted tickets, by the number of context citations: some cite, some fail.
@query(
    "finished_drafts", "L4 L5 L7 L8",
    f"""WITH {CONTEXT_SQL}, n AS (SELECT item_id AS ticket_id, text, kb_score, coalesce(k.n, 0) AS nk, coalesce(p.n, 0) AS np
      FROM benchmark LEFT JOIN kc ON kc.ticket_id = item_id LEFT JOIN (SELECT ticket_id, count(*) AS n FROM kb GROUP BY 1) k ON k.ticket_id = item_id
      LEFT JOIN (SELECT ticket_id, count(*) AS n FROM past GROUP BY 1) p ON p.ticket_id = item_id),
    o AS (SELECT *, CASE WHEN nk + np = 0 THEN 'no_context' WHEN length(text) > 260 THEN 'error' ELSE 'generated' END AS outcome,
      (CASE WHEN nk >= 1 THEN 1 ELSE 0 END) + (CASE WHEN np >= 2 THEN 1 ELSE 0 END) AS used FROM n)
    SELECT ticket_id, outcome, CASE outcome WHEN 'no_context' THEN '{D.NO_CONTEXT_REPLY}' WHEN 'error' THEN 'No draft was generated: timeout' ELSE 'See [KB-1], TICKET-2. ' || text END AS draft_text,
      CASE WHEN outcome = 'generated' THEN 'high' ELSE 'low' END AS confidence,
      round(CASE outcome WHEN 'no_context' THEN 0.1 WHEN 'error' THEN 0.0 ELSE
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.85::DOUBLE + coalesce(least(kb_score, 1.0) * 0.1, -0.1) + least(used * 0.05, 0.15))) END::DOUBLE, 6) AS confidence_score,
      CASE WHEN outcome = 'generated' THEN concat_ws(',', CASE WHEN nk >= 1 THEN 'KB-1' END, CASE WHEN np >= 2 THEN 'TICKET-2' END) ELSE '' END AS used
    FROM o""",
)
def finished_drafts(spark, folder):
    ready = prompted(spark, folder)
    failed = F.length("query_text") > 260
    answer = F.to_json(
        F.struct(F.concat(F.lit("See [KB-1], TICKET-2. "), "query_text").alias("draft"), F.lit("high").alias("confidence"))
    )
    responses = S.passages(spark, folder).select(
        F.col("query_id").alias("ticket_id"),
        F.when(~failed, answer).alias("content"),
        F.when(failed, "timeout").alias("error"),
    )
    out = D.finished_drafts(ready, responses)
    return out.select(
        "ticket_id", "outcome", "draft_text", "confidence", F.round("confidence_score", 6).alias("confidence_score"),
        F.array_join(F.transform("citations", lambda c: c["id"]), ",").alias("used"),
    )


@query(
    "template_replies", "L9",
    f"""SELECT c_custkey AS ticket_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Billing' WHEN 'MACHINERY' THEN 'Technical' ELSE 'Other' END AS category,
    {P.case("CASE c_mktsegment WHEN 'BUILDING' THEN 'Billing' WHEN 'MACHINERY' THEN 'Technical' ELSE 'Other' END", {k: v for k, v in vocab.REPLY_TEMPLATES.items() if k != "default"}, "'" + vocab.REPLY_TEMPLATES["default"].replace("'", "''") + "'")} AS reply FROM customer""",
)
def template_replies(spark, folder):
    category = F.when(F.col("c_mktsegment") == "BUILDING", "Billing").when(F.col("c_mktsegment") == "MACHINERY", "Technical")
    customers = S.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ticket_id"), category.otherwise("Other").alias("category")
    )
    return D.template_replies(customers)


@query(
    "retrieval_log", "L11",
    f"""WITH {HITS_SQL} SELECT ticket_id, 'kb' AS source_type, doc_id::VARCHAR AS source_id, score, rank, 'fts_cover_rank' AS method FROM kb
    UNION ALL SELECT ticket_id, 'ticket', doc_id::VARCHAR, score, rank, 'fts_cover_rank' FROM past""",
)
def retrieval_log(spark, folder):
    kb = D.retrieval_log(kb_hits(spark, folder), "kb", "fts_cover_rank")
    return kb.unionByName(D.retrieval_log(past_hits(spark, folder), "ticket", "fts_cover_rank"))
