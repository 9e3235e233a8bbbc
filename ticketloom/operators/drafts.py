"""Draft assembly: contexts, citations, prompts, response parsing and confidence, for whole tables of tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import normalize as N

#: Hits per ticket that enter the prompt, excerpt length, score without context.
MAX_ARTICLES = 5
MAX_TICKETS = 3
EXCERPT = 500
NO_CONTEXT_SCORE = 0.1

NO_ARTICLES = "The knowledge base holds nothing on this."
NO_TICKETS = "No resolved ticket resembles this one."
NO_CONTEXT_REPLY = (
    "We are sorry: nothing we have on file answers this question yet. A specialist will take over and write to you."
)
INSTRUCTIONS = (
    "Write a reply to the customer below. Rely on the numbered sources only and name each one you use in square "
    'brackets. Answer with one JSON object with the keys "draft", "rationale", "confidence" (high, medium or low) '
    'and "follow_up_questions".'
)

CITATION = "struct<id:string,source_type:string,source_id:string,title:string,excerpt:string,confidence:double>"
PARSED = "struct<draft:string,rationale:string,confidence:string,follow_up_questions:array<string>>"

#: The patterns decide which answers are accepted.
FLAT_OBJECT = r'(\{[^{}]*"draft"[^{}]*\})'
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def contexts(hits: DataFrame, source_type: str, limit: int, name: str) -> DataFrame:
    """(ticket_id, <name>_context, <name>_citations, <name>_score) from hits (ticket_id, doc_id, title, content, score,
    rank). Only the first ``limit`` hits of a ticket are gathered, in rank order."""
    prefix = "KB-" if source_type == "kb" else "TICKET-"
    label = F.concat(F.lit(prefix), F.col("rank").cast("string"))
    block = F.concat(F.lit("["), label, F.lit("] **"), F.coalesce("title", F.lit("Untitled")), F.lit("**\n"), F.col("content"), F.lit("\n"))
    citation = F.struct(
        label.alias("id"),
        F.lit(source_type).alias("source_type"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.col("title"),
        F.substring("content", 1, EXCERPT).alias("excerpt"),
        F.col("score").alias("confidence"),
    )
    gathered = (
        hits.where(F.col("rank") <= limit)
        .groupBy("ticket_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), citation.alias("citation")))).alias("_g"),
            F.avg("score").alias(f"{name}_score"),
        )
    )
    return gathered.select(
        "ticket_id",
        F.array_join(F.transform("_g", lambda g: g["block"]), "\n").alias(f"{name}_context"),
        F.transform("_g", lambda g: g["citation"]).alias(f"{name}_citations"),
        f"{name}_score",
    )


def prompts(tickets: DataFrame, kb: DataFrame, past: DataFrame) -> DataFrame:
    """Tickets (ticket_id, subject, body, category, priority) with contexts, citations (articles, then tickets),
    the prompt, and ``has_context``. Without any hit the prompt is NULL: such a ticket goes to a specialist."""
    joined = tickets.join(kb, "ticket_id", "left").join(past, "ticket_id", "left")
    empty = F.array().cast(f"array<{CITATION}>")
    citations = F.concat(F.coalesce("kb_citations", empty), F.coalesce("ticket_citations", empty))
    joined = joined.withColumn("citations", citations).withColumn("has_context", F.size("citations") > 0)
    text = F.concat_ws(
        "\n\n",
        F.lit(INSTRUCTIONS),
        F.concat(F.lit("Subject: "), F.col("subject")),
        F.concat(F.lit("Category: "), F.col("category")),
        F.concat(F.lit("Priority: "), F.col("priority")),
        F.concat(F.lit("Message:\n"), F.col("body")),
        F.concat(F.lit("Articles:\n"), F.coalesce("kb_context", F.lit(NO_ARTICLES))),
        F.concat(F.lit("Tickets:\n"), F.coalesce("ticket_context", F.lit(NO_TICKETS))),
    )
    return joined.withColumn("prompt", F.when(F.col("has_context"), text))


def parse_response(content: Column) -> Column:
    """The structured answer, read in this order: the text is a JSON object; a JSON object in a code fence; a flat
    object that holds ``"draft"``; else the whole text becomes the draft at low confidence."""
    flat = F.regexp_extract(content, FLAT_OBJECT, 1)
    fenced = F.regexp_extract(content, FENCED_OBJECT, 1)
    parsed = F.coalesce(_object(content), _object(fenced), _object(flat))
    unread = F.struct(
        content.alias("draft"),
        F.lit("answer was not structured").alias("rationale"),
        F.lit("low").alias("confidence"),
        F.array(F.lit("Please check this reply")).alias("follow_up_questions"),
    )
    read = F.struct(
        F.coalesce(F.try_variant_get(parsed, "$.draft", "string"), content).alias("draft"),
        F.coalesce(F.try_variant_get(parsed, "$.rationale", "string"), F.lit("")).alias("rationale"),
        F.coalesce(F.try_variant_get(parsed, "$.confidence", "string"), F.lit("medium")).alias("confidence"),
        F.coalesce(
            F.try_variant_get(parsed, "$.follow_up_questions", "array<string>"), F.array().cast("array<string>")
        ).alias("follow_up_questions"),
    )
    return F.when(parsed.isNull(), unread).otherwise(read)


def _object(text: Column) -> Column:
    """The text as a variant when it is one JSON object, else NULL."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def used_citations(draft: Column, citations: Column, compat: bool = False) -> Column:
    """Citations whose id occurs in the draft as a whole; ``compat`` takes any substring, so KB-1 matches KB-10."""
    if compat:
        return F.filter(citations, lambda c: F.contains(draft, c["id"]))
    return F.filter(citations, lambda c: F.rlike(draft, F.concat(F.lit("(^|[^A-Z0-9-])"), c["id"], F.lit("([^0-9]|$)"))))


def confidence_score(level: Column, n_used: Column, mean_score: Column) -> Column:
    """Base by level, plus a tenth of the mean retrieval score (minus 0.1 without hits), plus 0.05 per used citation up
    to 0.15; limited to 0..1."""
    base = N.lookup(F.lower(level), vocab.BASE_CONFIDENCE, vocab.DEFAULT_BASE_CONFIDENCE)
    retrieval = F.when(mean_score.isNull(), F.lit(-0.1)).otherwise(F.least(mean_score, F.lit(1.0)) * 0.1)
    citation = F.least(n_used * 0.05, F.lit(0.15))
    return F.least(F.greatest(base + retrieval + citation, F.lit(0.0)), F.lit(1.0))


def finished_drafts(prompted: DataFrame, responses: DataFrame) -> DataFrame:
    """Drafts from prompts and raw responses (ticket_id, content, error).

    Without context: the fixed reply, low, 0.1. With an error: the error text, low, 0.0. Else the parsed answer with
    the citations it uses and its score.
    """
    joined = prompted.join(responses, "ticket_id", "left").withColumn("_p", parse_response(F.col("content")))
    joined = joined.withColumn("_used", used_citations(F.col("_p.draft"), F.col("citations")))
    score = confidence_score(F.col("_p.confidence"), F.size("_used"), F.col("kb_score"))
    bare, failed = ~F.col("has_context"), F.col("error").isNotNull()
    none = F.array().cast(f"array<{CITATION}>")
    return joined.select(
        "ticket_id",
        F.when(bare, F.lit(NO_CONTEXT_REPLY))
        .when(failed, F.concat(F.lit("No draft was generated: "), "error"))
        .otherwise(F.col("_p.draft"))
        .alias("draft_text"),
        F.when(bare | failed, F.lit("low")).otherwise(F.col("_p.confidence")).alias("confidence"),
        F.when(bare, F.lit(NO_CONTEXT_SCORE)).when(failed, F.lit(0.0)).otherwise(score).alias("confidence_score"),
        F.when(bare | failed, none).otherwise(F.col("_used")).alias("citations"),
        F.when(bare, F.lit("no_context")).when(failed, F.lit("error")).otherwise("generated").alias("outcome"),
    )


def template_replies(tickets: DataFrame, category: str = "category") -> DataFrame:
    """The fixed reply text of the ticket's category, else the default one."""
    texts = {k: v for k, v in vocab.REPLY_TEMPLATES.items() if k != "default"}
    return tickets.withColumn("reply", N.lookup(F.col(category), texts, vocab.REPLY_TEMPLATES["default"]))


def retrieval_log(hits: DataFrame, source_type: str, method: str) -> DataFrame:
    """(ticket_id, source_type, source_id, score, rank, method): what was shown to the writer."""
    return hits.select(
        "ticket_id",
        F.lit(source_type).alias("source_type"),
        F.col("doc_id").cast("string").alias("source_id"),
        "score",
        "rank",
        F.lit(method).alias("method"),
    )
