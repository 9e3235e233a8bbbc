"""Registered queries: filters, joins, top-k, paging, set operations, ranking, scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import normalize as N
from ticketloom.functions import text as T
from ticketloom.functions import vectors as V
from ticketloom.operators import ranking as R
from ticketloom.operators import routing
from ticketloom.operators import relational as L
from ticketloom.plans import sql_parts as P
from ticketloom.plans.registry import query
from ticketloom.sources import standins as S

TICKET_COLUMNS = "ticket_id, customer_id, category, priority, status, created_at"


@query(
    "tickets_in_period", "A7",
    f"""WITH {P.TICKETS} SELECT ticket_id, category, priority, status, created_at FROM tickets
    WHERE created_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-12-31' ORDER BY created_at""",
)
def tickets_in_period(spark, folder):
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("2000-01-01 00:00:00", "2000-12-31 00:00:00"))
    mine = S.tickets(spark, folder).where(F.col("created_at").between(start, end))
    return mine.select("ticket_id", "category", "priority", "status", "created_at").orderBy("created_at", "ticket_id")


@query(
    "list_tickets_filtered", "C1 D1",
    f"""WITH {P.TICKETS} SELECT {TICKET_COLUMNS} FROM tickets WHERE category = 'BUILDING' AND priority = 'P1' AND status = 'open'""",
)
def list_tickets_filtered(spark, folder):
    mine = L.list_rows(S.tickets(spark, folder), category="BUILDING", priority="P1", status="open", customer_id=None)
    return mine.drop("raw_priority")


@query(
    "ticket_by_id", "C2",
    f"WITH {P.TICKETS} SELECT {TICKET_COLUMNS} FROM tickets WHERE ticket_id = 77",
)
def ticket_by_id(spark, folder):
    return L.list_rows(S.tickets(spark, folder), ticket_id=77).drop("raw_priority")


@query(
    "published_and_resolved_filters", "C3",
    f"""WITH {P.ARTICLES}, {P.TEXT_TICKETS}
    SELECT a.category, count(*) AS n FROM articles a WHERE a.status = 'published' GROUP BY a.category
    UNION ALL SELECT 'tickets ' || status, count(*) FROM text_tickets WHERE status IN ('resolved', 'closed') GROUP BY status""",
)
def published_and_resolved_filters(spark, folder):
    n = F.count(F.lit(1)).alias("n")
    published = S.articles(spark, folder).where(F.col("status") == "published").groupBy("category").agg(n)
    resolved = S.text_tickets(spark, folder).where(F.col("status").isin(*vocab.RESOLVED_STATUSES))
    by_status = resolved.groupBy(F.concat(F.lit("tickets "), "status").alias("category")).agg(n)
    return published.unionByName(by_status)


@query(
    "observed_or_predicted_label", "C6",
    f"""WITH {P.TICKETS} SELECT label, count(*) AS n FROM (
      SELECT coalesce(CASE WHEN status = 'open' THEN NULL ELSE category END, CASE WHEN priority = 'P1' THEN NULL ELSE priority END) AS label
      FROM tickets) WHERE label IS NOT NULL GROUP BY label""",
)
def observed_or_predicted_label(spark, folder):
    mine = S.tickets(spark, folder).select(
        F.when(F.col("status") != "open", F.col("category")).alias("observed"),
        F.when(F.col("priority") != "P1", F.col("priority")).alias("predicted"),
    )
    return L.observed_label(mine, "observed", "predicted", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "chunk_source_join", "A8 D1 S16 C3",
    """WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
    SELECT c.conv_id AS article_id, c.turn AS chunk_index, split_part(d.text, chr(10), 1) || chr(10) || chr(10) || c.text AS embed_text
    FROM c JOIN documents d ON d.doc_id = c.conv_id WHERE d.lang <> 'es'""",
)
def chunk_source_join(spark, folder):
    turns = S.drafts(spark, folder).select(
        F.col("ticket_id").alias("article_id"), F.col("draft_no").alias("chunk_index"), "draft_text"
    )
    published = S.articles(spark, folder).where(F.col("status") == "published").select("article_id", "title")
    return turns.join(published, "article_id").select(
        "article_id", "chunk_index", T.embed_text(F.col("title"), F.col("draft_text")).alias("embed_text")
    )


@query(
    "tickets_with_latest_draft", "D2 F2",
    f"""WITH {P.DRAFTS}, p AS (SELECT DISTINCT conv_id AS ticket_id FROM conversations),
    d AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY draft_no DESC) AS i FROM drafts)
    SELECT p.ticket_id, d.draft_no, d.draft_text FROM p LEFT JOIN d ON d.ticket_id = p.ticket_id AND d.i = 1""",
)
def tickets_with_latest_draft(spark, folder):
    parents = S.table(spark, folder, "conversations").select(F.col("conv_id").alias("ticket_id")).distinct()
    return L.with_latest(parents, S.drafts(spark, folder), "ticket_id", "draft_no", ["draft_no", "draft_text"])


@query(
    "latest_log_per_user", "F2",
    f"""WITH {P.LOGS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_user ORDER BY created_at DESC, log_id DESC) AS i FROM logs)
    SELECT session_user, log_id, endpoint, latency_ms FROM r WHERE i = 1""",
)
def latest_log_per_user(spark, folder):
    latest = R.latest_per_key(S.request_logs(spark, folder), "session_user", F.col("created_at"), F.col("log_id"))
    return latest.select("session_user", "log_id", "endpoint", "latency_ms")


@query(
    "tickets_with_all_drafts", "D3",
    f"""WITH {P.DRAFTS}, p AS (SELECT DISTINCT conv_id AS ticket_id FROM conversations)
    SELECT p.ticket_id, d.draft_no, d.draft_text FROM p LEFT JOIN drafts d ON d.ticket_id = p.ticket_id
    ORDER BY p.ticket_id, d.draft_no DESC""",
)
def tickets_with_all_drafts(spark, folder):
    parents = S.table(spark, folder, "conversations").select(F.col("conv_id").alias("ticket_id")).distinct()
    return L.with_children(parents, S.drafts(spark, folder), "ticket_id").orderBy("ticket_id", F.col("draft_no").desc())


@query(
    "drafts_of_known_tickets", "D4 B5",
    f"""WITH {P.DRAFTS} SELECT ticket_id, draft_no FROM drafts WHERE ticket_id IN (SELECT doc_id FROM labels)""",
)
def drafts_of_known_tickets(spark, folder):
    known = S.table(spark, folder, "labels").select(F.col("doc_id").alias("ticket_id"))
    return S.drafts(spark, folder).select("ticket_id", "draft_no").join(known, "ticket_id", "left_semi")


@query(
    "unlabelled_documents", "D5",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unlabelled_documents(spark, folder):
    documents = S.table(spark, folder, "documents").select("doc_id", "lang")
    return documents.join(S.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "lookup_with_default", "D9 S21",
    """SELECT lang, source, CASE lang WHEN 'en' THEN 'desk-en' WHEN 'de' THEN 'desk-de' ELSE 'desk-any' END AS queue, count(*) AS n
    FROM documents GROUP BY ALL""",
)
def lookup_with_default(spark, folder):
    queue = N.lookup(F.col("lang"), {"en": "desk-en", "de": "desk-de"}, "desk-any")
    documents = S.table(spark, folder, "documents")
    return documents.groupBy("lang", "source", queue.alias("queue")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "top_tickets_by_amount", "G1",
    "SELECT o_orderkey AS ticket_id, o_totalprice AS score FROM orders ORDER BY score DESC, ticket_id LIMIT 10",
)
def top_tickets_by_amount(spark, folder):
    orders = S.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("ticket_id"), F.col("o_totalprice").alias("score")
    )
    return L.top_k(orders, 10, "score", "ticket_id")


@query(
    "ticket_page", "G2",
    f"""WITH {P.TICKETS} SELECT ticket_id, category, priority, created_at FROM tickets WHERE priority = 'P2'
    ORDER BY created_at DESC, ticket_id LIMIT 20 OFFSET 40""",
)
def ticket_page(spark, folder):
    mine = L.list_rows(S.tickets(spark, folder), priority="P2").select("ticket_id", "category", "priority", "created_at")
    return L.page(mine, 3, 20, "created_at", "ticket_id")


@query(
    "ticket_page_after", "G2",
    f"""WITH {P.TICKETS} SELECT ticket_id, category, priority, created_at FROM tickets WHERE priority = 'P2'
    AND created_at <= TIMESTAMP '1998-01-01' AND NOT (created_at = TIMESTAMP '1998-01-01' AND ticket_id <= 1000)
    ORDER BY created_at DESC, ticket_id LIMIT 20""",
)
def ticket_page_after(spark, folder):
    """The page that follows ticket 1000 of the first day of 1998."""
    mine = L.list_rows(S.tickets(spark, folder), priority="P2").select("ticket_id", "category", "priority", "created_at")
    day = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return L.page_after(mine, day, F.lit(1000), 20, "created_at", "ticket_id")


@query(
    "repeatable_sample", "G3",
    f"""WITH {P.TICKETS} SELECT ticket_id, category FROM tickets ORDER BY md5(CAST(ticket_id AS VARCHAR) || '-42'), ticket_id LIMIT 100""",
)
def repeatable_sample(spark, folder):
    return L.sample_rows(S.tickets(spark, folder).select("ticket_id", "category"), 100, "ticket_id", 42)


@query(
    "recent_tickets_preview", "G6",
    f"WITH {P.TICKETS} SELECT ticket_id, status, created_at FROM tickets ORDER BY created_at DESC, ticket_id LIMIT 10",
)
def recent_tickets_preview(spark, folder):
    return L.page(S.tickets(spark, folder).select("ticket_id", "status", "created_at"), 1, 10, "created_at", "ticket_id")


@query(
    "sorted_count_entries", "G5 E5",
    f"""WITH {P.TICKETS}, c AS (SELECT category, count(*) AS n FROM tickets GROUP BY 1)
    SELECT string_agg(category, '>' ORDER BY n DESC, category) AS ranking FROM c""",
)
def sorted_count_entries(spark, folder):
    one = L.count_map(S.tickets(spark, folder), "category", "m")
    names = F.transform(L.sorted_entries(F.col("m")), lambda e: e["key"])
    return one.select(F.array_join(names, ">").alias("ranking"))


@query(
    "tagged_union_counts", "H1",
    f"""WITH {P.ARTICLES}, {P.TEXT_TICKETS}
    SELECT 'kb' AS source_type, category, count(*) AS n FROM articles WHERE status = 'published' GROUP BY category
    UNION ALL SELECT 'ticket', category, count(*) FROM text_tickets WHERE status IN ('resolved', 'closed') GROUP BY category""",
)
def tagged_union_counts(spark, folder):
    kb = S.articles(spark, folder).where(F.col("status") == "published").select("category")
    ticket = S.text_tickets(spark, folder).where(F.col("status").isin(*vocab.RESOLVED_STATUSES)).select("category")
    both = L.tagged_union(kb=kb, ticket=ticket)
    return both.groupBy("source_type", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_set_union", "H3",
    """SELECT DISTINCT label FROM (SELECT lang AS label FROM documents UNION ALL SELECT source FROM documents) ORDER BY label""",
)
def label_set_union(spark, folder):
    return L.label_union(S.table(spark, folder, "documents"), "lang", "source")


@query(
    "categories_without_labels", "H4",
    """SELECT DISTINCT source FROM documents EXCEPT
    SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND lang = 'fr'""",
)
def categories_without_labels(spark, folder):
    documents = S.table(spark, folder, "documents").select("doc_id", "source", "lang")
    bad = S.table(spark, folder, "labels").where(F.col("quality") == 0).select("doc_id")
    found = documents.where(F.col("lang") == "fr").join(bad, "doc_id")
    return L.missing_values(documents, found, "source")


@query(
    "first_tickets_per_category", "F6",
    f"""WITH {P.TICKETS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY created_at, ticket_id) AS i FROM tickets)
    SELECT category, ticket_id, created_at FROM r WHERE i <= 3""",
)
def first_tickets_per_category(spark, folder):
    mine = S.tickets(spark, folder).select("category", "ticket_id", "created_at")
    return R.sample_per_group(mine, "category", 3, F.col("created_at"), F.col("ticket_id"))


@query(
    "stratified_split", "F7",
    f"""WITH {P.TICKETS}, r AS (
      SELECT ticket_id, category, row_number() OVER (PARTITION BY category ORDER BY md5(CAST(ticket_id AS VARCHAR) || '-42'), ticket_id) AS i,
             count(*) OVER (PARTITION BY category) AS n FROM tickets)
    SELECT ticket_id, category, CASE WHEN i <= n - (n * 20 + 99) // 100 THEN 'train' ELSE 'test' END AS split FROM r""",
)
def stratified_split(spark, folder):
    return R.stratified_split(S.tickets(spark, folder).select("ticket_id", "category"), "category", "ticket_id")


@query(
    "normalized_priorities", "S3",
    f"""SELECT o_orderpriority AS raw, {P.PRIORITY_OF_ORDER} AS priority, 'P3' AS compat_priority, count(*) AS n FROM orders GROUP BY ALL""",
)
def normalized_priorities(spark, folder):
    raw = F.col("o_orderpriority")
    return S.table(spark, folder, "orders").groupBy(
        raw.alias("raw"),
        N.normalize_priority(raw).alias("priority"),
        N.normalize_priority(raw, compat=True).alias("compat_priority"),
    ).agg(F.count(F.lit(1)).alias("n"))


_ALIAS_INPUT = {"AUTOMOBILE": " Bug ", "BUILDING": "REFUND", "FURNITURE": "login", "MACHINERY": "", "HOUSEHOLD": "home goods"}


@query(
    "normalized_categories", "S2",
    f"""WITH c AS (SELECT {P.case("c_mktsegment", _ALIAS_INPUT)} AS raw FROM customer)
    SELECT raw, CASE WHEN raw = '' THEN NULL WHEN raw = 'home goods' THEN 'Home Goods' ELSE {P.case("lower(trim(raw))", vocab.CATEGORY_ALIASES)} END AS category,
    count(*) AS n FROM c GROUP BY ALL""",
)
def normalized_categories(spark, folder):
    raw = N.lookup(F.col("c_mktsegment"), _ALIAS_INPUT)
    customers = S.table(spark, folder, "customer").select(raw.alias("raw"))
    return customers.groupBy("raw", N.normalize_category(F.col("raw")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "priority_prefixes", "S4",
    f"""SELECT raw, CASE WHEN raw IS NULL THEN 'P3' ELSE split_part(raw, '-', 1) END AS prefix, count(*) AS n FROM (
      SELECT CASE WHEN left(o_orderpriority, 1) = '5' THEN NULL ELSE 'P' || o_orderpriority END AS raw FROM orders) GROUP BY ALL""",
)
def priority_prefixes(spark, folder):
    raw = F.when(~F.col("o_orderpriority").startswith("5"), F.concat(F.lit("P"), "o_orderpriority"))
    orders = S.table(spark, folder, "orders").select(raw.alias("raw"))
    return orders.groupBy("raw", N.priority_prefix(F.col("raw")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "article_identifiers", "S5",
    "SELECT page_id, left(md5(split_part(url, '/', 3)), 16) AS article_id FROM pages",
)
def article_identifiers(spark, folder):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return S.table(spark, folder, "pages").select("page_id", N.article_id(host).alias("article_id"))


@query(
    "vector_point_ids", "S17 B9",
    """WITH h AS (SELECT vec_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(vec_id::VARCHAR)) AS h FROM embeddings)
    SELECT vec_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      substr('89ab', 1 + ('0x' || substr(h, 17, 1))::INTEGER % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
)
def vector_point_ids(spark, folder):
    return S.vectors(spark, folder).select("vec_id", V.point_id(F.col("vec_id").cast("string")).alias("point_id"))


@query(
    "vector_norms", "S18 S19",
    """SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, 1.0::DOUBLE AS unit_norm
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings)""",
)
def vector_norms(spark, folder):
    tripled = S.vectors(spark, folder).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    unit = tripled.withColumn("u", V.l2_normalize(F.col("e")))
    return unit.select("vec_id", F.round(V.l2_norm(F.col("e")), 6).alias("norm"), F.round(V.l2_norm(F.col("u")), 6).alias("unit_norm"))


@query(
    "sla_risk_and_queue", "S20 S21 S22 K6",
    f"""WITH {P.TICKETS}, c AS (SELECT ticket_id, priority, CASE WHEN status = 'open' THEN 0.5 WHEN status = 'pending' THEN 0.7 ELSE NULL END AS confidence,
      CASE category WHEN 'BUILDING' THEN 'Billing' WHEN 'MACHINERY' THEN 'Technical' ELSE category END AS category FROM tickets)
    SELECT ticket_id, CASE WHEN confidence IS NULL THEN 'General' ELSE category END AS category,
      CASE WHEN confidence IS NULL THEN 'P3' ELSE priority END AS priority, coalesce(CAST(confidence AS DOUBLE), 0.5::DOUBLE) AS confidence,
      coalesce(priority IN ('P1', 'P2') AND confidence > 0.6, false) AS sla_risk,
      CASE WHEN confidence IS NULL THEN 'general-support' ELSE {P.case("category", vocab.QUEUES, "'general-support'")} END AS suggested_queue
    FROM c""",
)
def sla_risk_and_queue(spark, folder):
    from ticketloom.operators import routing

    tickets = S.tickets(spark, folder)
    segment = N.lookup(F.col("category"), {"BUILDING": "Billing", "MACHINERY": "Technical"})
    scored = tickets.where(F.col("status") != "resolved").select(
        "ticket_id",
        F.coalesce(segment, "category").alias("predicted_category"),
        F.col("priority").alias("predicted_priority"),
        F.when(F.col("status") == "open", 0.5).otherwise(0.7).alias("category_confidence"),
        F.when(F.col("status") == "open", 0.5).otherwise(0.7).alias("priority_confidence"),
    )
    out = routing.triage_table(tickets.select("ticket_id"), scored, "ticket_id")
    return out.select(
        "ticket_id", F.col("predicted_category").alias("category"), F.col("predicted_priority").alias("priority"),
        F.col("category_confidence").alias("confidence"), "sla_risk", "suggested_queue",
    )


@query(
    "draft_previews", "S15",
    f"""WITH {P.DRAFTS} SELECT ticket_id, draft_no, CASE WHEN length(draft_text) > 300 THEN left(draft_text, 300) || '...' ELSE draft_text END AS preview,
    left(draft_text, 500) AS excerpt FROM drafts""",
)
def draft_previews(spark, folder):
    return S.drafts(spark, folder).select(
        "ticket_id", "draft_no", N.preview(F.col("draft_text")).alias("preview"), F.substring("draft_text", 1, 500).alias("excerpt")
    )
