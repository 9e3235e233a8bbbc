"""Registered queries: file scans and sinks, over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketloom.functions import normalize as N
from ticketloom.functions import vectors as V
from ticketloom.operators import chunking
from ticketloom.plans import reports
from ticketloom.plans import sql_parts as P
from ticketloom.plans.analytics_queries import ROLLUP, daily_metrics_rollup
from ticketloom.plans.evaluation_queries import RELEVANT, RUN_SQL, full_run, relevance, rounded
from ticketloom.plans.registry import query
from ticketloom.plans.text_queries import CHUNKS
from ticketloom.session import scratch_path
from ticketloom.sources import readers, sinks, snapshots
from ticketloom.sources import standins as S


def ticket_file_rows(spark, folder):
    """Ticket records under alternate names, with an empty ``subject`` that must give way to ``title``."""
    return S.text_tickets(spark, folder).select(
        F.col("ticket_id").cast("string").alias("ticket_id"),
        F.lit("").alias("subject"),
        F.col("subject").alias("title"),
        F.col("body").alias("description"),
        F.lit(" Bug ").alias("type"),
        F.when(F.col("lang") == "en", "2-High").when(F.col("lang") == "de", "urgent").otherwise("P4").alias("severity"),
        F.col("category").alias("source"),
        F.col("status"),
    )


TICKET_FILE_SQL = f"""WITH {P.TEXT_TICKETS} SELECT ticket_id::VARCHAR AS external_id, trim(subject) AS subject, md5(trim(body)) AS body_hash, 'Technical' AS category,
    CASE lang WHEN 'en' THEN 'P2' WHEN 'de' THEN 'P1' ELSE 'P4' END AS priority, category AS channel, status
    FROM text_tickets WHERE trim(subject) <> '' OR trim(body) <> ''"""


def shown(tickets):
    return tickets.select(
        "external_id", "subject", F.md5("body").alias("body_hash"), "category", "priority", "channel", "status"
    )


@query("tickets_from_csv", "A1 A3 S1", TICKET_FILE_SQL)
def tickets_from_csv(spark, folder):
    path = scratch_path(spark, "tickets") + ".csv"
    writer = ticket_file_rows(spark, folder).write.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return shown(readers.read_tickets(spark, path))


@query("tickets_from_json_lines", "A2 A3 S1", TICKET_FILE_SQL)
def tickets_from_json_lines(spark, folder):
    path = scratch_path(spark, "tickets") + ".jsonl"
    broken = ticket_file_rows(spark, folder).select(F.to_json(F.struct("*")).alias("value"))
    broken.unionByName(spark.range(3).select(F.lit("{not json").alias("value"))).write.text(path)
    return shown(readers.read_tickets(spark, path))


@query("tickets_from_json_files", "A2 A3", TICKET_FILE_SQL)
def tickets_from_json_files(spark, folder):
    """Files holding many lines each, some broken, read whole and split by the reader."""
    path = scratch_path(spark, "tickets") + ".json"
    ticket_file_rows(spark, folder).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return shown(readers.read_tickets(spark, path))


@query(
    "tickets_from_mixed_json", "A2 A3 S1",
    f"""SELECT *, NULL::VARCHAR AS error FROM ({TICKET_FILE_SQL})
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'does not close'""",
)
def tickets_from_mixed_json(spark, folder):
    """Arrays over many lines, lines and single objects side by side, and a file that breaks off."""
    path = scratch_path(spark, "mixed-tickets")
    rows = ticket_file_rows(spark, folder).withColumn("kind", F.pmod(F.xxhash64("ticket_id"), F.lit(8)))
    ticket = [c for c in rows.columns if c != "kind"]
    shelf = F.pmod(F.xxhash64(F.lit("shelf"), "ticket_id"), F.lit(10_000)) % F.lit(20)
    arrays = rows.where("kind < 6").withColumn("shelf", F.floor(F.row_number().over(Window.partitionBy(shelf).orderBy("ticket_id")) / 100))
    # A file of an array holds at most 100 tickets.
    arrays = arrays.withColumn("part", shelf).groupBy("part", "shelf").agg(F.collect_list(F.struct(*ticket)).alias("tickets"))
    arrays = arrays.select("part", "shelf", F.to_json("tickets", {"pretty": "true"}).alias("value"))
    arrays.write.partitionBy("part", "shelf").option("lineSep", "\n").text(f"{path}.json/arrays")
    rows.where("kind = 6").select(F.to_json(F.struct(*ticket)).alias("value")).write.text(f"{path}.json/lines")
    objects = rows.where("kind = 7").select(F.to_json(F.struct(*ticket), {"pretty": "true"}).alias("value"))
    objects.write.text(f"{path}.json/objects")
    spark.range(1).select(F.lit('[{"id": "lost", "subject": "x"},\n{"id": ').alias("value")).coalesce(1).write.text(f"{path}.json/broken")
    tickets, errors = readers.scan_ticket_json(spark, f"{path}.json")
    return shown(tickets).unionByName(errors.select("error"), allowMissingColumns=True)


ARTICLE_TEXT = "'# Guide ' || item_id || chr(10) || chr(10) || text"


def plain_text_sql(expr: str) -> str:
    """The rules of ``markdown_to_text`` in SQL."""
    steps = [
        (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s{0,3}>\s?", ""), (r"(?m)^\s*(?:[-*+]|\d+\.)\s+", ""), (r"(?m)^```.*$", ""),
        (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\*\*|__|`", ""), (r"(?s)<[^>]*>", "\n"),
    ]
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return rf"regexp_replace(regexp_replace({expr}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(
    "articles_from_folder", "A4 S5 S6 S7 S9",
    f"""SELECT 'Guide ' || item_id AS title, 'shelf ' || item_id % 5 AS category, 'a|b' AS tags, {plain_text_sql(ARTICLE_TEXT)} AS content,
      left('Guide ' || item_id, 500) AS summary, NULL::VARCHAR AS error FROM benchmark
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'is not UTF-8'""",
)
def articles_from_folder(spark, folder):
    """One Markdown file per passage in nested folders, and one in another encoding. Spark's writers name the files."""
    path = scratch_path(spark, "kb")
    item = F.col("query_id").cast("string")
    shelf = (F.col("query_id") % 5).cast("string")
    text = F.concat(F.lit("---\ncategory: shelf "), shelf, F.lit("\ntags: [a, b]\n---\n# Guide "), item, F.lit("\n\n"), "query_text")
    files = S.passages(spark, folder).select(shelf.alias("shelf"), item.alias("article"), text.alias("text"))
    files.write.partitionBy("shelf", "article").text(f"{path}/guides")
    other = spark.range(1).select(F.lit("Schön").alias("text")).coalesce(1)
    other.write.option("extension", "txt").option("encoding", "ISO-8859-1").csv(f"{path}/guides/other")
    articles, errors = readers.scan_articles(spark, path, "*.txt")
    listed = articles.select("title", "category", F.array_join("tags", "|").alias("tags"), "content", "summary")
    return listed.unionByName(errors.select("error"), allowMissingColumns=True)


@query(
    "articles_from_markdown", "A4 S5 S6 S7 S9",
    """SELECT md5(item_id || '.md')[1:16] AS external_id, 'Guide ' || item_id AS title, 'guides' AS category, 'a|b' AS tags, NULL::VARCHAR AS author,
    left(regexp_replace('Guide ' || item_id, '\\s+$', ''), 500) AS summary FROM benchmark""",
)
def articles_from_markdown(spark, folder):
    text = F.concat(
        F.lit("---\ncategory: guides\ntags: [a, b]\n---\n# Guide "), F.col("query_id").cast("string"), F.lit("\n\n"), "query_text"
    )
    files = S.passages(spark, folder).select(
        text.alias("value"), F.concat(F.col("query_id").cast("string"), F.lit(".md")).alias("_name")
    )
    parsed = readers.parse_articles(files, "value", "_name")
    return parsed.select("external_id", "title", "category", F.array_join("tags", "|").alias("tags"), "author", "summary")


@query(
    "samples_from_json", "A5",
    "SELECT doc_id, lang AS category, CASE WHEN quality = 1 THEN 'P3-Medium' ELSE 'P2-High' END AS priority FROM documents JOIN labels USING (doc_id)",
)
def samples_from_json(spark, folder):
    """Sample documents with an array of samples each, one document per line."""
    rows = S.labelled_tickets(spark, folder).select(
        F.col("ticket_id").alias("doc_id"), "category", F.when(F.col("priority") == "P3", "P3-Medium").otherwise("P2-High").alias("priority")
    )
    path = scratch_path(spark, "samples")
    one = F.concat(F.lit('{"version": "1", "training_samples": ['), F.to_json(F.struct("*")), F.lit("]}"))
    rows.select(one.alias("value")).write.option("lineSep", "\n").text(path)
    return readers.read_samples(spark, path, "training_samples").select("doc_id", "category", "priority")


@query(
    "relevance_from_json", "A9 D7",
    f"WITH {RELEVANT} SELECT query_id::VARCHAR AS query, doc_id::VARCHAR AS doc_id FROM rel",
)
def relevance_from_json(spark, folder):
    """A relevance file written from the judgements, one query with its documents per line."""
    path = scratch_path(spark, "relevance")
    pairs = relevance(spark, folder).groupBy(F.col("query_id").cast("string").alias("query"))
    lines = pairs.agg(F.collect_list(F.col("doc_id").cast("string")).alias("relevant_docs"))
    lines.select(F.to_json(F.struct("query", "relevant_docs")).alias("value")).write.text(path)
    return readers.read_relevance(spark, path)


INSERT_SQL = f"""{P.LOGS}, stored AS (SELECT DISTINCT session_user AS k FROM logs WHERE endpoint = 'error' AND session_user IS NOT NULL),
    batch AS (SELECT CASE WHEN endpoint = 'view' THEN NULL ELSE session_user END AS k, log_id, endpoint FROM logs WHERE endpoint <> 'error'),
    fresh AS (SELECT * FROM batch WHERE k IS NULL UNION ALL
      (SELECT k, min(log_id) AS log_id, min_by(endpoint, log_id) AS endpoint FROM batch WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM stored) GROUP BY k))"""


def bucketed(stored, key):
    """The stored rows as a new table in buckets."""
    return snapshots.create(stored, scratch_path(stored.sparkSession, "table"), key, buckets=8)


def insert_parts(spark, folder):
    """Stored keys: users with an error; batch: the other log rows by user, where a view carries no key."""
    logs = S.request_logs(spark, folder)
    stored = logs.where(F.col("endpoint") == "error").select(F.col("session_user").alias("k")).distinct()
    key = F.when(F.col("endpoint") != "view", F.col("session_user"))
    batch = logs.where(F.col("endpoint") != "error").select(key.alias("k"), "log_id", "endpoint")
    return stored, batch


@query("insert_or_ignore", "B1 D5", f"WITH {INSERT_SQL} SELECT k, log_id, endpoint FROM fresh")
def insert_or_ignore(spark, folder):
    """The rows that an insert into a bucketed table adds."""
    stored, batch = insert_parts(spark, folder)
    table = bucketed(stored.select("k", F.lit(None).cast("bigint").alias("log_id"), F.lit(None).cast("string").alias("endpoint")), "k")
    after = snapshots.insert_new(table, batch, F.col("log_id"))
    return after.read().where(F.col("log_id").isNotNull())


@query(
    "insert_counts", "B1",
    f"""WITH {INSERT_SQL} SELECT (SELECT count(*) FROM batch) AS total, (SELECT count(*) FROM fresh) AS inserted,
    (SELECT count(*) FROM batch) - (SELECT count(*) FROM fresh) AS skipped""",
)
def insert_counts(spark, folder):
    stored, batch = insert_parts(spark, folder)
    return sinks.insert_counts(batch, sinks.insert_or_ignore(stored, batch, "k", F.col("log_id")))


@query(
    "insert_report", "B1 N1",
    f"""WITH {P.LOGS}, stored AS (SELECT DISTINCT session_user AS k FROM logs WHERE endpoint = 'error' AND session_user IS NOT NULL),
    batch AS (SELECT CASE WHEN endpoint = 'view' THEN NULL ELSE session_user END AS k, latency_ms <= 90 AS fast, log_id % 7 <> 0 AS numbered
      FROM logs WHERE endpoint <> 'error'),
    good AS (SELECT k FROM batch WHERE fast AND numbered),
    c AS (SELECT (SELECT count(*) FROM batch) AS total,
      (SELECT count(*) FROM good WHERE k IS NULL) + (SELECT count(DISTINCT k) FROM good WHERE k NOT IN (SELECT k FROM stored)) AS inserted,
      (SELECT count(*) FROM batch WHERE NOT (fast AND numbered)) AS errors,
      (SELECT count(*) FROM batch WHERE NOT fast) AS slow, (SELECT count(*) FROM batch WHERE NOT numbered) AS unnumbered)
    SELECT unnest(['total', 'inserted', 'errors', 'broken fast', 'broken numbered', 'skipped']) AS name,
      unnest([total, inserted, errors, slow, unnumbered, total - inserted - errors]) AS n FROM c""",
)
def insert_report(spark, folder):
    """The counts of an insert that checks its rows, taken while it writes."""
    logs = S.request_logs(spark, folder)
    stored, batch = insert_parts(spark, folder)
    latency = logs.select("log_id", "latency_ms")
    columns = ["k", "log_id", "endpoint", "latency_ms"]
    empty = [F.lit(None).cast(t).alias(c) for c, t in zip(columns[1:], ("bigint", "string", "double"))]
    table = bucketed(stored.select("k", *empty), "k")
    rules = {"fast": F.col("latency_ms") <= 90, "numbered": F.col("log_id") % 7 != 0}
    _, counts = snapshots.insert_checked(table, batch.join(latency, "log_id").select(*columns), F.col("log_id"), rules)
    return spark.createDataFrame(list(counts.items()), "name string, n long")


# Stored articles: all but Spanish. Batch: Spanish and French ones with a new title and category.
@query(
    "upsert_articles", "B2",
    """SELECT doc_id AS external_id, CASE WHEN lang IN ('es', 'fr') THEN 'new title' ELSE split_part(text, chr(10), 1) END AS title,
    CASE WHEN lang = 'es' THEN 'new category' ELSE source END AS category, md5(text) AS content FROM documents""",
)
def upsert_articles(spark, folder):
    articles = S.articles(spark, folder).select(
        F.col("article_id").alias("external_id"), "title", "category", F.md5("content").alias("content"), "lang"
    )
    stored = articles.where(F.col("lang") != "es").drop("lang")
    fresh = articles.where(F.col("lang").isin("es", "fr")).withColumns(
        {"title": F.lit("new title"), "category": F.lit("new category")}
    )
    return snapshots.upsert_articles(bucketed(stored, "external_id"), fresh.drop("lang"), F.col("external_id")).read()


@query(
    "replace_chunks", "B3",
    f"""WITH RECURSIVE {CHUNKS} SELECT article_id, chunk_index, CASE WHEN lang = 'fr' THEN 'new' ELSE 'old' END AS version
    FROM chunks JOIN documents ON doc_id = article_id""",
)
def replace_chunks(spark, folder):
    articles = S.articles(spark, folder).select("article_id", "content", "lang")
    cut = lambda df, version: chunking.chunk_table(df, "article_id", "content").select(
        "article_id", "chunk_index", F.lit(version).alias("version")
    )
    fresh = cut(articles.where(F.col("lang") == "fr"), "new")
    return snapshots.replace_children(bucketed(cut(articles, "old"), "article_id"), fresh).read()


@query(
    "upsert_predictions", "B4",
    f"""WITH {P.TICKETS} SELECT ticket_id, CASE WHEN status = 'open' THEN 'open' ELSE status END AS status,
    CASE WHEN priority IN ('P1', 'P2') THEN 'Technical' ELSE 'none' END AS predicted_category,
    CASE WHEN priority IN ('P1', 'P2') THEN 'tech-support' ELSE 'none' END AS assignee_queue FROM tickets
    WHERE status <> 'open' OR priority IN ('P1', 'P2')""",
)
def upsert_predictions(spark, folder):
    tickets = S.tickets(spark, folder).select("ticket_id", "status", "priority")
    stored = tickets.where(F.col("status") != "open").select(
        "ticket_id", "status", F.lit("none").alias("predicted_category"), F.lit("none").alias("assignee_queue")
    )
    batch = tickets.where(F.col("priority").isin("P1", "P2")).select(
        "ticket_id", F.lit("Technical").alias("predicted_category"), N.queue_for(F.lit("Technical")).alias("assignee_queue")
    )
    return snapshots.upsert_predictions(bucketed(stored, "ticket_id"), batch, F.col("ticket_id")).read()


@query(
    "guarded_draft_insert", "B5 D4",
    f"""WITH {P.DRAFTS} SELECT ticket_id, draft_no FROM drafts WHERE ticket_id IN (SELECT vec_id FROM embeddings WHERE label < 5)""",
)
def guarded_draft_insert(spark, folder):
    known = S.vectors(spark, folder).where(F.col("label") < 5).select(F.col("vec_id").alias("ticket_id"))
    return sinks.guarded_insert(S.drafts(spark, folder).select("ticket_id", "draft_no"), known, "ticket_id")


@query(
    "feedback_rows", "B6",
    f"""WITH {P.FEEDBACK} SELECT md5(draft_id || '|' || feedback_id || '|' || draft_id) AS feedback_id, rating FROM feedback WHERE rating BETWEEN 1 AND 4""",
)
def feedback_rows(spark, folder):
    rows = S.feedback(spark, folder).select(
        "draft_id", F.col("feedback_id").alias("agent_id"), F.col("draft_id").alias("created_at"),
        F.when(F.col("rating") == 5, 6).otherwise(F.col("rating")).alias("rating"),
    )
    accepted, _ = sinks.feedback_rows(rows)
    return accepted.select("feedback_id", "rating")


@query(
    "request_log_rows", "B7",
    """SELECT event_type AS endpoint, '{"user":' || user_id || '}' AS request_body, props AS raw, value AS latency_ms FROM events""",
)
def request_log_rows(spark, folder):
    logs = S.request_logs(spark, folder).select(
        "endpoint", F.col("session_user").alias("user"), F.col("response_body").alias("raw"), "latency_ms",
        F.lit(0).alias("tokens"), "created_at",
    )
    written = sinks.stored(sinks.log_rows(logs, ["user"], ["raw"]), "request-logs")
    return written.select("endpoint", "request_body", F.get_json_object("response_body", "$.raw").alias("raw"), "latency_ms")


@query(
    "stored_vectors", "B8",
    "SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS i, unnest(embedding) AS x FROM embeddings",
)
def stored_vectors(spark, folder):
    table = sinks.stored(S.vectors(spark, folder), "vectors")
    return table.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))


@query(
    "upsert_vectors", "B9 S17",
    """SELECT vec_id::VARCHAR AS original_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS i,
    unnest(list_transform(embedding, lambda x: CASE WHEN label >= 5 THEN -x ELSE x END)) AS x FROM embeddings""",
)
def upsert_vectors(spark, folder):
    rows = S.vectors(spark, folder).select(F.col("vec_id").cast("string").alias("original_id"), "embedding", "label")
    stored = rows.where(F.col("label") < 7).select(V.point_id(F.col("original_id")).alias("id"), "original_id", "embedding")
    batch = rows.where(F.col("label") >= 5).withColumn("embedding", F.transform("embedding", lambda x: -x))
    merged = snapshots.upsert_vectors(bucketed(stored, "id"), batch, F.col("original_id"))
    return merged.read().select("original_id", F.posexplode("embedding").alias("i", "x"))


@query("stored_evaluation_run", "B11", RUN_SQL)
def stored_evaluation_run(spark, folder):
    path = scratch_path(spark, "evaluation")
    sinks.write_metrics(rounded(full_run(spark, folder), "value"), path)
    return sinks.read_metrics(spark, path)


@query(
    "weekly_report", "B12 E11 K14",
    f"""WITH {P.TICKETS}, p AS (SELECT * FROM tickets WHERE created_at BETWEEN TIMESTAMP '2000-01-03' AND TIMESTAMP '2000-01-09 23:59:59'),
    c AS (SELECT category, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM p GROUP BY category),
    i AS (SELECT 'P1' AS s, count(*) FILTER (priority = 'P1') * 100.0 / count(*) AS share, 'warning' AS kind, 10.0 AS lim FROM p
      UNION ALL (SELECT category, share, 'trend', 20.0 FROM c ORDER BY n DESC, category LIMIT 1))
    SELECT concat_ws(chr(10), '# Support report', 'Period: 2000-01-03 00:00:00 to 2000-01-09 23:59:59', '', 'Tickets: ' || (SELECT count(*) FROM p),
      'P1 tickets: ' || (SELECT count(*) FROM p WHERE priority = 'P1'), '', '| Category | Tickets | Share |', '|---|---|---|',
      (SELECT string_agg('| ' || category || ' | ' || n || ' | ' || printf('%.1f', round(share, 6)) || '% |', chr(10) ORDER BY n DESC, category) FROM c),
      '', '## Insights', coalesce((SELECT string_agg('- ' || kind || ': ' || s || ' (' || printf('%.1f', round(share, 6)) || '%)', chr(10) ORDER BY kind, s) FROM i WHERE share > lim), '')) AS report""",
)
def weekly_report(spark, folder):
    start, end = "2000-01-03 00:00:00", "2000-01-09 23:59:59"
    tickets = S.tickets(spark, folder)
    week = tickets.where(F.col("created_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    report = reports.weekly_report(tickets, start, end, reports.insight_rows(week, category_limit=20.0))
    path = scratch_path(spark, "report")
    sinks.write_report(report, path)
    return spark.read.text(path, wholetext=True).select(F.rtrim(F.regexp_replace("value", "\\n$", "")).alias("report"))


@query("upsert_daily_metrics", "B13 M12", f"WITH {ROLLUP} SELECT * FROM rollup_rows WHERE date IS NOT NULL")
def upsert_daily_metrics(spark, folder):
    """Stored days hold stale values from the year 2000 on and lack the last years; the batch brings all columns up to date."""
    daily = sinks.stored(daily_metrics_rollup(spark, folder), "daily-metrics")
    metrics = [c for c in daily.columns if c != "date"]
    kinds = dict(daily.dtypes)
    old = F.year("date") < 2000
    stale = daily.select("date", *[F.when(old, F.col(c)).otherwise(F.lit(None).cast(kinds[c])).alias(c) for c in metrics])
    table = bucketed(stale.where(F.year("date") < 2001), "date")
    return snapshots.upsert(table, daily.where(~old), metrics, F.col("date")).read()
