"""Registered queries: retrieval, routing and draft evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import normalize as N
from ticketloom.operators import aggregates as A
from ticketloom.operators import containment, posting_index
from ticketloom.operators import evaluation as E
from ticketloom.plans import indexes
from ticketloom.plans import sql_parts as P
from ticketloom.plans.registry import query
from ticketloom.plans.retrieval_queries import ARTICLE_PARTS, bm25_sql, cover_sql, dense_hits, dense_sql, okapi_hits
from ticketloom.sources import sinks
from ticketloom.sources import standins as S

RELEVANT = """rel AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def metrics_sql(hits: str, queries: str, judged: str = "") -> str:
    """Per-query metrics from hits (query_id, doc_id, rank) and rel (query_id, doc_id)."""
    judged = judged or f"""SELECT h.query_id, h.doc_id, h.rank, r.doc_id IS NOT NULL AS is_rel FROM {hits} h
      LEFT JOIN rel r ON r.query_id = h.query_id AND r.doc_id = h.doc_id"""
    return f"""jd AS ({judged}), ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
    tot AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM rel GROUP BY query_id),
    pq AS (SELECT q.query_id, CAST(k AS INTEGER) AS k, coalesce(max(t.n), 0) AS n,
        count(DISTINCT j.doc_id) FILTER (is_rel AND rank <= k) AS found,
        coalesce(sum(1 / log2(rank + 1)) FILTER (is_rel AND rank <= k), 0) AS dcg, min(rank) FILTER (is_rel) AS first
      FROM ({queries}) q CROSS JOIN ks LEFT JOIN tot t ON t.query_id = q.query_id LEFT JOIN jd j ON j.query_id = q.query_id
      GROUP BY q.query_id, k),
    pm AS (SELECT query_id, k, CASE WHEN n > 0 THEN found / n::DOUBLE ELSE 0 END AS recall, found / k::DOUBLE AS precision,
        CASE WHEN n > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(k, n)) ELSE 0 END AS ndcg,
        coalesce(1.0::DOUBLE / first, 0) AS reciprocal_rank FROM pq)"""


TABLE_SQL = """SELECT 'recall' AS metric, k, round(avg(recall), 6) AS value FROM pm GROUP BY k
    UNION ALL SELECT 'precision', k, round(avg(precision), 6) FROM pm GROUP BY k
    UNION ALL SELECT 'ndcg', k, round(avg(ndcg), 6) FROM pm GROUP BY k
    UNION ALL SELECT 'mrr', 0, round(avg(reciprocal_rank), 6) FROM pm WHERE k = 10"""

QUERIES = "SELECT item_id AS query_id FROM benchmark"


def relevance(spark, folder):
    """Judgements by one pass over the texts, stored because metric tables read them more than once."""
    found = containment.contained_passages(S.table(spark, folder, "documents"), "doc_id", "text", S.passages(spark, folder))
    return sinks.stored(found, "judgements")


def bm25_hits(spark, folder, k=10):
    return okapi_hits(spark, folder, k)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("passages_in_documents", "D7 A9", f"WITH {RELEVANT} SELECT * FROM rel")
def passages_in_documents(spark, folder):
    return relevance(spark, folder).distinct()


@query(
    "judged_hits", "D7 H2 F10",
    f"""WITH {bm25_sql(10)}, {RELEVANT} SELECT bm.query_id, bm.doc_id, bm.rank, rel.doc_id IS NOT NULL AS is_relevant
    FROM bm LEFT JOIN rel ON rel.query_id = bm.query_id AND rel.doc_id = bm.doc_id""",
)
def judged_hits(spark, folder):
    return E.judge(bm25_hits(spark, folder), relevance(spark, folder))


@query(
    "bm25_metrics_per_query", "M1 M2 M3 M4 F10",
    f"""WITH {bm25_sql(10)}, {RELEVANT}, {metrics_sql("bm", QUERIES)}
    SELECT query_id, k, round(recall, 6) AS recall, round(precision, 6) AS precision, round(ndcg, 6) AS ndcg,
      round(reciprocal_rank, 6) AS reciprocal_rank FROM pm""",
)
def bm25_metrics_per_query(spark, folder):
    known = relevance(spark, folder)
    rows = E.per_query_metrics(E.judge(bm25_hits(spark, folder), known), E.relevant_counts(known), S.passages(spark, folder))
    return rounded(rows, "recall", "precision", "ndcg", "reciprocal_rank")


def metric_table(spark, folder, hits, known=None):
    known = relevance(spark, folder) if known is None else known
    return rounded(
        E.retrieval_metrics(E.judge(hits, known), E.relevant_counts(known), S.passages(spark, folder)), "value"
    )


@query("bm25_metric_table", "M5 M1 M2 M3 M4 J10", f"""WITH {bm25_sql(10)}, {RELEVANT}, {metrics_sql("bm", QUERIES)} {TABLE_SQL}""")
def bm25_metric_table(spark, folder):
    return metric_table(spark, folder, bm25_hits(spark, folder))


@query(
    "cover_rank_metric_table", "M5 J5",
    f"""WITH {P.ARTICLES}, pub AS (SELECT * FROM articles WHERE status = 'published'), {cover_sql(ARTICLE_PARTS, "article_id", 10)},
    {RELEVANT}, {metrics_sql("hits", QUERIES)} {TABLE_SQL}""",
)
def cover_rank_metric_table(spark, folder):
    return metric_table(spark, folder, article_hits(spark, folder))


def article_hits(spark, folder):
    return posting_index.search_articles(indexes.articles(spark, folder), S.passages(spark, folder), 10)


@query(
    "lexical_methods_compared", "M5 M10 D13 J5 J10",
    f"""WITH {P.ARTICLES}, pub AS (SELECT * FROM articles WHERE status = 'published'),
    a AS (WITH {cover_sql(ARTICLE_PARTS, "article_id", 10)}, {RELEVANT}, {metrics_sql("hits", QUERIES)} {TABLE_SQL}),
    b AS (WITH {bm25_sql(10)}, {RELEVANT}, {metrics_sql("bm", QUERIES)} {TABLE_SQL})
    SELECT metric, k, a.value AS cover_rank, b.value AS bm25, round(b.value - a.value, 6) AS delta FROM a JOIN b USING (metric, k)""",
)
def lexical_methods_compared(spark, folder):
    """Both methods against the same judgements, which are made once."""
    section, known = F.lit("retrieval").alias("section"), relevance(spark, folder)
    cover = metric_table(spark, folder, article_hits(spark, folder), known).select("*", section)
    okapi = metric_table(spark, folder, bm25_hits(spark, folder), known).select("*", section)
    return E.compare_runs(cover, okapi).select(
        "metric", "k", F.col("baseline").alias("cover_rank"), F.col("target").alias("bm25"), F.round("delta", 6).alias("delta")
    )


LABEL_REL = "rel AS (SELECT label AS query_id, vec_id AS doc_id FROM embeddings)"


@query(
    "dense_metric_table", "M5 J3 D8",
    f"""WITH {dense_sql(k=10)}, {LABEL_REL}, {metrics_sql("dense", "SELECT DISTINCT label AS query_id FROM embeddings")} {TABLE_SQL}""",
)
def dense_metric_table(spark, folder):
    labels = S.vectors(spark, folder).select(F.col("vec_id").alias("doc_id"), "label")
    asked = labels.select(F.col("label").alias("query_id"), "label").distinct()
    judged, totals = E.judge_by_label(dense_hits(spark, folder, 10), asked, labels)
    return rounded(E.retrieval_metrics(judged, totals, asked), "value")


@query(
    "relevant_set_sizes", "D8",
    """SELECT c.c_custkey AS query_id, count(*) AS n_relevant FROM customer c
    JOIN (SELECT c_mktsegment, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) t USING (c_mktsegment) GROUP BY 1""",
)
def relevant_set_sizes(spark, folder):
    asked = S.table(spark, folder, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("label"))
    per_label = S.tickets(spark, folder).groupBy(F.col("category").alias("label")).agg(F.count(F.lit(1)).alias("n_relevant"))
    return asked.join(per_label, "label").select("query_id", "n_relevant")


GUESS = """g AS (SELECT lang AS actual, CASE WHEN toxic = 1 THEN 'de' WHEN quality = 1 THEN 'en' ELSE 'xx' END AS predicted
  FROM documents JOIN labels USING (doc_id))"""


def guesses(spark, folder):
    guess = F.when(F.col("toxic") == 1, "de").when(F.col("quality") == 1, "en").otherwise("xx")
    truth = S.table(spark, folder, "documents").select("doc_id", F.col("lang").alias("actual"))
    return truth.join(S.table(spark, folder, "labels").select("doc_id", guess.alias("predicted")), "doc_id")


REPORT = f"""{GUESS}, labs AS (SELECT actual AS label FROM g UNION SELECT predicted FROM g),
  c AS (SELECT label, (SELECT count(*) FROM g WHERE actual = label) AS support, (SELECT count(*) FROM g WHERE predicted = label) AS guessed,
    (SELECT count(*) FROM g WHERE actual = label AND predicted = label) AS hit FROM labs),
  pr AS (SELECT *, CASE WHEN guessed > 0 THEN hit / guessed::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS recall FROM c),
  cl AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr),
  report AS (SELECT label, precision, recall, f1, support FROM cl
    UNION ALL SELECT 'accuracy', sum(hit) / sum(support)::DOUBLE, sum(hit) / sum(support)::DOUBLE, sum(hit) / sum(support)::DOUBLE, CAST(sum(support) AS BIGINT) FROM cl
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM cl
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM cl)"""


@query(
    "classification_report", "M6 H3",
    f"WITH {REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report",
)
def classification_report(spark, folder):
    report = E.classification_report(E.confusion_counts(guesses(spark, folder), "actual", "predicted"))
    return rounded(report, "precision", "recall", "f1")


@query(
    "confusion_matrix", "M7",
    f"""WITH {GUESS}, l AS (SELECT actual AS label FROM g UNION SELECT predicted FROM g)
    SELECT a.label AS actual, b.label AS predicted, count(g.actual) AS n FROM l a CROSS JOIN l b
    LEFT JOIN g ON g.actual = a.label AND g.predicted = b.label GROUP BY ALL""",
)
def confusion_matrix(spark, folder):
    return E.confusion_matrix(E.confusion_counts(guesses(spark, folder), "actual", "predicted"))


@query(
    "baseline_accuracies", "K7 E14",
    """SELECT round(max(n) / sum(n)::DOUBLE, 6) AS majority, round(1.0 / count(*)::DOUBLE, 6) AS uniform
    FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""",
)
def baseline_accuracies(spark, folder):
    return rounded(E.baseline_accuracy(S.table(spark, folder, "documents"), "lang"), "majority", "uniform")


# Stand-in for evaluated drafts: the turn number as citations beyond the first, the text length as latency.
EVALUATED = f"""{P.DRAFTS}, ev AS (SELECT ticket_id, draft_no, draft_text || CASE WHEN draft_no = 3 THEN ' Probably.' ELSE '' END AS draft_text,
  draft_no - 1 AS citation_count, length(draft_text)::DOUBLE AS latency_ms,
  CASE WHEN draft_no = 2 THEN NULL ELSE draft_no END AS correctness, 4 AS completeness, least(5, draft_no + 1) AS tone, 2 AS actionability, NULL::BIGINT AS citation FROM drafts)"""


def evaluated_drafts(spark, folder):
    no = F.col("draft_no")
    return S.drafts(spark, folder).select(
        "ticket_id",
        "draft_no",
        F.concat("draft_text", F.when(no == 3, " Probably.").otherwise("")).alias("draft_text"),
        (no - 1).alias("citation_count"),
        F.length("draft_text").cast("double").alias("latency_ms"),
        F.when(no != 2, no).alias("correctness"),
        F.lit(4).alias("completeness"),
        F.least(F.lit(5), no + 1).alias("tone"),
        F.lit(2).alias("actionability"),
        F.lit(None).cast("bigint").alias("citation"),
    )


QUALITY = """quality AS (SELECT count(*) AS samples, avg(CASE WHEN citation_count > 0 THEN 1.0::DOUBLE ELSE 0 END) AS citation_rate,
  avg(citation_count)::DOUBLE AS mean_citations, avg(CASE WHEN contains(lower(draft_text), 'probably') THEN 1.0::DOUBLE ELSE 0 END) AS hedging_rate,
  quantile_cont(latency_ms, 0.5) AS latency_p50_ms, quantile_cont(latency_ms, 0.95) AS latency_p95_ms FROM ev)"""


@query(
    "draft_quality", "M8 S24",
    f"""WITH {EVALUATED}, {QUALITY} SELECT samples, round(citation_rate, 6) AS citation_rate, round(mean_citations, 6) AS mean_citations,
    round(hedging_rate, 6) AS hedging_rate, round(latency_p50_ms, 6) AS latency_p50_ms, round(latency_p95_ms, 6) AS latency_p95_ms FROM quality""",
)
def draft_quality(spark, folder):
    out = E.draft_quality(evaluated_drafts(spark, folder))
    return rounded(out, *[c for c in out.columns if c != "samples"])


@query(
    "rubric_scores", "E21 S25 S26",
    f"""WITH {EVALUATED}, s AS (SELECT avg(coalesce(correctness, 3)) AS correctness, avg(completeness) AS completeness, avg(tone) AS tone,
      avg(actionability) AS actionability, avg(coalesce(citation, 3)) AS citation FROM ev)
    SELECT round(correctness, 6) AS correctness, round(completeness, 6) AS completeness, round(tone, 6) AS tone, round(actionability, 6) AS actionability,
      round(citation, 6) AS citation,
      round(correctness * 0.25 + completeness * 0.20 + tone * 0.15 + actionability * 0.20 + citation * 0.20, 6) AS overall FROM s""",
)
def rubric_scores(spark, folder):
    out = A.rubric_means(evaluated_drafts(spark, folder), {c: F.col(c) for c in vocab.RUBRIC_WEIGHTS})
    return rounded(out, *out.columns)


@query(
    "weighted_scores", "S25 S26",
    f"""WITH {EVALUATED}, c AS (SELECT ticket_id, draft_no, greatest(1, least(5, coalesce(draft_no * 2 - 3, 3))) AS clamped FROM ev)
    SELECT ticket_id, draft_no, CAST(clamped AS BIGINT) AS clamped, round(clamped * 0.25::DOUBLE + 3 * 0.75::DOUBLE, 6) AS weighted FROM c""",
)
def weighted_scores(spark, folder):
    clamped = N.clamp_score(F.col("draft_no") * 2 - 3)
    drafts = evaluated_drafts(spark, folder).select("ticket_id", "draft_no", clamped.alias("clamped"))
    score = N.weighted_score({"correctness": F.col("clamped")})
    return drafts.withColumn("weighted", F.round(score, 6))


@query(
    "judge_answers_parsed", "L10 S25",
    f"""WITH {P.DRAFTS} SELECT ticket_id, draft_no,
      CASE WHEN draft_no = 1 THEN 1 WHEN draft_no = 2 THEN 5 ELSE 3 END AS correctness, CASE WHEN draft_no = 1 THEN 4 ELSE 3 END AS tone FROM drafts""",
)
def judge_answers_parsed(spark, folder):
    no = F.col("draft_no")
    answer = (
        F.when(no == 1, F.concat(F.lit("<think>{ maybe "), "draft_text", F.lit('</think> Scores: {"correctness": -2, "tone": 4} done')))
        .when(no == 2, F.concat(F.lit('{"correctness": 9, "justification": '), F.to_json(F.struct(F.col("draft_text"))), F.lit("}")))
        .otherwise(F.col("draft_text"))
    )
    drafts = S.drafts(spark, folder).withColumn("answer", answer)
    scores = E.rubric_from_json(F.col("answer"))
    return drafts.select("ticket_id", "draft_no", scores["correctness"].alias("correctness"), scores["tone"].alias("tone"))


@query(
    "acceptance_rate", "M9",
    f"""WITH {P.DRAFTS} SELECT round(avg(CASE WHEN draft_no <= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS acceptance_rate FROM drafts""",
)
def acceptance_rate(spark, folder):
    share = F.when(F.col("draft_no") == 1, 0.0).when(F.col("draft_no") == 2, 0.1).otherwise(0.5)
    bands = S.drafts(spark, folder).select(N.acceptance_band(share, F.col("draft_no") > 5).alias("band"))
    return rounded(E.acceptance_rate(bands), "acceptance_rate")


RUN_SQL = f"""WITH {REPORT}, {bm25_sql(10)}, {RELEVANT}, {metrics_sql("bm", QUERIES)}, {EVALUATED}, {QUALITY}
    SELECT 'run-1' AS run_id, 'routing' AS section, CASE label WHEN 'accuracy' THEN 'accuracy' WHEN 'macro avg' THEN 'f1_macro' ELSE 'f1_weighted' END AS metric,
      0 AS k, round(f1, 6) AS value FROM report WHERE label IN ('accuracy', 'macro avg', 'weighted avg')
    UNION ALL SELECT 'run-1', 'retrieval', metric, k, value FROM ({TABLE_SQL})
    UNION ALL SELECT 'run-1', 'draft', name, 0, round(value, 6) FROM (UNPIVOT (SELECT samples::DOUBLE AS samples, citation_rate, mean_citations, hedging_rate, latency_p50_ms, latency_p95_ms FROM quality) ON COLUMNS(*) INTO NAME name VALUE value)"""


def full_run(spark, folder):
    return E.evaluation_run(
        "run-1",
        "full",
        E.confusion_counts(guesses(spark, folder), "actual", "predicted"),
        bm25_metric_table(spark, folder),
        E.draft_quality(evaluated_drafts(spark, folder)),
    )


@query("evaluation_run_full", "M14 B11", RUN_SQL)
def evaluation_run_full(spark, folder):
    return rounded(full_run(spark, folder), "value")
