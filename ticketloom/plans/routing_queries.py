"""Registered queries: routing model, triage, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.operators import ranking as R
from ticketloom.operators import features, routing, topics
from ticketloom.plans import sql_parts as P
from ticketloom.plans.registry import query
from ticketloom.session import scratch_path
from ticketloom.sources import sinks
from ticketloom.sources import standins as S

AS_OF = "2001-08-01 00:00:00"

# Predictions have no SQL form. The queries with SQL twins give the facts about them that SQL can state: which rows were
# scored, how many classes there are, that probabilities sum to one and that margins recomputed from the coefficients agree.
# Those without give the results; tests hold these against a plain version of features and regression.

TRAINING = """labelled AS (SELECT doc_id AS ticket_id, lang AS category, CASE WHEN quality = 1 THEN 'P3' ELSE 'P2' END AS priority
    FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND lang IS NOT NULL)"""

SPLIT = f"""{TRAINING}, placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(CAST(ticket_id AS VARCHAR) || '-42'), ticket_id) AS i,
    count(*) OVER (PARTITION BY category) AS n FROM labelled),
  held_out AS (SELECT ticket_id, category, priority FROM placed WHERE i > n - (n * 20 + 99) // 100)"""


@query(
    "training_rows", "A6",
    """SELECT doc_id AS ticket_id, lang AS category, CASE WHEN quality = 1 THEN 'P3' ELSE 'P2' END AS priority
    FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND lang IS NOT NULL""",
)
def training_rows(spark, folder):
    return routing.training_rows(S.labelled_tickets(spark, folder)).select("ticket_id", "category", "priority")


SHARES = """c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
  s AS (SELECT source, lang, n / sum(n) OVER (PARTITION BY source)::DOUBLE AS p FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p DESC, lang) AS i FROM s)"""


def language_shares(spark, folder):
    counts = S.table(spark, folder, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "source").withColumn("p", F.col("n") / F.col("total"))
    return shares.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "p"))).alias("probabilities"))


@query("argmax_class", "F3", f"WITH {SHARES} SELECT source, lang AS label, round(p, 6) AS confidence FROM r WHERE i = 1")
def argmax_class(spark, folder):
    best = language_shares(spark, folder).select("source", R.argmax_label(F.col("probabilities")).alias("b"))
    return best.select("source", F.col("b.label").alias("label"), F.round("b.probability", 6).alias("confidence"))


@query(
    "top_three_classes", "F4 G5",
    f"WITH {SHARES} SELECT source, string_agg(lang, '>' ORDER BY i) AS labels FROM r WHERE i <= 3 GROUP BY source",
)
def top_three_classes(spark, folder):
    from ticketloom.operators.relational import sorted_entries

    first = F.slice(sorted_entries(F.col("probabilities")), 1, 3)
    shares = language_shares(spark, folder)
    return shares.select("source", F.array_join(F.transform(first, lambda e: e["key"]), ">").alias("labels"))


def split_tickets(spark, folder):
    rows = routing.training_rows(S.labelled_tickets(spark, folder))
    marked = R.stratified_split(rows, "category", "ticket_id")
    return marked.where(F.col("split") == "train"), marked.where(F.col("split") == "test")


def recomputed(router, tickets, key, target):
    """(key, label): the class of the largest margin, by joins of the features with the table of coefficients."""
    classifier, labels = router.classifier(target), router.labels(target)
    rows = router.pipeline.transform(routing.plain_tickets(tickets)).select(key, "features")
    weights = routing.weight_table(tickets.sparkSession, classifier, router.vocabulary())
    parts = features.feature_entries(rows, [key]).join(weights, "index").select(
        key, "class", (F.col("value") * F.col("weight")).alias("part")
    )
    shift = classifier.interceptVector.toArray()
    shift = shift if len(shift) == len(labels) else [-shift[0], shift[0]]
    every = F.array(*[F.struct(F.lit(float(c)).alias("class"), F.lit(float(b)).alias("part")) for c, b in enumerate(shift)])
    parts = parts.unionByName(rows.select(key, F.inline(every)))
    margins = parts.groupBy(key, "class").agg(F.sum("part").alias("margin"))
    names = F.array(*[F.lit(v) for v in labels])
    best = margins.groupBy(key).agg(F.max_by("class", F.struct("margin", -F.col("class"))).cast("int").alias("class"))
    return best.select(key, names[F.col("class")].alias("label"))


def agreement(router, tickets, scored, target):
    """(ticket_id, <target>_agrees): whether the prediction is that of the recomputed margins."""
    again = recomputed(router, tickets, "ticket_id", target)
    same = scored.select("ticket_id", f"predicted_{target}").join(again, "ticket_id")
    return same.select("ticket_id", (F.col("label") == F.col(f"predicted_{target}")).alias(f"{target}_agrees"))


def probability_sum(target):
    total = F.aggregate(F.map_values(f"{target}_probabilities"), F.lit(0.0), lambda a, x: a + x)
    return F.round(total, 6).alias(f"{target}_probability")


@query(
    "routing_predictions", "K1 K3 K5 F3",
    f"""WITH {SPLIT} SELECT ticket_id, category, priority, 1.0::DOUBLE AS category_probability, 1.0::DOUBLE AS priority_probability,
    TRUE AS category_agrees, TRUE AS priority_agrees FROM held_out""",
)
def routing_predictions(spark, folder):
    train, test = split_tickets(spark, folder)
    router = routing.fit_router(train)
    test = sinks.stored(test, "held-out")
    scored = router.predict(test)
    out = scored.select("ticket_id", "category", "priority", probability_sum("category"), probability_sum("priority"))
    return out.join(agreement(router, test, scored, "category"), "ticket_id").join(
        agreement(router, test, scored, "priority"), "ticket_id"
    )


@query("routing_labels", "K3 K5 K6 S20 S21")
def routing_labels(spark, folder):
    """Labels, confidences and triage of all tickets by a router fitted on the labelled ones."""
    router = routing.fit_router(routing.training_rows(S.labelled_tickets(spark, folder)))
    out = routing.triage_rules(router.predict(S.text_tickets(spark, folder).select("ticket_id", "subject", "body")))
    return out.select(
        "ticket_id", "predicted_category", F.round("category_confidence", 3).alias("category_confidence"),
        "predicted_priority", F.round("priority_confidence", 3).alias("priority_confidence"), "sla_risk", "suggested_queue",
    )


@query("routing_report", "M6 K3")
def routing_report(spark, folder):
    """Precision, recall and F1 on the held-out tickets."""
    train, test = split_tickets(spark, folder)
    report = routing.evaluate_router(routing.fit_router(train), test)
    return report.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("routing_reasons", "K9")
def routing_reasons(spark, folder):
    """The five terms that speak most for the category of every labelled ticket."""
    rows = routing.training_rows(S.labelled_tickets(spark, folder))
    found = routing.fit_router(rows).explain(rows, "ticket_id")
    return found.select("ticket_id", "rank", "term", F.round("contribution", 3).alias("contribution"))


@query("topic_keywords", "K10 K11 F5 F6")
def topic_keywords(spark, folder):
    """Size, heaviest terms and an example of every cluster."""
    tickets = S.text_tickets(spark, folder).select("ticket_id", "subject", "body")
    profile = topics.profiles(topics.fit_topics(tickets), tickets, "ticket_id")
    return profile.select("cluster", "size", F.array_join("keywords", ",").alias("keywords"), "example")


@query(
    "routing_training_summary", "K4",
    f"""WITH {TRAINING}, c AS (SELECT category, count(*) AS n FROM labelled GROUP BY 1), p AS (SELECT priority, count(*) AS n FROM labelled GROUP BY 1)
    SELECT (SELECT count(*) FROM labelled) AS samples, CAST((SELECT count(*) FROM c) AS INTEGER) AS category_classes,
    CAST((SELECT count(*) FROM p) AS INTEGER) AS priority_classes, TRUE AS features_within_limit, TRUE AS above_majority""",
)
def routing_training_summary(spark, folder):
    """Accuracy is held against the share of the largest class."""
    rows = routing.training_rows(S.labelled_tickets(spark, folder))
    summary = routing.training_summary(routing.fit_router(rows), rows)
    share = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("share")).scalar()
    return summary.select(
        "samples", "category_classes", "priority_classes", F.col("features").between(1, 10_000).alias("features_within_limit"),
        (F.col("category_accuracy") >= share).alias("above_majority"),
    )


@query(
    "stored_router_predictions", "B10 K5",
    f"WITH {TRAINING} SELECT ticket_id, TRUE AS same_category, TRUE AS same_priority, TRUE AS same_confidence FROM labelled",
)
def stored_router_predictions(spark, folder):
    """The router is saved to the shared folder, loaded again, and must answer as before."""
    rows = routing.training_rows(S.labelled_tickets(spark, folder))
    path = scratch_path(spark, "router")
    router = routing.fit_router(rows)
    router.save(path)
    columns = ["predicted_category", "predicted_priority", "category_confidence"]
    before = router.predict(rows).select("ticket_id", *[F.col(c).alias(f"_{c}") for c in columns])
    both = routing.Router.load(path).predict(rows).select("ticket_id", *columns).join(before, "ticket_id")
    return both.select(
        "ticket_id",
        (F.col("predicted_category") == F.col("_predicted_category")).alias("same_category"),
        (F.col("predicted_priority") == F.col("_predicted_priority")).alias("same_priority"),
        (F.abs(F.col("category_confidence") - F.col("_category_confidence")) < 1e-9).alias("same_confidence"),
    )


@query(
    "routing_evaluation", "M6 F7 K3",
    f"""WITH {SPLIT} SELECT category AS label, count(*) AS support, TRUE AS f1_follows, TRUE AS within_bounds FROM held_out GROUP BY 1
    UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT count(*) FROM held_out), TRUE, TRUE""",
)
def routing_evaluation(spark, folder):
    """The report per class and in all; f1 must follow from precision and recall."""
    train, test = split_tickets(spark, folder)
    report = routing.evaluate_router(routing.fit_router(train), test)
    p, r, f1 = F.col("precision"), F.col("recall"), F.col("f1")
    single = ~F.col("label").isin("accuracy", "macro avg", "weighted avg")
    follows = F.when(single & (p + r > 0), F.abs(f1 - 2 * p * r / (p + r)) < 1e-9).otherwise(True)
    return report.where(F.col("support") > 0).select(
        "label", "support", follows.alias("f1_follows"), (p.between(0, 1) & r.between(0, 1) & f1.between(0, 1)).alias("within_bounds")
    )


@query(
    "routing_cross_validation", "K8",
    f"""WITH {TRAINING} SELECT CAST(('0x' || left(md5(CAST(ticket_id AS VARCHAR) || '-42'), 8))::BIGINT * 5 // 4294967296 AS INTEGER) AS fold,
    count(*) AS samples, TRUE AS better_than_chance FROM labelled GROUP BY 1""",
)
def routing_cross_validation(spark, folder):
    rows = routing.training_rows(S.labelled_tickets(spark, folder))
    folds = routing.cross_validate(rows, "ticket_id")
    classes = rows.select("category").distinct().count()
    return folds.select("fold", "samples", (F.col("category_accuracy") > 1.0 / classes).alias("better_than_chance"))


@query(
    "routing_explanations", "K9",
    "SELECT 0::BIGINT AS ranks_out_of_place, 0::BIGINT AS terms_not_in_text, TRUE AS explained",
)
def routing_explanations(spark, folder):
    """The explanations of all tickets, held against their rules: ranks by falling contribution, terms of the text."""
    rows = routing.training_rows(S.labelled_tickets(spark, folder))
    found = routing.fit_router(rows).explain(rows, "ticket_id")
    after = found.select("ticket_id", (F.col("rank") - 1).alias("rank"), F.col("contribution").alias("next"))
    pairs = found.join(after, ["ticket_id", "rank"])
    misplaced = pairs.where(F.col("next") > F.col("contribution")).agg(F.count(F.lit(1)).alias("n")).scalar()
    texts = routing.plain_tickets(rows).select("ticket_id", F.split("_text", r"(?U)\W+").alias("words"))
    words = found.select("ticket_id", F.explode(F.split("term", " ")).alias("word")).join(texts, "ticket_id")
    foreign = words.where(~F.array_contains("words", F.col("word"))).agg(F.count(F.lit(1)).alias("n")).scalar()
    total = found.agg(F.count(F.lit(1)).alias("n"))
    return total.select(
        misplaced.alias("ranks_out_of_place"), foreign.alias("terms_not_in_text"), (F.col("n") > 0).alias("explained")
    )


@query(
    "triage_table", "K6 S20 S21 S22",
    "SELECT doc_id AS ticket_id, TRUE AS known_category, TRUE AS risk_by_rule, TRUE AS queue_by_rule FROM documents",
)
def triage_table(spark, folder):
    """Triage of all tickets, each row held against the rules written out again."""
    rows = routing.training_rows(S.labelled_tickets(spark, folder))
    router = routing.fit_router(rows)
    tickets = S.text_tickets(spark, folder).select("ticket_id", "subject", "body")
    out = routing.triage_rules(router.predict(tickets))
    risk = F.col("predicted_priority").isin("P1", "P2") & (F.col("priority_confidence") > 0.6)
    queue = F.expr(P.case("predicted_category", vocab.QUEUES, "'general-support'"))
    return out.select(
        "ticket_id", F.col("predicted_category").isin(*router.labels("category")).alias("known_category"),
        (F.col("sla_risk") == risk).alias("risk_by_rule"), (F.col("suggested_queue") == queue).alias("queue_by_rule"),
    )


def dated_tickets(spark, folder):
    dates = S.table(spark, folder, "orders").select(F.col("o_orderkey").alias("ticket_id"), F.col("o_orderdate").alias("created_at"))
    return S.text_tickets(spark, folder).select("ticket_id", "subject", "body").join(dates, "ticket_id")


TOPICS = "least(5, greatest(2, count(*) // 3))"


@query(
    "topic_profiles", "K10 K11 F5 F6",
    f"SELECT CAST({TOPICS} AS BIGINT) AS clusters, count(*) AS tickets, 5::INTEGER AS fewest_keywords, TRUE AS named FROM documents",
)
def topic_profiles(spark, folder):
    """The profiles of all clusters: their sizes add up to the tickets, and each has five keywords and an example."""
    tickets = S.text_tickets(spark, folder).select("ticket_id", "subject", "body")
    profile = topics.profiles(topics.fit_topics(tickets), tickets, "ticket_id")
    return profile.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("tickets"), F.min(F.size("keywords")).alias("fewest_keywords"),
        F.bool_and(F.col("example").isNotNull()).alias("named"),
    )


@query(
    "topic_projection", "K12",
    "SELECT doc_id AS ticket_id, TRUE AS finite, TRUE AS variances_fall FROM documents",
)
def topic_projection(spark, folder):
    """The place of every ticket on two components; only the features are fitted."""
    tickets = S.text_tickets(spark, folder).select("ticket_id", "subject", "body")
    out = topics.projection(topics.fit_features(tickets), tickets, "ticket_id")
    finite = ~(F.isnan("x") | F.isnan("y"))
    fall = (F.col("x_variance") >= F.col("y_variance")) & (F.col("y_variance") > 0) & (F.col("x_variance") < 1)
    return out.select("ticket_id", finite.alias("finite"), fall.alias("variances_fall"))


@query(
    "topic_table", "K13 F8",
    f"""WITH d AS (SELECT o_orderdate AS day FROM documents JOIN orders ON o_orderkey = doc_id)
    SELECT CAST({TOPICS} AS BIGINT) AS clusters, count(*) AS tickets,
      count(*) FILTER (day >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND day < TIMESTAMP '{AS_OF}') AS recent,
      count(*) FILTER (day >= TIMESTAMP '{AS_OF}' - INTERVAL 730 DAY AND day < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) AS earlier,
      CAST(min(day) AS DATE) AS first_seen, TRUE AS trends_follow FROM d""",
)
def topic_table(spark, folder):
    """The table of all clusters: counts over both windows add up, and trends follow from them."""
    tickets = dated_tickets(spark, folder)
    table = topics.topic_table(topics.fit_topics(tickets), tickets, "ticket_id", "created_at", AS_OF, 365)
    ratio = F.col("recent") / F.when(F.col("earlier") > 0, F.col("earlier"))
    trend = (
        F.when((F.col("earlier") == 0) & (F.col("recent") > 0), "emerging").when(ratio > 1.2, "emerging")
        .when(ratio < 0.8, "declining").otherwise("stable")
    )
    return table.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("tickets"), F.sum("recent").alias("recent"),
        F.sum("earlier").alias("earlier"), F.min("first_seen").alias("first_seen"),
        F.bool_and(F.col("trend") == trend).alias("trends_follow"),
    )
