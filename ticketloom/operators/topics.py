"""Topic clusters over ticket texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators import features, ranking
from ticketloom.session import together
from ticketloom.sources import sinks

#: Vocabulary size, largest document share, fewest tickets, restarts, seed.
MAX_FEATURES = 500
MAX_DF = 0.8
MIN_TICKETS = 5
RESTARTS = 10
SEED = 42
#: Restarts that run at the same time: each makes dozens of small jobs, which alone leave cores idle.
FITS_AT_ONCE = 4


@dataclass(frozen=True)
class Topics:
    pipeline: PipelineModel
    model: KMeansModel
    #: The tickets that the model comes from, and their columns but the body beside ``cluster``, written.
    tickets: DataFrame | None = None
    clusters: DataFrame | None = None

    def assign(self, tickets: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Tickets with their cluster number, or ``columns`` of them; those that the model comes from are not read again."""
        columns = columns or tickets.columns
        if tickets is self.tickets and set(columns) <= set(self.clusters.columns):
            return self.clusters.select(*columns, "cluster")
        prepared = features.with_features(self.pipeline, _with_text(tickets), columns)
        return self.model.transform(prepared).drop("features")

    def top_terms(self, spark, n: int = 10) -> DataFrame:
        """(cluster, term, weight, rank): the heaviest terms of each centre."""
        terms = features.vocabulary(self.pipeline)
        rows = [
            (c, terms[i], float(w))
            for c, centre in enumerate(self.model.clusterCenters())
            for i, w in enumerate(centre)
        ]
        table = spark.createDataFrame(rows, "cluster int, term string, weight double")
        return ranking.rank_hits(table, "cluster", n, F.col("weight").desc(), F.col("term"))


def _with_text(tickets: DataFrame) -> DataFrame:
    joined = F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    return tickets.withColumn("_text", features.plain_text(joined))


def cluster_count(n: int) -> int:
    return max(2, min(5, n // 3))


def _fitted(tickets: DataFrame, keep: list[str]) -> features.Fitted | None:
    if tickets.select(*keep, "subject", "body").limit(MIN_TICKETS).count() < MIN_TICKETS:
        return None
    placed = _with_text(tickets).withColumn("_place", F.monotonically_increasing_id())
    return features.fit_parts(placed, "_text", [*keep, "_place"], None, [None], MAX_FEATURES, 2, MAX_DF)[0]


def _as_read(rows: DataFrame) -> DataFrame:
    """The features in the partitions and the order of the tickets, which the first centres of k-means depend on."""
    part = F.shiftright("_place", 33).cast("int")
    parts = rows.agg(F.max(part)).first()[0] + 1
    return rows.repartitionById(parts, part).sortWithinPartitions("_place").select("features")


def fit_features(tickets: DataFrame) -> PipelineModel | None:
    """The TF-IDF stages alone; None for fewer than five tickets."""
    fitted = _fitted(tickets, [])
    return fitted and fitted.pipeline


def fit_topics(tickets: DataFrame, restarts: int = RESTARTS, seed: int = SEED) -> Topics | None:
    """k-means over TF-IDF vectors, best of several seeds; None for fewer than five tickets."""
    keep = [c for c in tickets.columns if c != "body"]
    fitted = _fitted(tickets, keep)
    if fitted is None:
        return None
    rows = fitted.rows()
    n = rows.limit(15).count()
    prepared = _as_read(rows).persist()

    def fit(i):
        return KMeans(k=cluster_count(n), seed=seed + i, featuresCol="features", predictionCol="cluster").fit(prepared)

    try:
        prepared.count()
        fits = together(tickets.sparkSession, [lambda i=i: fit(i) for i in range(restarts)], FITS_AT_ONCE)
        best = min(fits, key=lambda m: m.summary.trainingCost)
    finally:
        prepared.unpersist()
    return Topics(fitted.pipeline, best, tickets, best.transform(rows).drop("features", "_place"))


PROFILE = "cluster int, size long, keywords array<string>, example string"
TABLE = (
    "cluster int, size long, keywords array<string>, example string, name string, recent long, earlier long, "
    "first_seen date, trend string, is_active boolean"
)


def profiles(topics: Topics | None, tickets: DataFrame, key: str) -> DataFrame:
    """(cluster, size, keywords, example): size, five heaviest terms, subject of the first ticket. No topics, no rows."""
    if topics is None:
        return tickets.sparkSession.createDataFrame([], PROFILE)
    assigned = topics.assign(tickets, [*dict.fromkeys([key, "subject"])])
    sizes = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.min_by(F.substring("subject", 1, 60), F.col(key)).alias("example")
    )
    terms = topics.top_terms(tickets.sparkSession).where(F.col("rank") <= 5)
    keywords = terms.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("keywords")
    )
    return sizes.join(keywords, "cluster")


def topic_table(topics: Topics | None, tickets: DataFrame, key: str, created_at: str, as_of: str, days: int = 90) -> DataFrame:
    """(cluster, name, size, keywords, example, trend, first_seen, recent, earlier, is_active); empty without topics."""
    if topics is None:
        return tickets.sparkSession.createDataFrame([], TABLE)
    profile = profiles(topics, tickets, key)
    trend = ranking.trend_labels(topics.assign(tickets, [created_at]), "cluster", created_at, as_of, days)
    named = profile.withColumn("name", F.array_join(F.slice("keywords", 1, 3), " / "))
    return named.join(trend, "cluster", "left").withColumn("is_active", F.coalesce("recent", F.lit(0)) > 0)


def projection(pipeline: PipelineModel | None, tickets: DataFrame, key: str) -> DataFrame:
    """(key, x, y, x_variance, y_variance): two principal components and the variance they explain; no rows without features.

    The driver handles a features x features matrix, which the 500-term vocabulary bounds; rows stay distributed.
    """
    if pipeline is None:
        kind = tickets.schema[key].dataType.simpleString()
        empty = f"`{key}` {kind}, x double, y double, x_variance double, y_variance double"
        return tickets.sparkSession.createDataFrame([], empty)
    # Written, because the components take several passes and the result another.
    prepared = sinks.stored(features.with_features(pipeline, _with_text(tickets), [key]), "topic-vectors")
    model = PCA(k=2, inputCol="features", outputCol="_p").fit(prepared)
    share = model.explainedVariance.toArray()
    point = vector_to_array(F.col("_p"))
    return model.transform(prepared).select(
        key,
        point[0].alias("x"),
        point[1].alias("y"),
        F.lit(float(share[0])).alias("x_variance"),
        F.lit(float(share[1])).alias("y_variance"),
    )
