"""A corpus pipeline: language, toxicity, near duplicates, benchmark passages, tokens.

Each stage takes the documents its predecessor kept and returns those it keeps, with the columns of ``documents``; the
last returns the token digests. Between stages the documents are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import decontamination, language_id, ngram_join, toxicity
from ticketloom.llm.id_filter import without
from ticketloom.llm.queries import bpe_digests, language_network, language_rows, table, toxicity_model
from ticketloom.sources.sinks import stored

ROW = "_row"


def _packed(docs: DataFrame) -> DataFrame:
    """Key, text and the whole row as one column, so columns of any name travel with the decision."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def _kept(judged: DataFrame, condition) -> DataFrame:
    return judged.where(condition).select(f"{ROW}.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network has learned. Those that are NULL, empty or hold no letter go, those that no
    language speaks for, and those that look like none: both limits come from all rows that the network may learn from. All
    documents are judged once and written with their scores, from which limits and rows are then read. Without labelled rows
    there is no network, and documents with a letter stay. Rows with NULL or equal ids are judged each by their own text;
    columns may have any names. An empty table stays empty."""
    network = language_network(docs)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = stored(language_id.predict(_packed(docs), "doc_id", "text", network, ROW, with_strange=True), "languages")
    right = F.col(f"{ROW}.text").rlike(r"\p{L}") & (F.col(f"{ROW}.lang").cast("string") == F.col("lang_pred"))
    lowest, strangest = language_id.limits(network, language_rows(judged).where(right))
    named = F.col("lang_pred") != language_id.UNKNOWN
    return _kept(judged, named & (F.col("score") >= lowest) & (F.col("strange") <= strangest))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. NULL and empty texts have no hit and stay; rows with NULL or equal ids are
    judged each by their own text; columns of any names travel with them. An empty table stays empty."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.score(_packed(docs), "doc_id", "text", model, ROW, threshold=0.7)
    return _kept(judged, F.col("predicted") == 0)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; rows without an id stay.

    Of rows with the same id one stays, the least by its JSON form. A NULL or empty text is alike with nothing. Columns may
    have any names and types.
    """
    groups = stored(ngram_join.similar_groups(docs, "doc_id", "text"), "groups")
    others = stored(groups.where("component_id <> doc_id").select("doc_id").distinct(), "others")
    repeated = groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = without(docs, "doc_id", others)
    if repeated.isEmpty():
        return kept
    rows = _packed(kept)
    single = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(ROW, F.to_json(ROW)).alias(ROW))
    return rows.join(repeated, "doc_id", "left_anti").select(ROW).unionByName(single.select(ROW)).select(f"{ROW}.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. NULL and empty texts contain none and stay; rows without an id stay; rows of
    one id share their fate; columns may have any names. An empty table stays empty."""
    items = table(spark, sf_dir, "benchmark")
    return decontamination.without_contaminated(docs, "doc_id", "text", items, "item_id", "text")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: of NULL and empty texts without tokens, and of each
    row by itself where ids are NULL or repeat. Other columns are not read; an empty table gives no rows."""
    return bpe_digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("ngram_join", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: Two stages are learned and one encodes bytes, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
