"""One registered query per operator: production parameters, whole tables, the digest columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import (
    byte_bpe,
    centroids,
    decontamination,
    embedding_dedup,
    language_id,
    ngram_join,
    packing,
    quality_lm,
    quotations,
    ranked_search,
    sharding,
    token_files,
    toxicity,
)
from ticketloom.session import scratch_path

QUERIES = {}
SQL = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


#: Rows that travel between Spark and Python at a time; texts are long, so fewer than Spark's default.
ROWS_PER_BATCH = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; NULL for a NULL key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def language_rows(documents: DataFrame) -> DataFrame:
    """The rows that the language network may learn from."""
    return documents.where(fold_of("doc_id", 5) != 0)


def language_network(documents: DataFrame):
    return language_id.learn(language_rows(documents))


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.learn(documents, labels.where(fold_of("doc_id", 3) != 1))


def byte_ranks() -> dict[bytes, int]:
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN counted ON counted.a = vec_id
"""


@_query("op1_embedding_dedup", OP1_SQL)
def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = language_id.predict(documents, "doc_id", "text", language_network(documents))
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: Documents and items as lists of distinct five-word shingles; a shorter text is one shingle.
def _shingle_sql(name: str, source: str, key: str) -> str:
    return f"""
{name}_words AS (
  SELECT {key} AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM {source} WHERE {key} IS NOT NULL
), {name} AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM {name}_words
)"""


OP3_SQL = f"""
WITH RECURSIVE {_shingle_sql("d", "documents", "doc_id")}, sizes AS (
  SELECT id, count(*) AS n FROM d GROUP BY id
), links AS (
  SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON x.s = y.s AND x.id <> y.id
  JOIN sizes p ON p.id = x.id JOIN sizes q ON q.id = y.id
  GROUP BY x.id, y.id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN sizes ON sizes.id = doc_id LEFT JOIN lowest ON lowest.a = doc_id
"""

CONTAINED_SQL = """contained AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM d JOIN i ON d.s = i.s GROUP BY d.id, i.id
), totals AS (
  SELECT id, count(*) AS q FROM i GROUP BY id
), found AS (
  SELECT doc_id, item_id, q AS item_shingles, shared AS shared_shingles, shared / q AS containment
  FROM contained JOIN totals ON totals.id = item_id WHERE 100 * shared >= 75 * q
)"""

OP4_SQL = f"""
WITH {_shingle_sql("d", "documents", "doc_id")}, {_shingle_sql("i", "benchmark", "item_id")}, {CONTAINED_SQL}
SELECT * FROM found
"""


@_query("op3_ngram_join", OP3_SQL)
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, folder, "documents"), "doc_id", "text")


@_query("op4_decontamination", OP4_SQL)
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contained_items(
        table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text"
    )


@_query("op5_token_files")
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(documents, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    found = token_files.read_token_files(spark, path, "doc_id")
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query("op6_quality_lm")
def op6_quality_lm(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").where(F.col("quality") == 1).select("doc_id")
    return quality_lm.classify(table(spark, folder, "documents"), "doc_id", "text", "lang", trusted)


OP7_SQL = """
WITH RECURSIVE own AS (
  SELECT conv_id, turn, role, trim('Message ' || conv_id || ' ' || turn || ' ' ||
    regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS body,
    CASE WHEN (conv_id * 31 + turn * 7) % 5 > 0 AND turn > 0 THEN turn - 1 - (conv_id + turn) % least(turn, 3) END AS asked
  FROM conversations
), firsts AS (
  SELECT conv_id, turn, min(asked) AS asked FROM own GROUP BY conv_id, turn
), linked AS (
  SELECT o.*, p.turn AS parent, g.turn AS grand FROM own o LEFT JOIN firsts p ON p.conv_id = o.conv_id AND p.turn = o.asked
  LEFT JOIN firsts g ON g.conv_id = p.conv_id AND g.turn = p.asked
), edges AS (
  SELECT DISTINCT conv_id, turn, parent FROM linked
), reach AS (
  SELECT conv_id, turn, turn AS root, 0 AS depth FROM edges WHERE parent IS NULL
  UNION ALL SELECT e.conv_id, e.turn, r.root, r.depth + 1 FROM edges e JOIN reach r ON r.conv_id = e.conv_id AND r.turn = e.parent
)
SELECT conv_id, turn, role, parent AS parent_turn, root AS root_turn, CAST(depth AS INTEGER) AS depth,
  row_number() OVER (PARTITION BY conv_id, root ORDER BY turn, role, body) - 1 AS position,
  CASE WHEN parent IS NULL THEN 0 WHEN grand IS NULL THEN 1 ELSE 2 END AS n_quotes, body,
  '<|' || role || '|>' || chr(10) || body || chr(10) AS formatted
FROM linked JOIN reach USING (conv_id, turn)
"""


def quoting_messages(messages: DataFrame) -> DataFrame:
    """The messages of the table, of which most quote an earlier one of their conversation with what that one quoted. A message
    is one line under its own number, so that every quoted sentence has one writer."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+", " ")
    body = F.trim(F.concat(F.lit("Message "), F.col("conv_id"), F.lit(" "), F.col("turn"), F.lit(" "), words))
    back = F.col("turn") - 1 - (F.col("conv_id") + F.col("turn")) % F.least("turn", F.lit(3))
    asks = ((F.col("conv_id") * 31 + F.col("turn") * 7) % 5 > 0) & (F.col("turn") > 0)
    own = messages.select("conv_id", "turn", "role", body.alias("body"), F.when(asks, back).alias("asked"))
    firsts = own.groupBy("conv_id", "turn").agg(F.min("body").alias("quoted"), F.min("asked").alias("asked"))

    def quoted(name: str) -> DataFrame:
        return firsts.select("conv_id", F.col("turn").alias(f"{name}_turn"), F.col("quoted").alias(name), F.col("asked").alias(f"{name}_asked"))

    out = own.join(quoted("parent").withColumnRenamed("parent_turn", "asked"), ["conv_id", "asked"], "left")
    out = out.join(quoted("grand").withColumnRenamed("grand_turn", "parent_asked"), ["conv_id", "parent_asked"], "left")
    deeper = F.when(F.col("grand").isNotNull(), F.concat(F.lit("\n>> "), F.col("grand"))).otherwise("")
    answer = F.concat(F.lit("Someone wrote:\n> "), F.col("parent"), deeper, F.lit("\n"), F.col("body"))
    return out.select("conv_id", "turn", "role", F.when(F.col("parent").isNotNull(), answer).otherwise(F.col("body")).alias("text"))


@_query("op7_quotations", OP7_SQL)
def op7_quotations(spark: SparkSession, folder: str) -> DataFrame:
    messages = quoting_messages(table(spark, folder, "conversations"))
    return quotations.conversations(messages, "conv_id", "turn", "role", "text")


@_query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(table(spark, folder, "documents"))


def bpe_digests(documents: DataFrame) -> DataFrame:
    found = byte_bpe.encode(documents, "doc_id", "text", byte_ranks(), public_tokenizers.PATTERN, decoded=True)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query("op9_sharding")
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    found = sharding.even_shards(documents, "doc_id", "text", size, 40, [crc])
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity_model(documents, table(spark, folder, "labels"))
    found = toxicity.score(documents, "doc_id", "text", model, threshold=0.7)
    held_out = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query("op11_packing")
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    definition = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(table(spark, folder, "documents"), "doc_id", "text", definition, end_id=1)
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def _cluster_sql(rounds: int) -> str:
    """Rounds of assignment and floor of the mean, over one row per component."""
    parts = []
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS (
  SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT v.vec_id, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance
    FROM v JOIN c{n} c ON c.i = v.i GROUP BY v.vec_id, c.cluster) GROUP BY vec_id
)""")
        if n < rounds:
            parts.append(f"""s{n} AS (
  SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{n} USING (vec_id) GROUP BY cluster, i
), c{n + 1} AS (
  SELECT c.cluster, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM c{n} c LEFT JOIN s{n} USING (cluster, i)
)""")
    return ", ".join(parts)


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT vec_id, unnest(range(1, 65)) AS i, CAST(unnest(list_transform(e, lambda x: floor(64 * x))) AS BIGINT) AS x FROM kept
), seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept
), c0 AS (
  SELECT cluster, i, x FROM v JOIN seeds USING (vec_id) WHERE cluster < 16
), {_cluster_sql(3)}, named AS (
  SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN named USING (cluster)
"""


@_query("op12_centroid_clusters", OP12_SQL)
def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, folder, "embeddings"), "vec_id", "embedding")


def _term_sql(source: str, key: str) -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all({lowered}, '{ranked_search.TERM}') AS t FROM {source} WHERE text IS NOT NULL"


OP13_SQL = f"""
WITH d AS ({_term_sql("documents", "doc_id")}), docs AS (
  SELECT row_number() OVER () AS r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0
), counts AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, counts GROUP BY term, n_docs
), i AS ({_term_sql("benchmark", "item_id")}), asked AS (
  SELECT DISTINCT item_id, unnest(t) AS term FROM i
), scores AS (
  SELECT item_id, docs.doc_id, docs.r,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (r), counts GROUP BY item_id, docs.doc_id, docs.r
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


@_query("op13_ranked_search", OP13_SQL)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    return ranked_search.ranked(table(spark, folder, "documents"), "doc_id", "text", items, "item_id", "text")
