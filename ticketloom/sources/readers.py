"""Scans of ticket, article and sample files."""

from __future__ import annotations

import functools
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import normalize as N
from ticketloom.functions import text as T
from ticketloom.sources import records

# The alternate column names per field, in order of preference.
CSV_ALIASES = {
    "external_id": ["id", "ticket_id", "ID"],
    "subject": ["subject", "title", "Subject"],
    "body": ["body", "description", "content", "Body"],
    "category": ["category", "type", "Category"],
    "priority": ["priority", "Priority", "severity"],
    "customer_id": ["customer_id", "user_id"],
    "customer_email": ["email", "customer_email"],
    "channel": ["channel", "source"],
    "status": ["status"],
    "created_at": ["created_at"],
}
JSON_ALIASES = {
    "external_id": ["id", "ticket_id"],
    "subject": ["subject", "title"],
    "body": ["body", "description", "content"],
    "category": ["category", "type"],
    "priority": ["priority", "severity"],
    "customer_id": ["customer_id", "user_id"],
    "customer_email": ["email", "customer_email"],
    "channel": ["channel", "source"],
    "status": ["status"],
    "created_at": ["created_at"],
}


def _tickets(df: DataFrame, aliases: dict[str, list[str]], field, compat: bool) -> DataFrame:
    """The common ticket columns; rows without subject and body are dropped. ``field`` gives an alias as a column or
    None where the input lacks it."""
    def pick(name: str) -> Column:
        found = [c for c in (field(a) for a in aliases[name]) if c is not None]
        return N.first_nonempty(*found)

    blank = F.lit("")
    out = df.select(
        pick("external_id").alias("external_id"),
        F.trim(F.coalesce(pick("subject"), blank)).alias("subject"),
        F.trim(F.coalesce(pick("body"), blank)).alias("body"),
        N.normalize_category(pick("category"), compat).alias("category"),
        N.normalize_priority(pick("priority"), compat).alias("priority"),
        *[pick(c).alias(c) for c in ("customer_id", "customer_email", "channel", "status")],
        F.try_to_timestamp(pick("created_at")).alias("created_at"),
    )
    return out.where((F.col("subject") != "") | (F.col("body") != ""))


def _field(names: list[str], name: str) -> Column:
    return F.col(f"c{names.index(name)}") if name in names else F.lit(None).cast("string")


def scan_ticket_csv(spark: SparkSession, path: str, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tickets of the CSV files below ``path``, and (file, error) for those that cannot be read. Every file has its own
    header; quoted fields may hold commas, quotes and line breaks; a large file is read by many tasks."""
    tables, errors = records.csv_records(spark, path)
    parts = []
    for names, table in tables:
        parts.append(_tickets(table, CSV_ALIASES, lambda a, names=names: _field(names, a), compat))
    if not parts:
        parts = [_tickets(spark.createDataFrame([], "file string"), CSV_ALIASES, lambda a: _field([], a), compat)]
    return functools.reduce(DataFrame.unionByName, parts), errors


def read_ticket_csv(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Tickets from CSV with a header; files that cannot be read are left out."""
    return scan_ticket_csv(spark, path, compat)[0]


def scan_ticket_json(spark: SparkSession, path: str, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tickets of the JSON files below ``path``, and (file, error) for those that give none. Every file is an array, a single
    object, or one object per line by itself; lines that are not JSON are skipped, and values that are not strings are read
    as their text."""
    items, errors = records.json_records(spark, path)
    return _tickets(items, JSON_ALIASES, lambda a: F.try_variant_get("item", f"$.{a}", "string"), compat), errors


def read_ticket_json(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Tickets from JSON files; files that give none are left out."""
    return scan_ticket_json(spark, path, compat)[0]


def read_ticket_lines(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Tickets from newline-delimited JSON, split by line, for files too large for one row."""
    items = spark.read.text(path).select(F.try_parse_json("value").alias("item"))
    items = items.where(F.schema_of_variant("item").startswith("OBJECT"))
    return _tickets(items, JSON_ALIASES, lambda a: F.try_variant_get("item", f"$.{a}", "string"), compat)


READERS = {
    "csv": read_ticket_csv,
    "json": read_ticket_json,
    "jsonl": read_ticket_lines,
    "ndjson": read_ticket_lines,
}


def read_tickets(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Tickets from a file by its suffix; an unknown suffix is an error."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"cannot read tickets from {path!r}: suffix must be one of {sorted(READERS)}")
    return READERS[suffix](spark, path, compat)


def scan_articles(spark: SparkSession, folder: str, pattern: str = "*.md") -> tuple[DataFrame, DataFrame]:
    """Articles from every file under a folder whose name fits ``pattern``, and (file, error) for files that are not UTF-8 or
    hold nothing; the others are read all the same."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .option("ignoreCorruptFiles", True).load(folder)
        .select(F.col("_metadata.file_path").alias("file"), F.col("content").cast("string").alias("text"))
    )
    bad = F.when(F.trim("text") == "", "is empty").when(~F.is_valid_utf8("text"), "is not UTF-8")
    errors = files.select("file", bad.alias("error")).where(F.col("error").isNotNull())
    good = files.where(bad.isNull()).select(F.col("file").alias("source_url"), F.element_at(F.split("file", "/"), -1).alias("_name"), "text")
    return parse_articles(good, "text", "_name").drop("text", "_name"), errors


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles from every ``*.md`` file under a folder; unreadable files are left out."""
    return scan_articles(spark, folder)[0]


def parse_articles(files: DataFrame, content: str, file_name: str) -> DataFrame:
    """Adds external_id, title, content, summary, category, tags and author to rows of Markdown text."""
    source = F.col("_source")  # the output column may have the name of the input column
    parsed = files.withColumn("_source", F.col(content)).withColumn("_matter", T.front_matter(source)).withColumn(
        "content", T.markdown_to_text(T.without_front_matter(source))
    )
    return parsed.withColumns(
        {
            "external_id": N.article_id(F.col(file_name)),
            "title": T.article_title(source, F.col(file_name)),
            "summary": T.summary(F.col("content")),
            "category": T.front_matter_value(F.col("_matter"), "category"),
            "tags": T.front_matter_tags(F.col("_matter")),
            "author": T.front_matter_value(F.col("_matter"), "author"),
        }
    ).drop("_matter", "_source")


def _documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one per line or one that fills a file, each file by itself."""
    kinds, _ = records.json_files(spark, path)
    files = kinds.where(F.col("kind") != records.BROKEN).collect()  # evaluation data: a file per run
    parts = []
    for by_line in (True, False):
        names = [unquote(f["file"]) for f in files if (f["kind"] == records.LINES) == by_line]
        if names:
            reader = spark.read.schema(schema) if schema else spark.read
            parts.append(reader.option("multiLine", not by_line).json(names))
    if not parts:
        raise ValueError(f"no JSON document below {path!r}")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_samples(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Rows of the array ``field`` of JSON documents, such as training_samples or test_samples: one document per line, or
    one that fills a file."""
    return _documents(spark, path).select(F.explode(field).alias("s")).select("s.*")


def read_relevance(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc_id) from {query, relevant_docs} objects, one per line or in a JSON array that fills a file."""
    pairs = _documents(spark, path, "query string, relevant_docs array<string>")
    return pairs.select("query", F.explode("relevant_docs").alias("doc_id"))
