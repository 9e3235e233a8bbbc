"""Benchmark items found inside documents: size-partitioned MinHash containment search in plain DataFrame operations.

An item is contained when at least the threshold share of its distinct five-word shingles occurs in a document. Items are
partitioned by size; an item of q shingles, of which at most m - 1 may be missing, is indexed by its 2m smallest hashes.
Any document that contains it holds at least m + 1 of these, whatever its own length, so the search misses nothing. What
passes is verified by the exact share of shingles, compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.id_filter import without
from ticketloom.sources.sinks import stored

WIDTH = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the index (24 bytes each) and characters of all shingles that are sent to all executors; a larger table is joined
#: by a shuffle.
MOST_SENT, MOST_SENT_TEXT = 2_000_000, 64_000_000


def words_of(text: Column) -> Column:
    """Words between white space (space, tab to carriage return), A-Z lowered; NULL gives none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, "[\\x09-\\x0D\\x20]+"), lambda w: w != "")


def _windows(words: Column) -> Column:
    """Every run of WIDTH words as a struct; a shorter text is one run."""
    shifted = [words.alias("w0")]
    shifted += [F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))).alias(f"w{k}") for k in range(1, WIDTH)]
    runs = F.greatest(F.size(words) - (WIDTH - 1), F.least(F.size(words), F.lit(1)))
    return F.slice(F.arrays_zip(*shifted), 1, runs)


def _exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the words w0 to w4 of every shingle of the column ``words``."""
    return rows.select(*keep, F.explode(_windows(F.col("words"))).alias("s")).select(*keep, "s.*")


def _hash() -> Column:
    return F.xxhash64(*[f"w{k}" for k in range(WIDTH)])


def _text() -> Column:
    return F.concat_ws(" ", *[f"w{k}" for k in range(WIDTH)])


def _needed(q: Column, percent: int) -> Column:
    return F.ceil(q * percent / 100).cast("int")


def _index(items: DataFrame, percent: int) -> DataFrame:
    """(item, h, q, least): the smallest hashes of every item, its size, and how many of them a document must hold."""
    hashed = items.select("item", _hash().alias("h")).distinct()
    sets = hashed.groupBy("item").agg(F.sort_array(F.collect_list("h")).alias("hashes"))
    sized = sets.withColumn("q", F.size("hashes"))
    spare = sized.withColumn("m", F.col("q") - _needed(F.col("q"), percent) + 1)
    cut = spare.withColumn("k", F.least(F.col("q"), 2 * F.col("m")))
    smallest = cut.select("item", "q", F.explode(F.slice("hashes", 1, F.col("k"))).alias("h"), "k", "m")
    return smallest.select("item", "h", "q", (F.col("k") - F.col("m") + 1).alias("least"))


def _sent(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table


def contained_items(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, percent: int = 75
) -> DataFrame:
    """(key, item_key, item_shingles, shared_shingles, containment) for every item inside a document.

    Shingles are runs of five words; a text of fewer words is one shingle of all its words, so a shorter item is found only
    as a whole text. Rows with NULL keys and texts without words take no part. Rows with equal keys are one document (or
    item) with the shingles of all of them. Empty tables give no rows. Other columns are not read. Whole texts are
    searched; no item, document or candidate is left out.
    """
    docs = documents.select(F.col(key).alias("doc"), words_of(F.col(text)).alias("words")).where("doc IS NOT NULL")
    wanted = items.select(F.col(item_key).alias("item"), words_of(F.col(item_text)).alias("words"))
    wanted = stored(_exploded(wanted.where("item IS NOT NULL"), "item"), "items")
    index = stored(_index(wanted, percent), "item-index")
    hits = _exploded(docs, "doc").select("doc", _hash().alias("h")).join(_sent(index, index.count() <= MOST_SENT), "h")
    found = hits.groupBy("doc", "item", "h").agg(F.first("least").alias("least"))
    counted = found.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least"))
    candidates = stored(counted.where("n >= least").select("doc", "item"), "candidates")

    sizes = stored(wanted.select("item", _text().alias("shingle")).distinct(), "item-shingles")
    few, letters = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("shingle") + 16), F.lit(0))).first()
    asked = docs.join(candidates.select("doc").distinct(), "doc", "left_semi")
    shingles = _exploded(asked, "doc").select("doc", _text().alias("shingle"))
    shared = shingles.join(_sent(sizes, letters <= MOST_SENT_TEXT), "shingle").select("doc", "item", "shingle").distinct()
    shares = shared.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("shared_shingles"))
    totals = sizes.groupBy("item").agg(F.count(F.lit(1)).alias("item_shingles"))
    exact = shares.join(candidates, ["doc", "item"]).join(_sent(totals, few <= MOST_SENT), "item")
    enough = F.col("shared_shingles") * 100 >= F.col("item_shingles") * percent
    return exact.where(enough).select(
        F.col("doc").alias(key),
        F.col("item").alias(item_key),
        "item_shingles",
        "shared_shingles",
        (F.col("shared_shingles") / F.col("item_shingles")).alias("containment"),
    )


def without_contaminated(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """The documents that contain no item; rows with a NULL key are kept."""
    found = contained_items(documents, key, text, items, item_key, item_text).select(key).distinct()
    return without(documents, key, stored(found, "contaminated"))
