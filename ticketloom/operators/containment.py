"""Which passages occur word for word in which documents.

Each passage is represented by one anchor, a run of its inner words, which any text that holds the passage holds too. A
passage of one or two words, which may begin or end inside a word, has characters as its anchor: the first of a single word,
or those around the gap. The anchors are joined with all such runs of the documents by hash, and only the rows that meet are
compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in an anchor; shorter passages have shorter ones.
ANCHOR_WORDS = 3
#: Characters in the anchor of a passage without inner words, on each side of a gap.
ANCHOR_LETTERS = 3
#: Characters of passages sent to all tasks; more are joined by a shuffle and compared in a second pass.
MOST_SENT = 32_000_000
_GAP = r"\s+"


def _runs(listed: DataFrame, width: int, *kept: str) -> DataFrame:
    """(kept, anchor): hashes of every run of ``width`` words of ``_words``.

    Only plain expressions, which Spark compiles together with the join that follows: otherwise every run would get a copy
    of its text.
    """
    words = F.col("_words")
    shifted = [F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))).alias(f"w{k}") for k in range(width)]
    runs = listed.select(*kept, F.inline_outer(F.arrays_zip(*shifted))).where(F.col(f"w{width - 1}").isNotNull())
    return runs.select(*kept, F.xxhash64(*[f"w{k}" for k in range(width)]).alias("anchor"))


def _anchors(passages: DataFrame) -> DataFrame:
    """(query_id, query_text, width, left, right, anchor): the run of inner words with the most characters. Without inner
    words, width 0 and the anchor of characters: ``left`` from the start of a single word, where ``right`` is NULL, or as many
    before and after a gap.

    The first and the last word may be cut out of longer ones in a document, so they are left out.
    """
    words = F.split("query_text", _GAP)
    inner = passages.where(F.length("query_text") > 0).withColumn("_w", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    width = F.least(F.size("_w"), F.lit(ANCHOR_WORDS))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - width + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.slice("_w", i, width))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(F.array_join(r, "")).alias("size"), r.alias("run"))))
    chosen = inner.withColumns({"width": width, "_run": longest["run"]})
    anchor = F.lit(None).cast("long")
    for k in range(1, ANCHOR_WORDS + 1):
        anchor = F.when(F.col("width") == k, F.xxhash64(*[F.get("_run", i) for i in range(k)])).otherwise(anchor)
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    left, right = F.least(F.length(first), F.lit(ANCHOR_LETTERS)), F.least(F.length(second), F.lit(ANCHOR_LETTERS))
    single = F.col("width").isNotNull() & (F.size(words) == 1)
    letters = F.when(single, F.xxhash64(F.substring(first, F.lit(1), left))).otherwise(_around_gap(first, second, left, right))
    short = F.col("width") == 0
    return chosen.select(
        "query_id", "query_text", "width", F.when(short, left).alias("left"), F.when(short & ~single, right).alias("right"),
        F.when(short, letters).otherwise(anchor).alias("anchor"),
    )


def _around_gap(first: Column, second: Column, left: Column, right: Column) -> Column:
    """Hash of the last ``left`` characters of a word and the first ``right`` of the next."""
    return F.xxhash64(F.substring(first, F.length(first) - left + 1, left), F.substring(second, F.lit(1), right))


def _letters(words: Column, left: int, right: int | None) -> Column:
    """The anchors of characters that a text offers, each once: all runs of ``left`` characters inside words, or those around
    its gaps."""
    if right is None:
        runs = F.transform(
            F.filter(words, lambda w: F.length(w) >= left),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.length(w) - (left - 1)), lambda i: F.xxhash64(F.substring(w, i, F.lit(left)))
            ),
        )
        return F.array_distinct(F.flatten(runs))
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.slice(F.arrays_zip(words.alias("a"), after.alias("b")), F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    wide = F.filter(pairs, lambda p: (F.length(p["a"]) >= left) & (F.length(p["b"]) >= right))
    return F.array_distinct(F.transform(wide, lambda p: _around_gap(p["a"], p["b"], F.lit(left), F.lit(right))))


def _offered(listed: DataFrame, width: int, left: int | None, right: int | None, *kept: str) -> DataFrame:
    """(kept, anchor): all anchors of one kind that the texts offer."""
    if width:
        return _runs(listed, width, *kept)
    # As a column of its own, or every anchor would get a copy of its text.
    anchors = listed.select(*kept, _letters(F.col("_words"), left, right).alias("_anchors"))
    return anchors.select(*kept, F.explode_outer("_anchors").alias("anchor")).where(F.col("anchor").isNotNull())


def contained_passages(docs: DataFrame, key: str, text: str, passages: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """(query_id, doc_id) for every passage (query_id, query_text) that occurs in a document.

    NULL and empty passages occur nowhere. Passages of up to ``most_sent`` characters in all are compared where the
    documents lie; more are joined on the anchor and then with the texts. Both ways give the same rows.
    """
    anchored = _anchors(passages)
    # One row per kind of anchor: at most 4 x 5 + 3.
    sizes = anchored.groupBy("width", "left", "right").agg(F.sum(F.length("query_text")).alias("n")).collect()
    listed = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), F.split(F.col(text), _GAP).alias("_words"))
    small = sum(r["n"] for r in sizes) <= most_sent
    found = []
    for width, left, right in sorted(((r["width"], r["left"], r["right"]) for r in sizes), key=repr):
        kind = (F.col("width") == width) & F.col("left").eqNullSafe(left) & F.col("right").eqNullSafe(right)
        mine = anchored.where(kind).drop("width", "left", "right")
        if small:
            runs = _offered(listed, width, left, right, "doc_id", "_text")
            met = runs.join(F.broadcast(mine), "anchor").where(F.contains("_text", "query_text"))
            found.append(met.select("query_id", "doc_id"))
        else:
            runs = _offered(listed, width, left, right, "doc_id")
            met = runs.join(mine.select("anchor", "query_id"), "anchor").select("query_id", "doc_id").distinct()
            texts = met.join(listed.select("doc_id", "_text"), "doc_id").join(mine.drop("anchor"), "query_id")
            found.append(texts.where(F.contains("_text", "query_text")).select("query_id", "doc_id"))
    if not found:
        ids = passages.schema["query_id"].dataType.simpleString(), docs.schema[key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"query_id {ids[0]}, doc_id {ids[1]}")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()
