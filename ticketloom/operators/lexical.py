"""Lexical index and ranked search for whole tables of queries.

Two scores are offered. ``fts_cover_rank`` is s / (s + 1) with s the class-weighted count of matching occurrences,
which is what cover density gives for a query whose terms are joined by OR. ``bm25`` is Okapi BM25.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import text as T
from ticketloom.operators import ranking
from ticketloom.operators.topk import BLOCK_CELLS, block_best, merge_best, rounded, rounded_column
from ticketloom.sources import sinks

#: Largest query side, in (query, term) rows, that is sent to every task. Larger ones are joined on the term.
MAX_SENT_TERMS = 500_000
K1, B = 1.2, 0.75


def without_stop_words(tokens: Column, stop_words: list[str] | None = None) -> Column:
    words = vocab.STOP_WORDS if stop_words is None else stop_words
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def query_terms(queries: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """(query_id, term): distinct terms per query. A query without terms has no rows and finds nothing."""
    terms = without_stop_words(T.query_terms(F.col(text)), stop_words)
    return queries.select(F.col(key).alias("query_id"), F.explode(terms).alias("term"))


def term_counts(df: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """(keys, term, tf). Terms are counted inside the row - sort, then measure the runs - so nothing is shuffled."""
    sorted_tokens = df.where(F.size(tokens) > 0).select(*keys, F.sort_array(tokens).alias("_s"))
    n = F.size("_s")
    starts = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.element_at("_s", i) != F.element_at("_s", F.greatest(i - 1, F.lit(1)))),
    )
    runs = sorted_tokens.select(*keys, "_s", starts.alias("_at"))
    entries = F.transform(
        "_at",
        lambda i, j: F.struct(
            F.element_at("_s", i).alias("term"), (F.coalesce(F.get("_at", j + 1), n + 1) - i).alias("tf")
        ),
    )
    return runs.select(*keys, F.inline(entries))


def postings(df: DataFrame, key: str, fields: dict[str, str], stop_words: list[str] | None = None) -> DataFrame:
    """(key, weight_class, term, tf): the lexical index. ``fields`` maps a class A-D to a text column."""
    parts = [
        F.struct(F.lit(cls).alias("weight_class"), without_stop_words(T.tokens(F.col(c)), stop_words).alias("tokens"))
        for cls, c in fields.items()
    ]
    return term_counts(df.select(key, F.inline(F.array(*parts))), [key, "weight_class"], "tokens")


def tfidf(
    df: DataFrame, key: str, tokens: Column, min_df: int = 2, max_df: float = 0.95, max_features: int = 10_000
) -> DataFrame:
    """(key, term, tf, df, idf, weight) of every row's tokens, scaled to unit length; idf = ln((1 + n) / (1 + df)) + 1.

    The vocabulary is the ``max_features`` most frequent terms with min_df <= df <= max_df * n (ties by term). It is sent to
    the tasks, which weigh a row and its length where it lies; only the counts of terms are shuffled, summed up in the tasks
    first.
    """
    rows = df.select(key, tokens.alias("_tokens"))
    counted = term_counts(rows.select("_tokens"), [], "_tokens")
    frequent = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    n = rows.count()
    kept = frequent.where((F.col("df") >= min_df) & (F.col("df") <= n * max_df))
    vocabulary = kept.orderBy(F.col("total").desc(), "term").limit(max_features).toArrow()
    terms, df_of = vocabulary["term"].combine_chunks(), vocabulary["df"].to_numpy()
    idf = np.log((1 + n) / (1 + df_of)) + 1
    sent = df.sparkSession.sparkContext.broadcast((terms, df_of, idf))

    def run(batches):
        terms, df_of, idf = sent.value
        for batch in batches if len(terms) else ():
            row, term, count = _matches(batch.column(1), terms)
            value = count * idf[term]
            length = np.sqrt(np.bincount(row, value * value, batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)), terms.take(pa.array(term)), pa.array(count.astype(np.int32)),
                    pa.array(df_of[term]), pa.array(idf[term]), pa.array(value / length[row]),
                ],
                [key, "term", "tf", "df", "idf", "weight"],
            )

    kind = _type(df, key)
    return rows.mapInArrow(run, f"`{key}` {kind}, term string, tf int, df long, idf double, weight double")


def _pack(rows: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The query side as arrays: query ids, distinct terms with idf, and for each term where its queries start in the
    last array."""
    coded = rows["term"].combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ids, query_pos = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    n_terms = len(coded.dictionary)
    idf = np.ones(n_terms)
    idf[codes] = rows["idf"].to_numpy()
    first = np.searchsorted(codes[order], np.arange(n_terms + 1))
    return ids, coded.dictionary, idf, first, query_pos[order]


def _matches(tokens: pa.ListArray, terms: pa.Array):
    """(row, term number, count) of the query terms in a column of token lists."""
    offsets = tokens.offsets.to_numpy()
    flat = tokens.values.slice(offsets[0], offsets[-1] - offsets[0])
    found = pc.index_in(flat, value_set=terms)
    hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    term = found.drop_null().to_numpy().astype(np.int64)
    row = np.searchsorted(offsets - offsets[0], hit, side="right") - 1
    cell, count = np.unique(row * len(terms) + term, return_counts=True)
    return cell // len(terms), cell % len(terms), count


def _membership(first: np.ndarray, queries: np.ndarray, n_queries: int) -> np.ndarray | None:
    """Terms x queries as a 0/1 matrix, or None where that would be too large."""
    n_terms = len(first) - 1
    if n_terms * n_queries > BLOCK_CELLS:
        return None
    out = np.zeros((n_terms, n_queries))
    out[np.repeat(np.arange(n_terms), np.diff(first)), queries] = 1.0
    return out


def _add_scores(scores, row, term, value, first, queries, member):
    """Adds the value of each (row, term) to every query that holds the term."""
    if member is not None:
        held = np.zeros((len(scores), len(member)))
        held[row, term] = value
        scores += held @ member
        return
    # Too many terms for a matrix: spell out (row, query) pairs, a bounded number at a time.
    repeat = np.diff(first)[term]
    upto = np.cumsum(repeat)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_CELLS, side="right")))
        part, times = slice(at, stop), repeat[at:stop]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        query = queries[np.repeat(first[term[part]], times) + within]
        cells = np.repeat(row[part], times) * scores.shape[1] + query
        scores += np.bincount(cells, np.repeat(value[part], times), minlength=scores.size).reshape(scores.shape)
        at = stop


def _score_batches(batches, sent, weights, average_length, k, min_score, exclude_self):
    """Per task: score blocks of documents against all queries, keep the k best per query."""
    query_ids, terms, idf, first, queries = sent
    n_queries = len(query_ids)
    member = _membership(first, queries, n_queries)
    block = max(1, BLOCK_CELLS // max(1, n_queries + (len(terms) if member is not None else 0)))
    best = None
    for batch in batches if n_queries else ():
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            keys = part.column(0).to_numpy(zero_copy_only=False)
            scores = np.zeros((part.num_rows, n_queries))
            for i, weight in enumerate(weights):
                row, term, count = _matches(part.column(2 + i), terms)
                if average_length is None:
                    value = count * weight
                else:
                    length = part.column(1).to_numpy(zero_copy_only=False)[row]
                    value = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / average_length))
                _add_scores(scores, row, term, value, first, queries, member)
            if average_length is None:
                scores = scores / (scores + 1)
            scores = rounded(scores)
            row, query = block_best(scores, keys, k + 1 if exclude_self else k)
            key, score = keys[row], scores[row, query]
            keep = score > min_score
            if exclude_self:
                keep &= query_ids[query] != key
            best = merge_best(best, query[keep], score[keep], key[keep], k)
    if best is not None and len(best[0]):
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[best[0]]), pa.array(best[2]), pa.array(best[1])], ["query_id", "doc_id", "score"]
        )


def document_frequencies(terms: DataFrame, docs: DataFrame, tokens: str) -> DataFrame:
    """(term, df, total): documents holding each query term; the row of the empty term counts all documents and all
    their tokens.

    One pass over the corpus. Only query terms are counted, and the counts combine on the map side, so the shuffle
    carries at most one row per query term and task.
    """
    marker = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    wanted = terms.select("term").distinct().unionByName(marker)
    every = F.array_insert(F.array_distinct(tokens), 1, F.lit(""))
    seen = docs.select(F.explode(every).alias("term"), F.size(tokens).alias("length"))
    return (
        seen.join(wanted, "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("length"))).alias("total"))
    )


def _count_batches(batches, terms):
    """Per task: documents holding each term, and under the empty term all documents and all their tokens."""
    df, documents, total = np.zeros(len(terms), np.int64), 0, 0
    for batch in batches:
        documents += batch.num_rows
        total += len(batch.column(0).flatten())
        if len(terms):
            _, term, _ = _matches(batch.column(0), terms)
            df += np.bincount(term, minlength=len(terms))
    if documents:
        seen = np.flatnonzero(df)
        words = terms.take(pa.array(seen)).to_pylist() + [""]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words), pa.array(np.r_[df[seen], documents]), pa.array(np.r_[np.zeros(len(seen), np.int64), total])],
            ["term", "df", "total"],
        )


def sent_document_frequencies(terms: pa.Array, docs: DataFrame, tokens: str) -> DataFrame:
    """``document_frequencies`` with the query terms sent to every task, which returns one row per term it saw."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    parts = docs.select(tokens).mapInArrow(
        lambda batches: _count_batches(batches, sent.value), "term string, df long, total long"
    )
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _idf(df, n_docs):
    return 1 + (n_docs - df + 0.5) / (df + 0.5)


def _fits(terms: DataFrame, max_sent: int) -> bool:
    return terms.limit(max_sent + 1).count() <= max_sent


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _search_sent(
    docs: DataFrame, key: str, token_columns: list[str], weights: list[float], length: Column, terms: pa.Table,
    query_type: str, average_length: float | None, k: int, min_score: float, exclude_self: bool,
) -> DataFrame:
    """Hits with the query side (query_id, term, idf) sent to every task; the corpus stays where it is."""
    sent = docs.sparkSession.sparkContext.broadcast(_pack(terms))

    def run(batches):
        return _score_batches(batches, sent.value, weights, average_length, k, min_score, exclude_self)

    schema = f"query_id {query_type}, doc_id {_type(docs, key)}, score double"
    hits = docs.select(key, length.alias("_length"), *token_columns).mapInArrow(run, schema)
    return ranking.rank_hits(hits, "query_id", k, F.col("score").desc(), F.col("doc_id"))


def _search_joined(
    docs: DataFrame, key: str, token_columns: list[str], weights: list[float], length: Column, terms: DataFrame,
    average_length: float | None, k: int, min_score: float, exclude_self: bool,
) -> DataFrame:
    """The same hits by a join on the term, for a query side of any size. AQE splits frequent terms."""
    parts = [F.struct(F.lit(float(w)).alias("w"), F.col(c).alias("tokens")) for w, c in zip(weights, token_columns)]
    rows = docs.select(F.col(key).alias("doc_id"), length.alias("_length"), F.inline(F.array(*parts)))
    hits = term_counts(rows, ["doc_id", "_length", "w"], "tokens").join(terms, "term")
    if exclude_self:
        hits = hits.where(F.col("query_id") != F.col("doc_id"))
    if average_length is None:
        total = F.sum(F.col("tf") * F.col("w"))
        score = total / (total + 1)
    else:
        damp = F.col("tf") + K1 * (1 - B + B * F.col("_length") / average_length)
        score = F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / damp)
    scored = hits.groupBy("query_id", "doc_id").agg(rounded_column(score).alias("score"))
    return ranking.rank_hits(
        scored.where(F.col("score") > min_score), "query_id", k, F.col("score").desc(), F.col("doc_id")
    )


def bm25_search(
    docs: DataFrame, key: str, text: Column, queries: DataFrame, query_key: str, query_text: str, k: int = 10,
    min_score: float = 0.0, exclude_self: bool = False, stop_words: list[str] | None = None,
    max_sent: int = MAX_SENT_TERMS,
) -> DataFrame:
    """Top k documents per query by Okapi BM25 (k1 = 1.2, b = 0.75): (query_id, doc_id, score, rank).

    idf = ln(1 + (n - df + 0.5) / (df + 0.5)). One pass counts document frequencies of the query terms, one pass scores.
    With a query side within ``max_sent`` rows each task keeps its own k best per query, so the corpus is never
    shuffled.
    """
    tokenised = docs.select(key, T.tokens(text).alias("_tokens"))
    terms = query_terms(queries, query_key, query_text, stop_words)
    where = (tokenised, key, ["_tokens"], [1.0], F.size("_tokens"))
    limits = (k, min_score, exclude_self)
    if _fits(terms, max_sent):
        asked = terms.toArrow()
        words = asked["term"].combine_chunks().unique()
        found = sent_document_frequencies(words, tokenised, "_tokens").toArrow()
        known = found["term"].to_pylist()
        every = known.index("") if "" in known else None
        if every is None:
            return _search_sent(*where, asked.slice(0, 0).append_column("idf", pa.array([], pa.float64())),
                                _type(terms, "query_id"), 1.0, *limits)
        n_docs, total = found["df"][every].as_py(), found["total"][every].as_py()
        place = pc.index_in(asked["term"], value_set=found["term"].combine_chunks())
        asked = asked.append_column("at", place).filter(pc.is_valid(place))
        idf = np.log(_idf(found["df"].to_numpy(), n_docs))[asked["at"].to_numpy()]
        asked = asked.drop_columns(["at"]).append_column("idf", pa.array(idf))
        return _search_sent(*where, asked, _type(terms, "query_id"), (total / n_docs) or 1.0, *limits)
    counts = sinks.stored(document_frequencies(terms, tokenised, "_tokens"), "document-frequencies")
    every = counts.where(F.col("term") == "").first()
    n_docs, mean = (every["df"], every["total"] / every["df"]) if every else (0, 1.0)
    weighted = terms.join(counts.select("term", F.log(_idf(F.col("df"), F.lit(n_docs))).alias("idf")), "term")
    return _search_joined(*where, weighted, mean or 1.0, *limits)


def cover_rank_search(
    docs: DataFrame, key: str, fields: dict[str, Column], queries: DataFrame, query_key: str, query_text: str,
    k: int = 5, min_score: float = 0.0, exclude_self: bool = False, stop_words: list[str] | None = None,
    max_sent: int = MAX_SENT_TERMS,
) -> DataFrame:
    """Top k documents per query by ``fts_cover_rank``: (query_id, doc_id, score, rank).

    ``fields`` maps a weight class A-D to a text. Only scores above ``min_score`` count, so a document without any
    query term is never a hit.
    """
    names = [f"_tokens_{cls}" for cls in fields]
    tokenised = docs.select(key, *[T.tokens(text).alias(n) for n, text in zip(names, fields.values())])
    terms = query_terms(queries, query_key, query_text, stop_words).withColumn("idf", F.lit(1.0))
    where = (tokenised, key, names, [vocab.CLASS_WEIGHTS[cls] for cls in fields], F.lit(0))
    limits = (k, min_score, exclude_self)
    if _fits(terms, max_sent):
        return _search_sent(*where, terms.toArrow(), _type(terms, "query_id"), None, *limits)
    return _search_joined(*where, terms, None, *limits)


def search_articles(articles: DataFrame, queries: DataFrame, k: int = 5, category: str | None = None, **options) -> DataFrame:
    """Published articles by cover rank: title class A, content class B."""
    listed = articles.where(F.col("status") == "published")
    if category is not None:
        listed = listed.where(F.col("category") == category)
    return cover_rank_search(
        listed, "article_id", {"A": F.col("title"), "B": F.col("content")}, queries, "query_id", "query_text", k, **options
    )


def search_tickets(
    tickets: DataFrame, queries: DataFrame, k: int = 5, category: str | None = None, resolved_only: bool = True, **options
) -> DataFrame:
    """Similar past tickets by cover rank: subject class A, body class B; a ticket never finds itself."""
    listed = tickets.where(F.col("status").isin(*vocab.RESOLVED_STATUSES)) if resolved_only else tickets
    if category is not None:
        listed = listed.where(F.col("category") == category)
    return cover_rank_search(
        listed, "ticket_id", {"A": F.col("subject"), "B": F.col("body")}, queries, "query_id", "query_text", k,
        exclude_self=options.pop("exclude_self", True), **options,
    )


def combined_search(
    articles: DataFrame, tickets: DataFrame, queries: DataFrame, kb_k: int = 3, ticket_k: int = 2, **options
) -> DataFrame:
    """The best articles and the best tickets per query, tagged by ``source_type``."""
    kb = search_articles(articles, queries, kb_k).withColumn("source_type", F.lit("kb_chunk"))
    past = search_tickets(tickets, queries, ticket_k, **options).withColumn("source_type", F.lit("ticket"))
    return kb.unionByName(past)
