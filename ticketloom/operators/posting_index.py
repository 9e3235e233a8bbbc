"""A lexical index on disk, and ranked search that reads only the blocks it needs.

``write_postings`` deals the documents of a table to segments of bounded size by the hash of their key. A block holds the
postings of one term in one segment, and with them the most that any of its documents can gain from the term. The blocks
of a segment lie together in order of term, so a search for some terms skips pages by their statistics, and an index is
written where its segments are made: no posting is dealt or sorted again. A posting holds numbers only: its class and its
payload by their place among the classes and among the segment's values, which are stored once per segment.

Many queries over few segments read the blocks of their terms once. With more segments a search goes in two phases. The blocks' bounds alone, without their postings, give the most that any
document of a segment can score for a query. First each query's most promising segment is scored; its k-th hit is a limit
that the k-th best document reaches at least. Then only the segments whose bound reaches the limit are read. What is left
out cannot be among the k best, so the hits are those of a search through everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ticketloom import vocab
from ticketloom.functions import stemming
from ticketloom.functions import text as T
from ticketloom.operators import lexical, ranking
from ticketloom.operators.topk import BLOCK_CELLS, DIGITS, block_best, merge_best, rounded, rounded_column
from ticketloom.sources import sinks

DOCS_PER_SEGMENT = 4096
#: Up to this many segments in all, or per query, are scored at once, without a first phase. The first phase alone reads a
#: segment per query, and a segment is read whole if it may hold a hit of any query.
ONE_PHASE_SEGMENTS, SEGMENTS_PER_QUERY = 16, 8
#: Up to this many terms go to the scan as a condition; Spark hands at most ten values of a list to the file reader.
MOST_PUSHED_TERMS, TERMS_PER_LIST = 2_000, 10
COVER, OKAPI = "cover", "okapi"


@dataclass(frozen=True)
class PostingIndex:
    """A written index. ``fields`` are its weight classes, ``payload`` the attributes that a search may ask for; a ``stemmed``
    one holds English stems in place of tokens."""

    spark: SparkSession
    path: str
    n_docs: int
    n_tokens: int
    segments: int
    fields: tuple[str, ...]
    payload: tuple[str, ...]
    stemmed: bool = False

    @property
    def blocks(self) -> DataFrame:
        """A row per term and segment, the classes and payloads of its postings by their values."""
        return self._named(self._numbered(), self.payload)

    def _stored(self) -> DataFrame:
        """The rows of the files; one of each segment has no term. It counts the documents and their tokens, and holds the
        distinct values of each payload, at whose places postings point."""
        return self.spark.read.parquet(f"{self.path}/blocks")

    def _numbered(self) -> DataFrame:
        return self._bounded(self._stored().where(F.col("term").isNotNull()))

    def _named(self, blocks: DataFrame, payload: tuple[str, ...]) -> DataFrame:
        """Blocks with the classes and these payloads by their values, without the other payloads."""
        blocks = blocks.drop(*[f"payload_{p}" for p in self.payload if p not in payload])
        if payload:
            blocks = blocks.join(self._values(payload), "segment")
        at = lambda values: lambda place: F.element_at(values, place + 1)
        names = F.array(*[F.lit(c) for c in self.classes])
        named = {f"payload_{p}": F.transform(f"payload_{p}", at(F.col(f"values_{p}"))) for p in payload}
        return blocks.withColumns({"classes": F.transform("classes", at(names)), **named}).drop(*[f"values_{p}" for p in payload])

    def _values(self, payload) -> DataFrame:
        """A row per segment: the distinct values of the payloads."""
        return self._stored().where(F.col("term").isNull()).select("segment", *[f"values_{p}" for p in payload])

    @property
    def classes(self) -> list[str]:
        """The weight classes in the order of their numbers."""
        return sorted(self.fields)

    def _bounded(self, stored: DataFrame) -> DataFrame:
        mean = self.average_length
        if len(self.fields) == 1:
            share = lexical.K1 * (1 - lexical.B) / F.col("most") + lexical.K1 * lexical.B * F.col("least") / mean
            bound = (lexical.K1 + 1) / (1 + share)
        else:  # the counts of one document's fields add up
            bound = _okapi(F.col("most"), F.col("shortest"), mean)
        unused = ["n_tokens", "most", "shortest", "least", *[f"values_{p}" for p in self.payload]]
        return stored.withColumn("most_okapi", bound).drop(*unused)

    @property
    def average_length(self) -> float:
        return (self.n_tokens / self.n_docs if self.n_docs else 0.0) or 1.0

    def blocks_of(self, terms: list[str]) -> DataFrame:
        """The blocks of these terms, classes and payloads by number, by conditions that reach the file reader; of more terms
        all blocks."""
        if len(terms) > MOST_PUSHED_TERMS:
            return self._numbered()
        wanted, ordered = F.lit(False), sorted(terms)
        for at in range(0, len(ordered), TERMS_PER_LIST):
            wanted = wanted | F.col("term").isin(*ordered[at : at + TERMS_PER_LIST])
        return self._bounded(self._stored().where(wanted))

    def postings(self) -> DataFrame:
        """(key, weight_class, term, tf): the index as rows."""
        entries = F.arrays_zip("keys", "classes", "tfs")
        rows = self._numbered().select("term", F.explode(entries).alias("e"))
        weight_class = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("e.classes") + 1)
        return rows.select(F.col("e.keys").alias("key"), weight_class.alias("weight_class"), "term", F.col("e.tfs").alias("tf"))


def _okapi(tf: Column, length: Column, average_length: float) -> Column:
    return tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * length / average_length))


def _segment_blocks(table: pa.Table, classes: list[str], payload: list[str], stop_words: list[str]) -> pa.Table:
    """A row per term of a segment's documents (segment, key, payload, line of tokens by class), in order of term, its
    postings in order of key and class; before them a row without a term that counts the documents and their tokens and
    holds the values of the payload."""
    keys = table["key"].combine_chunks()
    place = np.full(len(keys), -1)
    there = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
    if len(there):
        place[there] = _distinct(keys.take(pa.array(there)))[1]
    order = np.argsort(place, kind="stable")
    place, n, kinds = place[order], table.num_rows, len(classes)
    lists = [pc.split_pattern(table[f"_{c}"].combine_chunks(), " ") for c in classes]
    coded = pa.concat_arrays([v.flatten() for v in lists]).dictionary_encode()
    by_term = pc.sort_indices(coded.dictionary).to_numpy()
    terms = coded.dictionary.take(pa.array(by_term))
    number = np.empty(len(by_term), np.int64)
    number[by_term] = np.arange(len(by_term))
    sizes = [pc.list_value_length(v).to_numpy() for v in lists]
    ranked = np.empty(n, np.int64)  # of a row of the table, in order of key
    ranked[order] = np.arange(n)
    doc = np.concatenate([np.repeat(ranked, s) for s in sizes])
    kind = np.repeat(np.arange(kinds), [s.sum() for s in sizes])
    code = number[coded.indices.to_numpy(zero_copy_only=False)]
    word = pc.not_equal(terms, "").to_numpy(zero_copy_only=False)  # lines may begin or end with a gap
    if "length" in table.column_names:
        long = table["length"].to_numpy()[order]
    else:
        long = np.bincount(doc[word[code]], minlength=n).astype(np.int32)
    word &= ~pc.is_in(terms, value_set=pa.array(stop_words, pa.string())).to_numpy(zero_copy_only=False)
    kept = word[code]
    cell, tf = np.unique((code[kept] * n + doc[kept]) * kinds + kind[kept], return_counts=True)
    code, doc, kind = cell // (n * kinds), cell // kinds % n, cell % kinds
    length = long[doc]
    if (place[1:] == place[:-1]).any():  # keys that repeat
        again = np.lexsort((length, tf, kind, place[doc], code))
        code, doc, kind, tf, length = code[again], doc[again], kind[again], tf[again], length[again]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    # The first row has no postings.
    offsets = pa.array(np.r_[0, starts, len(code)].astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(offsets, values)
    reduced = lambda pick, values: np.r_[0, pick.reduceat(values, starts) if len(starts) else values[:0]]
    met = place[doc]
    fresh = np.r_[True, (code[1:] != code[:-1]) | (met[1:] != met[:-1])][: len(code)]
    n_docs, n_tokens = reduced(np.add, fresh.astype(np.int64)), np.zeros(len(starts) + 1, np.int64)
    n_docs[0], n_tokens[0] = n, long.sum(dtype=np.int64)
    taken = order[doc]
    coded = {p: table[p].combine_chunks().dictionary_encode("encode") for p in payload}
    numbers = {p: c.indices.to_numpy(zero_copy_only=False)[taken].astype(np.int32) for p, c in coded.items()}
    # Rows of blocks have no values.
    once = pa.array(np.r_[False, np.ones(len(starts), bool)])
    values = lambda p: pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.full(len(starts) + 1, len(coded[p].dictionary))].astype(np.int32)), coded[p].dictionary, mask=once
    )
    columns = {
        "term": pa.concat_arrays([pa.nulls(1, terms.type), terms.take(pa.array(code[starts]))]),
        "segment": table["segment"].combine_chunks().take(pa.array(np.zeros(len(starts) + 1, np.int64))),
        "n_docs": pa.array(n_docs.astype(np.int32)),
        "n_tokens": pa.array(n_tokens),
        **{f"most_{c}": pa.array(reduced(np.maximum, np.where(kind == i, tf, 0)).astype(np.int32)) for i, c in enumerate(classes)},
        "shortest": pa.array(reduced(np.minimum, length).astype(np.int32)),
        "least": pa.array(reduced(np.minimum, length / tf).astype(np.float64)),
        "class": listed(pa.array(kind.astype(np.int8))),
        "tf": listed(pa.array(tf.astype(np.int32))),
        "length": listed(pa.array(length)),
        "key": listed(table["key"].combine_chunks().take(pa.array(taken))),
        **{p: listed(pa.array(numbers[p])) for p in payload},
        **{f"{p}_values": values(p) for p in payload},
    }
    return pa.Table.from_arrays(list(columns.values()), list(columns))


def write_postings(
    df: DataFrame, key: Column, fields: dict[str, Column], path: str, payload: tuple[str, ...] = (),
    stop_words: list[str] | None = None, docs_per_segment: int = DOCS_PER_SEGMENT, stemmed: bool = False,
) -> PostingIndex:
    """Writes the index of ``df`` to a new folder. ``fields`` maps a weight class A-D to a text, ``payload`` names columns
    whose values are stored once per segment; each posting holds the place of its own.

    Every row counts as a document; a NULL text has no tokens. With ``stemmed``, tokens that are not stop words are stemmed,
    and so are the terms of searches. The texts are read once, after a count of the rows. The tokens of a document go to its
    segment, whose blocks one task makes from at most about ``docs_per_segment`` documents, counts and writes. A term that a
    third of all documents hold has a block per segment, on as many tasks as there are.
    """
    spark = df.sparkSession
    classes = list(fields)
    segments = max(1, -(-df.count() // docs_per_segment))

    kept = [F.col(p).cast("string").alias(f"_p{i}") for i, p in enumerate(payload)]
    segment = F.pmod(F.xxhash64("key"), F.lit(segments)).cast("long")
    coded = [f"_p{i}" for i in range(len(payload))]
    held = ["key", *coded]
    dropped = vocab.STOP_WORDS if stop_words is None else stop_words
    if stemmed:  # only words that are not dropped are stemmed
        docs = df.select(key.alias("key"), *kept, *[T.tokens(text).alias(f"_{cls}") for cls, text in fields.items()])
        length = sum((F.size(f"_{c}") for c in classes), F.lit(0)).cast("int").alias("length")
        stems = [stemming.stems(lexical.without_stop_words(F.col(f"_{c}"), stop_words)).alias(f"_{c}") for c in classes]
        docs = docs.select(segment.alias("segment"), *held, length, *stems)
        docs = docs.withColumns({f"_{c}": F.array_join(f"_{c}", " ") for c in classes})
        dropped = []
    else:
        docs = df.select(key.alias("key"), *kept, *[T.token_line(text).alias(f"_{cls}") for cls, text in fields.items()])
        docs = docs.select(segment.alias("segment"), *held, *[f"_{c}" for c in classes])
    numbers = "".join(f", {c} array<int>" for c in coded) + "".join(f", {c}_values array<string>" for c in coded)
    most = "".join(f"most_{c} int, " for c in sorted(classes))
    schema = (
        f"term string, segment long, n_docs int, n_tokens long, {most}shortest int, least double, class array<tinyint>, "
        f"tf array<int>, length array<int>, key array<{docs.schema['key'].dataType.simpleString()}>{numbers}"
    )
    docs = docs.repartition(segments, "segment")  # not merged to a few tasks: the work is in the blocks, not in the texts
    blocks = docs.groupBy("segment").applyInArrow(lambda table: _segment_blocks(table, sorted(classes), coded, dropped), schema)
    blocks = blocks.select(
        "term", "segment", "n_docs", "n_tokens",
        sum((F.col(f"most_{c}") * vocab.CLASS_WEIGHTS[c] for c in classes), F.lit(0.0)).alias("most_cover"),
        sum((F.col(f"most_{c}") for c in classes), F.lit(0)).alias("most"), "shortest", "least",
        F.col("key").alias("keys"), F.col("class").alias("classes"), F.col("tf").alias("tfs"),
        F.col("length").alias("lengths"), *[F.col(f"_p{i}").alias(f"payload_{p}") for i, p in enumerate(payload)],
        *[F.col(f"_p{i}_values").alias(f"values_{p}") for i, p in enumerate(payload)],
    )
    blocks.write.mode("errorifexists").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").where(F.col("term").isNull())
    counts = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n_docs", "n_tokens")]
    n_docs, n_tokens = sizes.agg(*counts).first()
    index = PostingIndex(spark, path, n_docs, n_tokens, segments, tuple(classes), tuple(payload), stemmed)
    totals = [(n_docs, n_tokens, segments, list(classes), list(payload), stemmed)]
    schema = "n_docs long, n_tokens long, segments long, fields array<string>, payload array<string>, stemmed boolean"
    spark.createDataFrame(totals, schema).coalesce(1).write.mode("errorifexists").parquet(f"{path}/totals")
    return index


def open_postings(spark: SparkSession, path: str) -> PostingIndex:
    """An index that was written before."""
    row = spark.read.parquet(f"{path}/totals").first()
    return PostingIndex(spark, path, row["n_docs"], row["n_tokens"], row["segments"], tuple(row["fields"]), tuple(row["payload"]), row["stemmed"])


def _distinct(keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct keys in ascending order, and the place of every key among them; structs are ordered by their fields."""
    if not pa.types.is_struct(keys.type):
        coded = keys.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]
    rows = [tuple(k.values()) for k in keys.to_pylist()]
    places = {k: i for i, k in enumerate(sorted(set(rows)))}
    first = dict(zip(reversed(rows), range(len(rows) - 1, -1, -1)))
    return keys.take(pa.array([first[k] for k in places], pa.int64())), np.array([places[r] for r in rows], np.int64)


def _allowed(table: pa.Table, where: dict[str, list[str]], n: int) -> np.ndarray:
    keep = np.ones(n, dtype=bool)
    for name in where:  # all blocks of a segment hold the same numbers of allowed values
        numbers = table[f"allowed_{name}"][0].values.to_numpy()
        keep &= np.isin(pc.list_flatten(table[f"payload_{name}"]).to_numpy(), numbers)
    return keep


def _score_segment(
    table: pa.Table, alive: pa.Array | None, sent, score: str, weights: np.ndarray, average_length: float, where: dict, k: int,
    min_score: float, exclude_self: bool, names: list[str],
) -> pa.Table | None:
    """The k best documents of a segment per query; of all queries, or of those in ``alive``."""
    query_ids, terms, idf, first, queries = sent
    n_queries = len(query_ids)
    code = pc.index_in(table["term"].combine_chunks(), value_set=terms)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(table["keys"]).to_numpy()
    term = np.repeat(np.where(known, code.fill_null(0).to_numpy(zero_copy_only=False), -1), sizes)
    keep = _allowed(table, where, len(term)) & (term >= 0)
    distinct, row = _distinct(pc.list_flatten(table["keys"]).combine_chunks().filter(pa.array(keep)))
    if not len(row):
        return None
    term = term[keep].astype(np.int64)
    tf = pc.list_flatten(table["tfs"]).to_numpy()[keep].astype(np.float64)
    # One value per document and term, whatever the fields.
    cell, at, which = np.unique(row * len(terms) + term, return_index=True, return_inverse=True)
    row, term = cell // len(terms), cell % len(terms)
    if score == COVER:
        value = np.bincount(which, tf * weights[pc.list_flatten(table["classes"]).to_numpy()[keep]])
    else:
        length = pc.list_flatten(table["lengths"]).to_numpy()[keep][at]
        tf = np.bincount(which, tf)
        value = idf[term] * tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * length / average_length))
    asked = np.ones(n_queries, dtype=bool) if alive is None else np.isin(query_ids, alive.to_numpy(zero_copy_only=False))
    member = lexical._membership(first, queries, n_queries)
    step = max(1, BLOCK_CELLS // max(1, n_queries + (len(terms) if member is not None else 0)))
    best = None
    for low in range(0, len(distinct), step):
        a, b = np.searchsorted(row, [low, low + step])
        n = min(step, len(distinct) - low)
        scores = np.zeros((n, n_queries))
        lexical._add_scores(scores, row[a:b] - low, term[a:b], value[a:b], first, queries, member)
        if score == COVER:
            scores = scores / (scores + 1)
        scores = rounded(scores)
        scores[:, ~asked] = 0.0
        place = np.arange(low, low + n)
        at, query = block_best(scores, place, k + 1 if exclude_self else k)
        found, hit = scores[at, query], place[at]
        keep = (found > min_score) & (found > 0)
        if exclude_self:
            keep &= query_ids[query] != distinct.take(pa.array(hit)).to_numpy(zero_copy_only=False)
        best = merge_best(best, query[keep], found[keep], hit[keep], k)
    if best is None or not len(best[0]):
        return None
    return pa.Table.from_arrays(
        [pa.array(query_ids[best[0]]), distinct.take(pa.array(best[2])), pa.array(best[1])], names=names
    )


class _Search:
    """One search whose query side is sent to the tasks."""

    def __init__(self, index: PostingIndex, asked: pa.Table, score: str, k: int, min_score: float, exclude_self: bool, where: dict):
        self.index, self.score, self.k = index, score, k
        spark = index.spark
        words = asked["term"].combine_chunks().unique()
        self.words = words.to_pylist()
        self.read = index.blocks_of(self.words)
        if len(self.words) > MOST_PUSHED_TERMS:
            wanted = spark.createDataFrame([(w,) for w in self.words], "term string")
            self.read = self.read.join(F.broadcast(wanted), "term", "left_semi")
        self.idf = dict.fromkeys(self.words, 1.0)
        if score == OKAPI:
            counts = self.read.groupBy("term").agg(F.sum("n_docs").alias("n")).collect()  # a row per term of the queries
            known = {r["term"]: float(np.log(lexical._idf(r["n"], index.n_docs))) for r in counts}
            self.idf = {w: known.get(w, 0.0) for w in self.words}
        weighted = asked.append_column("idf", pa.array([self.idf[t] for t in asked["term"].to_pylist()], pa.float64()))
        self.asked = weighted
        sent = spark.sparkContext.broadcast(lexical._pack(weighted))
        if where:
            listed = lambda p: F.filter(F.transform(f"values_{p}", lambda v, i: F.when(v.isin(*where[p]), i)), lambda i: i.isNotNull())
            allowed = index._values(where).select("segment", *[listed(p).alias(f"allowed_{p}") for p in where])
            self.read = self.read.join(F.broadcast(allowed), "segment")  # a row per segment
        weights = np.array([vocab.CLASS_WEIGHTS[c] for c in index.classes])
        mean, names = index.average_length, ["query_id", "doc_id", "score"]
        self.schema = (
            f"query_id {self._type(asked)}, doc_id {index.blocks.schema['keys'].dataType.elementType.simpleString()}, score double"
        )

        none = to_arrow_schema(spark.createDataFrame([], self.schema).schema).empty_table()

        def run(table, alive):
            found = None
            if table.num_rows and (alive is None or alive.num_rows):
                wanted = alive if alive is None else alive["query_id"].combine_chunks()
                found = _score_segment(table, wanted, sent.value, score, weights, mean, where, k, min_score, exclude_self, names)
            return none if found is None else found

        self.run = run
        columns = ["term", "segment", "keys", "tfs", "classes" if score == COVER else "lengths"]
        self.columns = [*columns, *[f"{kind}_{p}" for p in where for kind in ("payload", "allowed")]]

    def _type(self, asked: pa.Table) -> str:
        return self.index.spark.createDataFrame(asked.slice(0, 0)).schema["query_id"].dataType.simpleString()

    def everything(self) -> DataFrame:
        run = self.run
        return self.read.select(*self.columns).groupBy("segment").applyInArrow(lambda table: run(table, None), self.schema)

    def cells(self) -> DataFrame:
        """(query_id, segment, bound): the most that a document of the segment can score for the query; only the bounds of
        the blocks are read."""
        terms = self.index.spark.createDataFrame(self.asked)
        most = F.sum(F.col("idf") * F.col("most_okapi" if self.score == OKAPI else "most_cover"))
        cells = self.read.join(F.broadcast(terms), "term").groupBy("query_id", "segment").agg(most.alias("bound"))
        bound = F.col("bound") / (F.col("bound") + 1) if self.score == COVER else F.col("bound")
        return cells.withColumn("bound", bound + 10.0**-DIGITS)  # scores are rounded

    def scored(self, cells: DataFrame) -> DataFrame:
        """Hits of the given (query_id, segment) pairs; a segment's blocks are read once for all its queries."""
        run = self.run
        pairs = cells.select("segment", "query_id")
        alive = pairs.select("segment").distinct()
        blocks = self.read.select(*self.columns).join(alive, "segment", "left_semi")
        # Both sides come from the same blocks; new columns keep their names apart.
        asked = pairs.withColumnsRenamed({"segment": "_segment"})
        both = blocks.groupBy("segment").cogroup(asked.groupBy("_segment"))
        return both.applyInArrow(lambda table, alive: run(table, alive), self.schema)


def remaining_cells(cells: DataFrame, seeds: DataFrame, hits: DataFrame, k: int, min_score: float) -> DataFrame:
    """The cells outside the seeds whose bound reaches the query's k-th hit so far, or that have no k hits yet."""
    kth = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    limit = F.when(F.col("n") >= k, F.greatest(F.col("kth"), F.lit(min_score))).otherwise(F.lit(min_score))
    rest = cells.join(seeds.select("query_id", "segment"), ["query_id", "segment"], "left_anti")
    return rest.join(kth, "query_id", "left").where(F.col("bound") >= F.coalesce(limit, F.lit(min_score))).drop("n", "kth")


def search(
    index: PostingIndex, queries: DataFrame, query_key: str, query_text: str, k: int = 5, score: str = COVER,
    min_score: float = 0.0, exclude_self: bool = False, where: dict[str, list[str]] | None = None,
    stop_words: list[str] | None = None, max_sent: int = lexical.MAX_SENT_TERMS, one_phase: int | None = None,
) -> DataFrame:
    """Top k documents per query: (query_id, doc_id, score, rank), by ``cover`` rank or ``okapi`` BM25.

    ``where`` keeps documents whose payload has one of the given values. Hits score above ``min_score`` and above 0; equal
    scores rank by ascending key. Up to ``max_sent`` (query, term) rows are sent to the tasks; a larger query side is
    joined with the postings on the term. Up to ``one_phase`` segments are scored at once, by default as many as the
    number of queries makes worth while.
    """
    where = where or {}
    missing = set(where) - set(index.payload)
    if missing:
        raise ValueError(f"the index does not hold {sorted(missing)}")
    if exclude_self and index.blocks.schema["keys"].dataType.elementType.typeName() == "struct":
        raise ValueError("a key of several columns cannot be a query's own")
    terms = lexical.query_terms(queries, query_key, query_text, stop_words)
    if index.stemmed:
        words = terms.groupBy("query_id").agg(F.collect_list("term").alias("_words"))
        terms = words.select("query_id", F.explode(F.array_distinct(stemming.stems(F.col("_words")))).alias("term"))
    order = (F.col("score").desc(), F.col("doc_id"))
    if not lexical._fits(terms, max_sent):
        return ranking.rank_hits(_joined(index, terms, score, min_score, exclude_self, where), "query_id", k, *order)
    asked = terms.toArrow()
    if one_phase is None:
        one_phase = max(ONE_PHASE_SEGMENTS, SEGMENTS_PER_QUERY * pc.count_distinct(asked["query_id"]).as_py())
    find = _Search(index, asked, score, k, min_score, exclude_self, where)
    if index.segments <= one_phase:
        return ranking.rank_hits(find.everything(), "query_id", k, *order)
    cells = sinks.stored(find.cells(), "search-cells")
    seeds = sinks.stored(ranking.rank_hits(cells, "query_id", 1, F.col("bound").desc(), F.col("segment")), "search-seeds")
    hits = sinks.stored(find.scored(seeds), "search-hits")
    rest = find.scored(remaining_cells(cells, seeds, hits, k, min_score))
    return ranking.rank_hits(hits.unionByName(rest), "query_id", k, *order)


def _joined(index: PostingIndex, terms: DataFrame, score: str, min_score: float, exclude_self: bool, where: dict) -> DataFrame:
    """All hits by a join of the blocks with the query side on the term; nothing is sent."""
    columns = ["keys", "classes", "tfs", "lengths", *[f"payload_{p}" for p in where]]
    blocks = index._named(index._numbered(), tuple(where)).join(terms.select("term").distinct(), "term", "left_semi")
    rows = blocks.select("term", F.explode(F.arrays_zip(*columns)).alias("e"))
    for name, values in where.items():
        rows = rows.where(F.col(f"e.payload_{name}").isin(*values))
    rows = rows.select("term", F.col("e.keys").alias("doc_id"), F.col("e.classes").alias("class"), "e.tfs", "e.lengths")
    if score == COVER:
        weight = F.element_at(F.create_map(*[F.lit(x) for c in index.fields for x in (c, vocab.CLASS_WEIGHTS[c])]), F.col("class"))
        total = F.sum(F.col("tfs") * weight)
        value = total / (total + 1)
        hits = rows.join(terms, "term")
    else:
        counts = index._numbered().groupBy("term").agg(F.sum("n_docs").alias("n"))
        idf = F.log(lexical._idf(F.col("n"), F.lit(index.n_docs)))
        weighted = terms.join(counts, "term").select("query_id", "term", idf.alias("idf"))
        single = rows.groupBy("term", "doc_id").agg(F.sum("tfs").alias("tfs"), F.first("lengths").alias("lengths"))
        value = F.sum(F.col("idf") * _okapi(F.col("tfs"), F.col("lengths"), index.average_length))
        hits = single.join(weighted, "term")
    if exclude_self:
        hits = hits.where(F.col("query_id") != F.col("doc_id"))
    scored = hits.groupBy("query_id", "doc_id").agg(rounded_column(value).alias("score"))
    return scored.where((F.col("score") > min_score) & (F.col("score") > 0))


def search_articles(index: PostingIndex, queries: DataFrame, k: int = 5, category: str | None = None, **options) -> DataFrame:
    """Articles of the index by cover rank, of one category if named."""
    where = {"category": [category]} if category is not None else {}
    return search(index, queries, "query_id", "query_text", k, where=where, **options)


def search_tickets(
    index: PostingIndex, queries: DataFrame, k: int = 5, category: str | None = None, resolved_only: bool = True, **options
) -> DataFrame:
    """Similar past tickets by cover rank; a ticket never finds itself."""
    where = {"status": list(vocab.RESOLVED_STATUSES)} if resolved_only else {}
    if category is not None:
        where["category"] = [category]
    options = {"exclude_self": True} | options
    return search(index, queries, "query_id", "query_text", k, where=where, **options)


def combined_search(
    articles: PostingIndex, tickets: PostingIndex, queries: DataFrame, kb_k: int = 3, ticket_k: int = 2, **options
) -> DataFrame:
    """The best articles and the best tickets per query, tagged by ``source_type``."""
    kb = search_articles(articles, queries, kb_k).withColumn("source_type", F.lit("kb_chunk"))
    past = search_tickets(tickets, queries, ticket_k, **options).withColumn("source_type", F.lit("ticket"))
    return kb.unionByName(past)
