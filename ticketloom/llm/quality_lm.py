"""Text quality by the perplexity of an interpolated modified Kneser-Ney model over runs of six bytes.

Runs are counted over all trusted texts, pre-aggregated per task, so what is gathered grows with them; lower orders count
the distinct bytes that precede a run. Discounts, context totals and interpolated probabilities come from joins of these
count tables, split by run. A run of six bytes reaches over word ends, so it sees spelling and which words meet; every byte
is its own symbol, so no two scripts or characters are alike. Six bytes and a length fit a whole number: nothing is hashed.

The logarithm of a text's probability is a sum over its bytes: an even share, the weight that each seen context leaves to
the lower order, and for each seen run the gain over that. The commonest runs go to the tasks, where nearly all bytes are
settled. Of the rest each text keeps its distinct runs with their counts; a filter of seen runs leaves out those that add
nothing, and the others are joined with the table of gains, split by run.

A trusted text would look too good to a model that has read it. So a tenth of the trusted texts is not read; it gives the
upper limits, and all trusted texts give the lower ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ticketloom.llm import id_filter
from ticketloom.llm.memory import tidy
from ticketloom.sources.sinks import stored

ORDER, SYMBOLS = 6, 256
#: The length of a run stands above its bytes.
_LENGTH = 48
#: What a text follows: line breaks.
START = b"\n" * (ORDER - 1)
#: Runs whose values go to all tasks (24 MB), trusted keys that do, and bytes of text that a task takes at a time.
COMMON, MOST_KEYS, CHUNK = 1_000_000, 2_000_000, 2_000_000
#: Distinct runs that a counting task holds before it gives them on.
HELD_RUNS = 4_000_000
#: One trusted text in so many is not read.
UNREAD = 10


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def _tag(order: int) -> int:
    return order << _LENGTH


def _chunks(values):
    """(first row, texts as bytes) of about CHUNK bytes, but at least one text."""
    at, held, size = 0, [], 0
    for i, value in enumerate(values):
        held.append((value.as_py() or "").encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= CHUNK:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, run of ORDER bytes that ends there) of every byte of the texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(START + t for t in texts), dtype=np.uint8).astype(np.int64)
    n = max(0, len(raw) - ORDER + 1)
    code = np.zeros(n, dtype=np.int64)
    for k in range(ORDER):
        code <<= 8
        code |= raw[k : k + n]
    # Of every text as many windows end in its bytes as it has; those that end in the next one's START are left out.
    inside = np.ones(n + ORDER - 1, dtype=bool)
    ends = np.cumsum(sizes + ORDER - 1)
    inside[(ends[:, None] - np.arange(ORDER - 1) - 1).ravel()] = False
    return np.repeat(np.arange(len(texts)), sizes), code[inside[:n]]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[new], np.add.reduceat(counts[order], new)


def _counts(texts: DataFrame) -> DataFrame:
    """(code, c): how often each run of ORDER bytes occurs. Tasks add up their own texts first."""

    def count(batches):
        held, size = [], 0

        def rows():
            codes, counts = _merged(held)
            for at in range(0, len(codes), 100_000):
                some = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(codes[some]), pa.array(counts[some])], ["code", "c"])

        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                _, code = runs_of(texts)
                if len(code):
                    held.append(np.unique(code, return_counts=True))
                    size += len(held[-1][0])
                if size > HELD_RUNS:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD_RUNS // 2:
                        yield from rows()
                        held, size = [], 0
        if held:
            yield from rows()

    return texts.mapInArrow(tidy(count), "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The discounts of runs seen once, twice and more often, from how many runs there are of each."""
    rare = [F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    return discounts_of(counts.agg(*rare).first())


def discounts_of(row) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (max(1, row[f"n{k}"]) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), limit) for d, limit in zip(found, (0.95, 1.9, 2.85)))


@dataclass
class Model:
    """``values``: (code, gain, rest) of every seen run by its length and bytes: what it adds over the lower order, and the
    weight it leaves to the lower order as a context, both as logarithms. ``left``: that of the empty context. ``common``:
    codes in order with their gains and rests, and the whole log probability of those of full length (else NaN). ``seen``: a
    filter of all codes."""

    values: DataFrame
    left: float
    common: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    seen: id_filter.KeyFilter


def learn(trusted: DataFrame, text: str) -> Model:
    """From all texts of the column. Without any every byte is equally likely."""
    counts = {ORDER: stored(_counts(trusted.select(text)), "runs").withColumn("raw", F.col("c"))}
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(F.lit(_mask(order)))
        shorter = counts[order + 1].groupBy(suffix.alias("code")).agg(F.count(F.lit(1)).alias("c"), F.sum("raw").alias("raw"))
        counts[order] = stored(shorter, f"runs{order}")
    left, lower, tables = 0.0, None, []
    for order in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[order])
        c = F.col("c")
        discount = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        seen = counts[order].withColumn("context", F.shiftright("code", 8))
        contexts = seen.groupBy("context").agg(F.sum("c").alias("total"), F.sum(discount).alias("held"))
        contexts = contexts.select("context", "total", F.log(F.col("held") / F.col("total")).alias("rest"))
        if order == 1:
            row = contexts.first()
            left = row["rest"] if row else 0.0
            total = row["total"] if row else 1
            joined = seen.withColumns({"total": F.lit(total), "rest": F.lit(left), "below": F.lit(-float(np.log(SYMBOLS)))})
        else:
            contexts = stored(contexts, "contexts")
            run = (F.lit(_tag(order - 1)) + F.col("context")).alias("code")
            tables.append(contexts.select(run, F.lit(0.0).alias("gain"), "rest", F.lit(None).cast("double").alias("whole"), F.lit(0).cast("long").alias("raw")))
            suffix = F.col("code").bitwiseAND(F.lit(_mask(order - 1))).alias("suffix")
            joined = seen.select("*", suffix).join(contexts, "context").join(lower, "suffix")
        x = F.log((c - discount) / F.col("total")) - F.col("rest") - F.col("below")
        gain = F.when(x > 30, x).otherwise(F.log1p(F.exp(x)))
        found = joined.select("code", "raw", gain.alias("gain"), (F.col("rest") + F.col("below") + gain).alias("below"))
        found = stored(found, "gains")
        whole = F.col("below") if order == ORDER else F.lit(None).cast("double")
        run = (F.lit(_tag(order)) + F.col("code")).alias("code")
        tables.append(found.select(run, "gain", F.lit(0.0).alias("rest"), whole.alias("whole"), "raw"))
        lower = found.select(F.col("code").alias("suffix"), "below")
    parts = tables[0]
    for t in tables[1:]:
        parts = parts.unionByName(t)
    # A run is in the tables as itself and as a context.
    values = parts.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("gain", "rest", "whole", "raw")])
    values = stored(values, "values")
    codes = values.select("code")
    return Model(values.select("code", "gain", "rest"), left, _common(values), id_filter.KeyFilter(codes, "code", codes.count()))


def _common(values: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes in order, gains, rests and whole log probabilities of all runs that occur more often than some number, which is
    the least that leaves at most COMMON runs."""
    often = F.least(F.floor(F.log2(F.greatest("raw", F.lit(1))) * 64), F.lit(64 * 63))
    sizes = sorted(values.groupBy(often.alias("often")).count().collect(), reverse=True)  # at most 64 * 64 rows
    reach = np.cumsum([r["count"] for r in sizes])
    fits = [r["often"] for r, n in zip(sizes, reach) if n <= COMMON]
    least = fits[-1] if fits else 64 * 64
    names = ["gain", "rest", "whole"]
    most = values.where(often >= least).select("code", *[F.col(c).cast("float") for c in names]).toArrow()
    order = np.argsort(most["code"].to_numpy())
    return most["code"].to_numpy()[order], *(most[c].to_numpy().astype(np.float32)[order] for c in names)


class _Lookup:
    """Places of codes in a sorted array, found through a table by the codes' hash."""

    def __init__(self, codes: np.ndarray):
        bits = max(4, int(2 * len(codes)).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(self.slots, -1, dtype=np.int64)
        self.place = np.full(self.slots, -1, dtype=np.int32)
        left, at = np.arange(len(codes)), self._slot(codes)
        while len(left):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.place[at[first]] = codes[left[first]], left[first]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) % self.slots

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of every code, -1 where it is not listed."""
        out = np.full(len(codes), -1, dtype=np.int32)
        left, at = np.arange(len(codes)), self._slot(codes)
        while len(left):
            keys = self.keys[at]
            hit = keys == codes[left]
            out[left[hit]] = self.place[at[hit]]
            on = ~hit & (keys >= 0)
            left, at = left[on], (at[on] + 1) % self.slots
        return out


def perplexities(df: DataFrame, text: str, model: Model, *keep: str) -> DataFrame:
    """(``keep`` columns, n_symbols, perplexity) for every row and its whole text.

    ``n_symbols`` is the number of bytes. NULL and empty texts have none and a NULL perplexity. Only the distinct runs of a
    text that may be seen and are not common are shuffled.
    """
    schema = df.select(*keep).schema.add("_row", "long").add("n_symbols", "long").add("_log", "double")
    entry = StructType().add("code", "long").add("c", "integer").add("f", "integer")
    schema = schema.add("_runs", ArrayType(entry))
    marks, bits, left = model.seen.sent(), model.seen.bits, model.left
    sent = df.sparkSession.sparkContext.broadcast(model.common)
    kind = pa.struct([("code", pa.int64()), ("c", pa.int32()), ("f", pa.int32())])

    def run(batches):
        codes, gains, rests, whole = sent.value
        known, even = _Lookup(codes), left - np.log(SYMBOLS)
        for batch in batches:
            for at, held in _chunks(batch.column(batch.num_columns - 1)):
                n, (doc, code) = len(held), runs_of(held)
                place = known.find(code + _tag(ORDER))
                settled = place >= 0
                total = np.bincount(doc[settled], whole[place[settled]], n).astype(np.float64)  # of nothing, whole numbers
                doc, code = doc[~settled], code[~settled]
                total += even * np.bincount(doc, minlength=n)
                runs = [(code & _mask(k)) + _tag(k) for k in range(1, ORDER + 1)]
                before = [((code >> 8) & _mask(k)) + _tag(k) for k in range(1, ORDER)]
                code, owner = np.concatenate([*runs, *before]), np.tile(doc, 2 * ORDER - 1)
                as_run = np.repeat([1, 0], [ORDER * len(doc), (ORDER - 1) * len(doc)])
                place = known.find(code)
                hit = place >= 0
                value = np.where(as_run[hit], gains[place[hit]], rests[place[hit]])
                total += np.bincount(owner[hit], value, n)
                code, owner, as_run = code[~hit], owner[~hit], as_run[~hit]
                may = id_filter.hits(marks.value, (_spark_hash(code) & np.uint64(bits - 1)).view(np.int64))
                code, owner, as_run = code[may], owner[may], as_run[may]
                order = np.lexsort((code, owner))
                code, owner, as_run = code[order], owner[order], as_run[order]
                new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))) if len(code) else np.zeros(0, int)
                c, f = (np.add.reduceat(x, new) if len(new) else np.zeros(0, np.int64) for x in (as_run, 1 - as_run))
                items = pa.StructArray.from_arrays(
                    [pa.array(code[new]), pa.array(c.astype(np.int32)), pa.array(f.astype(np.int32))], fields=list(kind)
                )
                offsets = pa.array(np.searchsorted(owner[new], np.arange(n + 1)).astype(np.int32))
                sizes = pa.array([len(t) for t in held], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[x.slice(at, n) for x in batch.columns[:-1]], sizes, pa.array(total, pa.float64()), pa.ListArray.from_arrays(offsets, items)],
                    [*batch.schema.names[:-1], "n_symbols", "_log", "_runs"],
                )

    rows = df.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    rows = stored(rows.mapInArrow(tidy(run), schema), "text-runs")
    asked = rows.select("_row", F.inline("_runs"))
    added = asked.join(model.values.hint("merge"), "code").select("_row", (F.col("c") * F.col("gain") + F.col("f") * F.col("rest")).alias("add"))
    added = added.groupBy("_row").agg(F.sum("add").alias("_add"))
    out = rows.drop("_runs").join(added.hint("merge"), "_row", "left")
    value = F.exp(-(F.col("_log") + F.coalesce(F.col("_add"), F.lit(0.0))) / F.col("n_symbols"))
    return out.select(*keep, "n_symbols", F.when(F.col("n_symbols") > 0, value).alias("perplexity"))


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _spark_hash(codes: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs, by which the filter places its marks."""
    h = (np.uint64(42) + (_P5 + np.uint64(8))) ^ _turned(codes.view(np.uint64) * _P2, 31) * _P1
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _only(texts: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """The rows with a known key. The keys go to the tasks while they are few, so that no text is shuffled."""
    few = known.count() <= MOST_KEYS
    return texts.join(F.broadcast(known) if few else known, key, "left_semi")


def classify(
    df: DataFrame, key: str, text: str, lang: str, trusted: DataFrame, low: float = 0.002, high: float = 0.995
) -> DataFrame:
    """(key, lang, n_symbols, perplexity, lowest, highest, keep) for every row.

    ``trusted`` holds the keys of trusted rows. A model of nine in ten of their texts scores every row. A row is kept when its
    perplexity lies between the ``low`` quantile of the trusted rows of its language and the ``high`` quantile of those that
    the model has not read; equal texts are read or not alike. Rows of one NULL language form a language, and a language
    without such rows takes the quantiles of all. Where the unread part is empty, all trusted rows give both limits. Empty
    texts are not kept; without trusted rows nothing is. A key listed twice counts once. Other columns are not read.
    """
    unread = F.coalesce(F.pmod(F.xxhash64(F.lit("unread"), text), F.lit(UNREAD)) == 0, F.lit(False))
    named = df.select(F.col(key), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), unread.alias("unread"))
    known = stored(trusted.select(F.col(key)).where(F.col(key).isNotNull()).distinct(), "trusted")
    read = named.where("NOT unread").select(key, "text")
    model = learn(_only(read, key, known), "text")
    scored = stored(perplexities(named, "text", model, key, "lang", "unread"), "perplexities")
    judged = stored(_only(scored.where("perplexity IS NOT NULL"), key, known), "judged")
    fresh = judged.where("unread")
    if fresh.isEmpty():
        fresh = judged

    def end(share: float) -> Column:
        return F.percentile_approx("perplexity", share, 10_000).alias("end")

    out, everywhere = scored, {}
    for name, rows, share in (("lowest", judged, low), ("highest", fresh, high)):
        limits = stored(rows.groupBy("lang").agg(end(share).alias(f"_{name}")), "limits")  # one row per language
        everywhere[name] = rows.agg(end(share)).first()["end"]
        out = out.join(limits, "lang", "left")
    out = out.withColumns({n: F.coalesce(F.col(f"_{n}"), F.lit(v).cast("double")) for n, v in everywhere.items()})
    keep = F.coalesce(F.col("perplexity").between(F.col("lowest"), F.col("highest")), F.lit(False))
    return out.select(
        key, F.nullif("lang", F.lit("")).alias("lang"), "n_symbols", "perplexity", "lowest", "highest", keep.alias("keep")
    )
