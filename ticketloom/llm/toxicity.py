"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes compatibility forms, homoglyphs and digits or signs written for letters. The lexicon (words, and beginnings
of words) and its weights are learned from labelled rows; phrases around its terms that occur in clean rows are
exceptions. The weighted sum is normalised by the number of words and turned into a probability by a logistic fit.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import sampling
from ticketloom.llm.memory import tidy
from ticketloom.sources.sinks import stored

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁһӏԛԝвкмнтαονιρυτκɑıⅼ",
    "aeopcyxijsdhlqwbkmhtaovipytkail",
)
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
#: A word that begins with a letter and has substitutes inside it, or one of the signs at its end.
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!|]+[^\W\d_]+)+\$?|(?<![^\W_])[0-9@$]+(?:[^\W\d_]+[0-9@$!|]*)*[^\W\d_]+")
_BETWEEN_WORDS = re.compile(r"[\W_]+")
PREFIX_LENGTHS = range(3, 9)
_MATCHED = "="


def fold(text: str) -> str:
    """Words in lower case between single spaces, one space at either end. ``1d!ot`` and ``idіot`` become ``idiot``."""
    plain = text if text.isascii() else unicodedata.normalize("NFKC", text)
    plain = plain.lower()
    if not plain.isascii():
        plain = plain.translate(HOMOGLYPHS)
    plain = _MIXED.sub(lambda m: m.group().translate(SUBSTITUTES), plain)
    return f" {_BETWEEN_WORDS.sub(' ', plain).strip()} "


@dataclass(frozen=True)
class Model:
    """``terms``: folded term -> weight, a word as `` word `` and the beginning of a word as `` begin``.
    ``exceptions``: phrases between spaces; a term inside one does not count. ``fit``: intercept and two slopes."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    fit: tuple[float, float, float] = (-4.0, 1.0, 1.0)


class Matcher:
    def __init__(self, terms: dict[str, float], exceptions=()):
        self.automaton = None
        entries = {t: (len(t), w) for t, w in terms.items()}
        entries.update({e: (len(e), None) for e in exceptions})
        if entries:
            self.automaton = ahocorasick.Automaton()
            for text, entry in entries.items():
                self.automaton.add_word(text, entry)
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the heaviest term that begins at each place outside every exception."""
        if self.automaton is None:
            return []
        best: dict[int, tuple[int, float]] = {}
        shields = []
        for last, (length, weight) in self.automaton.iter(folded):
            start, end = last + 1 - length, last + 1
            if weight is None:
                shields.append((start, end))
            elif start not in best or weight > best[start][1]:
                best[start] = (end, weight)
        found = [(start, end, weight) for start, (end, weight) in sorted(best.items())]
        if not shields:
            return found
        shields.sort()
        kept, at, reach = [], 0, -1
        for start, end, weight in found:
            while at < len(shields) and shields[at][0] <= start:
                reach = max(reach, shields[at][1])
                at += 1
            if reach < end - 1:
                kept.append((start, end, weight))
        return kept

    def features(self, folded: str) -> tuple[float, float]:
        """The weighted sum per hundred words and the weighted sum itself, both on a log scale."""
        total = sum(weight for _, _, weight in self.hits(folded))
        words = folded.count(" ") - 1
        return math.log1p(100 * total / (words + 20)), math.log1p(total)


def _terms_of(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in PREFIX_LENGTHS if k < len(word))
    return out


def _tally(sample: DataFrame, of_text) -> DataFrame:
    """(term, toxic, clean): in how many rows of each kind ``of_text`` names the term."""

    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                (toxic if label else clean).update(of_text(text.as_py()))
        names = list(toxic.keys() | clean.keys())
        for at in range(0, len(names), 50_000):
            some = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), pa.array([toxic[n] for n in some]), pa.array([clean[n] for n in some])],
                ["term", "toxic", "clean"],
            )

    parts = sample.select("toxic", "folded").mapInArrow(tidy(run), "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def folded_texts(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` columns and the folded text; NULL folds like the empty text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches):
        for batch in batches:
            folded = [fold(v.as_py() or "") for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(folded, pa.string())], [*batch.schema.names[:-1], "folded"]
            )

    return df.select(*keep, F.col(text).alias("folded")).mapInArrow(tidy(run), f"{schema}, folded string")


def learn(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    max_rows_per_class: int = 6_000, min_rows: int = 5, min_log_odds: float = 3.0, exceptions: tuple[str, ...] = (),
) -> Model:
    """Lexicon, exceptions and fit from at most about ``max_rows_per_class`` labelled rows of each class.

    A term needs ``min_rows`` toxic rows and the given log odds, and all such terms are kept: their number is bounded by the
    words of the sample. Of terms found in the same rows the longest stays. NULL
    labels, NULL keys and labels without a document are left out; a document labelled twice counts for each label.
    Without toxic rows the lexicon is empty and every score is low. ``exceptions`` are added to the learned ones.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("toxic"))
    known = known.where(F.col("_key").isNotNull() & F.col("toxic").isin(0, 1))
    drawn = sampling.per_class(known, "toxic", "_key", max_rows_per_class)
    texts = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    chosen = texts.join(F.broadcast(drawn), "_key")  # two classes of bounded size
    sample = stored(folded_texts(chosen, "_text", "toxic", "class_rows"), "toxic-sample")
    sizes = {r["toxic"]: (r["n"], r["all"]) for r in sample.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.max("class_rows").alias("all")).collect()}
    n_toxic, n_clean = sizes.get(1, (0, 0))[0], sizes.get(0, (0, 0))[0]
    if not n_toxic:
        return Model({}, tuple(exceptions))
    odds = F.log((F.col("toxic") + 0.1) / (n_toxic + 0.2)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    tally = _tally(sample, _terms_of).withColumn("weight", odds)
    strong = tally.where((F.col("toxic") >= min_rows) & (F.col("weight") >= min_log_odds))
    terms = _without_shadowed({r["term"]: (r["toxic"], r["clean"], r["weight"]) for r in strong.collect()})

    plain = Matcher(terms)

    def around(folded: str) -> set[str]:
        """The terms that matched, marked, and the phrases around them."""
        out = set()
        for start, end, _ in plain.hits(folded):
            out.add(_MATCHED + folded[start:end])
            stop = folded.find(" ", start + 1)
            before = folded.rfind(" ", 0, start) if start > 0 else start
            after = folded.find(" ", stop + 1)
            out.add(folded[max(before, 0) : stop + 1])
            out.add(folded[start : (after if after > 0 else stop) + 1])
            out.add(folded[start : stop + 1])
        return out - set(terms)

    seen = _tally(sample, around).withColumn("weight", odds)
    matched = F.col("term").startswith(_MATCHED)
    # A short beginning owes its count to the longer terms it opens; what it matches beyond them decides.
    own = seen.where(matched & (F.col("toxic") >= min_rows) & (F.col("weight") >= min_log_odds)).collect()
    terms = {r["term"][len(_MATCHED) :]: r["weight"] for r in own}
    mild = seen.where(~matched & (F.col("clean") >= 3) & (F.col("clean") * n_toxic >= F.col("toxic") * n_clean))
    learned = sorted(r["term"] for r in mild.collect())
    shields = tuple(dict.fromkeys([*learned, *(fold(e) for e in exceptions)]))
    matcher = Matcher(terms, shields)

    def measured(batches):
        for batch in batches:
            rows = [matcher.features(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in rows], pa.float64()), pa.array([b for _, b in rows], pa.float64())],
                ["toxic", "density", "total"],
            )

    points = sample.select("toxic", "folded").mapInArrow(tidy(measured), "toxic int, density double, total double").toPandas()
    y = points["toxic"].to_numpy(dtype=float)
    share = np.where(y == 1, sizes[1][1] / n_toxic, sizes.get(0, (1, 1))[1] / max(n_clean, 1))
    x = np.column_stack([np.ones(len(y)), points["density"], points["total"]])
    return Model(terms, shields, tuple(map(float, _logistic(x, y, share / share.mean()))))


def _without_shadowed(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """Drops a beginning of a word when a longer term occurs in as many rows of both kinds."""
    ordered = sorted(found)  # the longer terms follow the beginning
    out = {}
    for at, term in enumerate(ordered):
        longer = itertools.takewhile(lambda other: other.startswith(term), ordered[at + 1 :])
        if not any(found[other][:2] == found[term][:2] for other in longer):
            out[term] = found[term][2]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(df: DataFrame, key: str, text: str, model: Model, *keep: str, threshold: float = 0.7) -> DataFrame:
    """(key, ``keep`` columns, score, predicted, n_hits) for every row and its whole text.

    NULL and empty texts get the score of a text without hits. Keys may be NULL or repeat; each row is scored by itself.
    Other columns are not read. Nothing is shuffled.
    """
    schema = df.select(key, *keep).schema.add("score", "double").add("predicted", "integer").add("n_hits", "integer")
    sent = df.sparkSession.sparkContext.broadcast((model.terms, model.exceptions, model.fit))

    def run(batches):
        terms, exceptions, (a, b, c) = sent.value
        matcher = Matcher(terms, exceptions)
        for batch in batches:
            scores, hits = [], []
            for value in batch.column(batch.num_columns - 1):
                folded = fold(value.as_py() or "")
                density, total = matcher.features(folded)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * density + c * total)))))
                hits.append(0 if total == 0 else len(matcher.hits(folded)))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array(hits, pa.int32()),
                ],
                [*batch.schema.names[:-1], "score", "predicted", "n_hits"],
            )

    return df.select(key, *keep, F.col(text).alias("_text")).mapInArrow(tidy(run), schema)
