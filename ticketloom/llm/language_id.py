"""Language identification by a byte convolutional network.

Texts become lower-case UTF-8 bytes cut into windows of fixed length. Filters of several widths slide over a window, each
keeps its largest response, and a softmax over these gives the language. The network is trained with numpy on a bounded
sample of labelled texts and applied to all windows of all texts in batches.

One more output stands for text in none of the languages. It learns from garbled windows of the same texts: their letters
replaced by others, shuffled, reversed, thinned out, or taken from another script.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import sampling
from ticketloom.llm.memory import tidy

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
WINDOWS_PER_STEP = 512
_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters says nothing about a language; it all becomes a space.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def windows_of(text: str) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, the last one filled up with zeros."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_PLAIN), dtype=np.uint8)
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), dtype=np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


@dataclass
class Network:
    """``tables[i][k, byte]``: what the byte at offset k adds to the filters of WIDTHS[i]. The last output is for text in none
    of the languages."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def parts(self) -> tuple:
        return self.languages, self.tables, self.bias, self.weights, self.offset


def _responses(tables: list[np.ndarray], windows: np.ndarray, places: bool = False):
    """Per window the largest response of every filter, and where it is."""
    n = len(windows)
    flat = windows.reshape(-1).astype(np.intp)
    best, where = [], []
    for table in tables:
        width = len(table)
        total = table[0][flat]
        for k in range(1, width):
            total[: len(flat) - k] += table[k][flat[k:]]
        inside = total.reshape(n, WINDOW, -1)[:, : WINDOW - width + 1]
        if places:
            at = inside.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(inside, at[:, None, :], axis=1)[:, 0])
        else:
            best.append(inside.max(axis=1))
    return np.concatenate(best, axis=1), where


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every window the probability of each language, if it is one of them, and that it is none."""
    known, none = np.empty((len(windows), len(net.languages))), np.empty(len(windows))
    for at in range(0, len(windows), WINDOWS_PER_STEP):
        top, _ = _responses(net.tables, windows[at : at + WINDOWS_PER_STEP])
        logits = np.maximum(top + net.bias, 0) @ net.weights + net.offset
        known[at : at + WINDOWS_PER_STEP] = _softmax(logits[:, :-1])
        none[at : at + WINDOWS_PER_STEP] = _softmax(logits)[:, -1]
    return known, none


#: First characters of alphabets whose letters garbled windows may have: Greek, Cyrillic, Hebrew, Arabic, Devanagari, kana, Han.
SCRIPTS = (0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0x3042, 0x4E00)


def garbled(windows: np.ndarray, seed: int = 11) -> np.ndarray:
    """Half as many windows that are in no language, made of given ones."""
    rng = np.random.default_rng(seed)
    out = windows[rng.permutation(len(windows))[: max(1, len(windows) // 2)]].copy()
    small = np.arange(97, 123)
    for i, row in enumerate(out):
        filled = np.flatnonzero(row)
        kind = i % 6
        if kind <= 1:  # letters replaced one by one, as if it were another language
            swap = np.arange(256, dtype=np.uint8)
            swap[small] = rng.permutation(small)
            out[i] = swap[row]
        elif kind == 2:
            out[i, filled] = rng.permutation(row[filled])
        elif kind == 3:
            out[i, filled] = row[filled][::-1]
        elif kind == 4:  # few letters among what is left of digits and signs
            out[i, filled] = np.where(rng.random(len(filled)) < 0.05, row[filled], 32)
        else:
            first = SCRIPTS[rng.integers(len(SCRIPTS))]
            words = [[chr(first + k) for k in rng.integers(0, 24, rng.integers(2, 9))] for _ in range(WINDOW // 8)]
            raw = " ".join(map("".join, words)).encode()[:WINDOW]
            out[i] = 0
            out[i, : len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out


class _Adam:
    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.first = [np.zeros_like(a) for a in arrays]
        self.second = [np.zeros_like(a) for a in arrays]

    def apply(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for a, g, m, v in zip(self.arrays, gradients, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= scale * m / (np.sqrt(v) + 1e-8)


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], epochs: int = 4, seed: int = 7) -> Network:
    """Cross-entropy by Adam; each class weighs the same, and a window by how much of it is filled with letters. The gradient
    of a filter goes only to its best place."""
    rng = np.random.default_rng(seed)
    strange = garbled(windows)
    windows, target = np.concatenate([windows, strange]), np.append(target, np.full(len(strange), len(languages)))
    fill = np.maximum(((windows != 0) & (windows != 32)).mean(axis=1), 1 / WINDOW)
    fill[target == len(languages)] = fill.mean()
    n_classes, n_filters = len(languages) + 1, FILTERS * len(WIDTHS)
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(n_filters, dtype=np.float32)
    weights = rng.normal(0, 0.2, (n_filters, n_classes)).astype(np.float32)
    offset = np.zeros(n_classes, dtype=np.float32)
    share = np.bincount(target, fill, minlength=n_classes)
    weight = (fill * (len(target) / np.maximum(share, 1e-9) / n_classes)[target]).astype(np.float32)
    adam = _Adam([*tables, bias, weights, offset], rate=0.01)
    batch = 128
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows], target[rows]
            top, where = _responses(tables, x, places=True)
            hidden = np.maximum(top + bias, 0)
            logits = hidden @ weights + offset
            delta = _softmax(logits)
            delta[np.arange(len(y)), y] -= 1
            delta *= (weight[rows] / len(y))[:, None]
            back = (delta @ weights.T) * (hidden > 0)
            gradients = []
            for i, width in enumerate(WIDTHS):
                g = np.zeros_like(tables[i])
                mine = back[:, i * FILTERS : (i + 1) * FILTERS]
                column = np.broadcast_to(np.arange(FILTERS), mine.shape)
                for k in range(width):
                    np.add.at(g[k], (np.take_along_axis(x, where[i] + k, axis=1), column), mine)
                gradients.append(g)
            adam.apply([*gradients, back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)])
    return Network(languages, tables, bias, weights, offset)


def _fit_rows(labelled: DataFrame, key: str, text: str, lang: str, max_bytes_per_language: int) -> DataFrame:
    """(_lang, _key, _text, class_rows) of the sample that a network learns from."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(r"\p{L}"))
    usable = usable.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    return sampling.per_class(usable, "_lang", "_key", max_bytes_per_language, F.octet_length("_text"))


def learn(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    max_bytes_per_language: int = 1_500_000, epochs: int = 4,
) -> Network | None:
    """A network from about ``max_bytes_per_language`` bytes of texts of each language.

    A text that is longer than a twentieth of that teaches by as many bytes, in windows spread evenly over it. Short texts
    teach too. Rows with a NULL key or language or a text without letters teach nothing; a repeated row counts each time.
    Every language with a usable row is learned. None when nothing is left.
    """
    drawn = _fit_rows(labelled, key, text, lang, max_bytes_per_language)
    most = max(1, max_bytes_per_language // sampling.LEAST_ROWS // WINDOW)

    def cut(batches):
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = windows_of(value.as_py())
                if len(rows) > most:
                    rows = rows[np.linspace(0, len(rows) - 1, most).astype(int)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.string()), pa.array([rows.tobytes()], pa.binary())], ["lang", "windows"]
                )

    rows = drawn.select("_lang", "_text").mapInArrow(tidy(cut), "lang string, windows binary").collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    number = {name: i for i, name in enumerate(languages)}
    parts = [np.frombuffer(r["windows"], dtype=np.uint8).reshape(-1, WINDOW) for r in sorted(rows)]
    windows = np.concatenate(parts)
    target = np.repeat([number[r["lang"]] for r in sorted(rows)], [len(p) for p in parts])
    return train(windows, target, languages, epochs)


def limits(net: Network, right: DataFrame, share: float = 0.999) -> tuple[float, float]:
    """(lowest score, highest ``strange``) of a text in one of the learned languages, from ``right``, the (score, strange) of
    all labelled texts that the network names rightly. The score lies half way from a blind guess to their lowest; ``strange``
    is what all but 1 - ``share`` of them keep to, but one half at least."""
    lowest, strange = right.agg(F.min("score"), F.percentile_approx("strange", share, 10_000)).first()
    guess = 1 / len(net.languages)
    if lowest is None:
        return 0.0, 1.0
    return guess + (lowest - guess) / 2 - 1e-9, max(0.5, strange + 1e-9)


def predict(df: DataFrame, key: str, text: str, net: Network | None, *keep: str, with_strange: bool = False) -> DataFrame:
    """(key, ``keep`` columns, lang_pred, score) for every row, and with ``with_strange`` also (strange).

    All windows of a text vote with their softmax values, weighed by their letters; ``score`` is the mean of the winner and
    ``strange`` that of being in none of the languages. A NULL text, one without letters, or a missing network gives ``und``,
    0 and 1. Ties go to the first language by name.
    Keys may be NULL or repeat; other columns are not read; nothing is shuffled.
    """
    schema = df.select(key, *keep).schema.add("lang_pred", "string").add("score", "double").add("strange", "double")
    sent = df.sparkSession.sparkContext.broadcast(net.parts() if net else None)

    def run(batches):
        net = Network(*sent.value) if sent.value else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            names = [UNKNOWN] * batch.num_rows
            scores = [0.0] * batch.num_rows
            strange = [1.0] * batch.num_rows
            held, parts, size = [], [], 0
            for i in range(batch.num_rows):
                value = texts[i].as_py()
                if net and has_letter(value):
                    held.append(i)
                    parts.append(windows_of(value))
                    size += len(parts[-1])
                if parts and (size >= 16 * WINDOWS_PER_STEP or i == batch.num_rows - 1):
                    _vote(net, held, parts, names, scores, strange)
                    held, parts, size = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(strange, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score", "strange"],
            )

    found = df.select(key, *keep, F.col(text).alias("_text")).mapInArrow(tidy(run), schema)
    return found if with_strange else found.drop("strange")


def _vote(net: Network, held: list[int], parts: list[np.ndarray], names: list, scores: list, strange: list | None = None) -> None:
    windows = np.concatenate(parts)
    weight = ((windows != 0) & (windows != 32)).sum(axis=1) + 1e-9
    known, none = probabilities(net, windows)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    total = np.add.reduceat(weight, starts)
    mean = np.add.reduceat(known * weight[:, None], starts) / total[:, None]
    apart = np.add.reduceat(none * weight, starts) / total
    for i, row, value in zip(held, mean, apart):
        names[i] = net.languages[int(row.argmax())]
        scores[i] = min(1.0, float(row.max()))
        if strange is not None:
            strange[i] = min(1.0, float(value))
