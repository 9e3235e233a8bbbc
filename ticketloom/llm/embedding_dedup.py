"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with a cosine of at least t differ by a squared distance of at most 2 (1 - t). After a rotation the
coordinates are dealt into low-dimensional blocks, and that distance into budgets in proportion to each block's variance:
every linked pair keeps to the budget of at least one block. Each block is a range join on its leading coordinate, in
tiles of bounded size; a tile finds the pairs within the budget, leaves those that an earlier block has found already,
and verifies the rest by their exact cosine in double precision. Tiles give counts and spanning edges, never lists of pairs,
so a large group of copies costs no more rows than it has members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import tiles
from ticketloom.llm.graph import connected_components
from ticketloom.llm.memory import tidy
from ticketloom.sources.sinks import stored

BLOCK_DIMENSIONS = 16
#: Up to this many dimensions the rotation follows the principal axes; beyond, it is a fixed random one.
MOST_AXES = 512
ROWS_PER_CHUNK = 4_000
#: Pairs verified at a time.
PAIRS_PER_STEP = 50_000
_SLACK = 1e-9


def _moments(vectors: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per dimension: count, sum and second moments of the unit vectors, summed up in the tasks first."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for value in batch.column(0):
                x = np.array(value.as_py(), dtype=np.float64)
                if len(x) <= MOST_AXES:
                    x = np.append(_normal(x), 1.0)
                    sums.setdefault(len(x) - 1, np.zeros((len(x), len(x))))
                    sums[len(x) - 1] += np.outer(x, x)
        for size, total in sums.items():
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), size), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)],
                ["size", "place", "value"],
            )

    parts = vectors.mapInArrow(tidy(run), "size int, place int, value double")
    out = {}
    for size, place, value in parts.groupBy("size", "place").agg(F.sum("value")).collect():
        out.setdefault(size, np.zeros((size + 1) ** 2))[place] = value
    return {s: m.reshape(s + 1, s + 1) for s, m in out.items()}


def _rotation(size: int, moments: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(axes as columns, block of each axis). Axes are dealt to the blocks by falling variance, the first of a block leads."""
    blocks = max(1, size // BLOCK_DIMENSIONS)
    if moments is None:
        axes, _ = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    else:
        n, mean = moments[size, size], moments[:size, size] / moments[size, size]
        _, axes = np.linalg.eigh(moments[:size, :size] / n - np.outer(mean, mean))
        axes = axes[:, ::-1]
    return np.ascontiguousarray(axes), np.arange(size) % blocks


def _plan(size: int, moments: np.ndarray | None, distance: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(axes, the axes of each block, the budget of each block)."""
    axes, block = _rotation(size, moments)
    members = [np.flatnonzero(block == b) for b in range(block.max() + 1)]
    if moments is None:
        spread = np.ones(size)
    else:
        n, mean = moments[size, size], moments[:size, size] / moments[size, size]
        spread = np.maximum(np.diag(axes.T @ (moments[:size, :size] / n - np.outer(mean, mean)) @ axes), 0) + 1e-6
    share = np.array([spread[m].sum() for m in members])
    return axes, members, distance * share / share.sum() * (1 + _SLACK) + _SLACK


def _normal(x: np.ndarray) -> np.ndarray:
    """The unit vector of each row. A power of two, which rounds nothing, keeps extreme sizes within range before squares."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _packed(x: np.ndarray) -> bytes:
    """The vector's bytes, in single precision where that holds every component exactly."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return single.tobytes() if (single == x).all() else x.tobytes()


def _unit(rows: list[bytes], size: int) -> np.ndarray:
    return _normal(np.stack([np.frombuffer(r, dtype=np.float64 if len(r) == 8 * size else np.float32).astype(np.float64) for r in rows]))


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after joining every i to its j."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _compare(table: pa.Table, plans: dict, threshold: float) -> pa.Table:
    """(id, n_links, root) for the rows of a tile that are linked in it."""
    size, block = table["size"][0].as_py(), table["block"][0].as_py()
    axes, members, budget = plans[size]
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    ids, copies = (table[c].to_numpy()[order] for c in ("id", "copies"))
    own, chunk = (table[c].to_numpy(zero_copy_only=False)[order] for c in ("own", "chunk"))
    unit = _unit([table["vector"][int(i)].as_py() for i in order], size)
    turned = unit @ axes
    mine = np.ascontiguousarray(turned[:, members[block]])
    square = (mine**2).sum(axis=1)
    split = table["low"][0].as_py() != table["high"][0].as_py()
    links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for at in range(0, len(ids), 256):
        to = slice(at, at + 256)
        near = square[to, None] + square[None, :] - 2 * mine[to] @ mine.T <= budget[block] + 1e-7
        near &= (np.arange(len(ids))[to, None] < np.arange(len(ids))[None, :]) & (own[to, None] | own[None, :])
        if split:
            near &= chunk[to, None] != chunk[None, :]
        left, right = np.nonzero(near)
        left += at
        for start in range(0, len(left), PAIRS_PER_STEP):
            i, j = left[start : start + PAIRS_PER_STEP], right[start : start + PAIRS_PER_STEP]
            gap = (turned[i] - turned[j]) ** 2
            fresh = gap[:, members[block]].sum(axis=1) <= budget[block]
            for earlier in range(block):
                fresh &= gap[:, members[earlier]].sum(axis=1) > budget[earlier]
            fresh &= np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            i, j = i[fresh], j[fresh]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = _merge(root, i, j)
    hit = np.flatnonzero(links)
    return pa.table({"id": ids[hit], "n_links": links[hit], "root": ids[root[hit]]})


def linked_vectors(df: DataFrame, key: str, vector: str, label: str, threshold: float = 0.93) -> DataFrame:
    """(key, n_links, component_id, kept) for every row; ``key`` is a whole number.

    Two rows are linked when their labels are equal and not NULL, their vectors have the same length and their cosine
    reaches ``threshold``. Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing.
    ``n_links`` counts all other linked rows, equal vectors included; ``component_id`` is the smallest key that links
    reach. A row with a NULL key has no component, is not kept and counts as no link. Other columns are not read.
    """
    x = F.col("_vector")
    base = df.select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("_vector")
    )
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)
    marked = base.withColumn("usable", F.coalesce(usable, F.lit(False)))
    marked = marked.withColumns(
        {"size": F.size(x), "h1": F.xxhash64(F.lit(1), x), "h2": F.xxhash64(F.lit(2), x)}
    )
    same = ["label", "size", "h1", "h2"]
    good = marked.where("usable")
    distinct = good.groupBy(*same).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("_vector").alias("_vector")
    )
    distinct = stored(distinct, "vectors")

    moments = _moments(distinct.select("_vector"))
    sizes = [r["size"] for r in distinct.select("size").distinct().collect()]
    plans = {s: _plan(s, moments.get(s), 2 * (1 - threshold)) for s in sizes}
    sent = df.sparkSession.sparkContext.broadcast(plans)

    def deal(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                raw = np.array(batch.column(3)[n].as_py(), dtype=np.float64)
                axes, members, budget = sent.value[len(raw)]
                turned = _normal(raw) @ axes
                lead = np.array([turned[m[0]] for m in members])
                cells = np.floor(lead / (np.sqrt(budget) * (1 + 1e-6))).astype(np.int64)
                m = len(members)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(k)[n].as_py()] * m, batch.schema.field(k).type) for k in range(3)
                    ]
                    + [
                        pa.array([len(raw)] * m, pa.int32()),
                        pa.array(np.arange(m), pa.int32()),
                        pa.array(cells),
                        pa.array([_packed(raw)] * m, pa.binary()),
                    ],
                    ["label", "id", "copies", "size", "block", "cell", "vector"],
                )

    kind = distinct.schema["label"].dataType.simpleString()
    schema = f"label {kind}, id long, copies long, size int, block int, cell long, vector binary"
    rows = distinct.select("label", "id", "copies", "_vector").mapInArrow(tidy(deal), schema)
    dealt = tiles.tiled(rows, ["label", "size", "block"], "id", ROWS_PER_CHUNK)

    def compare(table):
        return _compare(table, sent.value, threshold)

    tile = ["label", "size", "block", "cell", "low", "high"]
    found = stored(dealt.groupBy(*tile).applyInArrow(compare, "id long, n_links long, root long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    components = connected_components(found, "id", "root").withColumnRenamed("node", "id")
    reached = distinct.join(links, "id", "left").join(components, "id", "left").select(
        *same,
        F.lit(True).alias("usable"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"),
    )
    out = marked.select("id", "usable", *same).join(reached, [*same, "usable"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
